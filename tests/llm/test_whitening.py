"""Whitening against NumPy's own eigenvalues and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tablewright.llm import queries, spectrum, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain_whitening(rows, most=16):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in kept:
        y = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), y @ vectors[:, ::-1][:, :most]))
    return n, values[::-1][:most], values.sum(), out


def compare(rows, got, most=16):
    n, values, trace, want = plain_whitening(rows, most)
    values = values[:len({r.component for r in got})]
    by_id = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-6 * r.explained + 1e-12
        by_id.setdefault(r.vec_id, []).append(r)
    assert by_id.keys() == want.keys()
    signs = np.zeros(len(values))
    for i, own in want.items():
        assert len(by_id[i]) == len(own) * len(values)
        deviation, y = own[0]
        for r in by_id[i]:
            assert r.deviation == deviation
            k = r.component - 1
            if r.whitened is None:
                assert values[k] <= 1e-9 * trace
                continue
            expected = y[k] / math.sqrt(values[k])
            if signs[k] == 0 and abs(expected) > 0.01:
                signs[k] = np.sign(expected * r.whitened)
            if signs[k]:
                assert abs(signs[k] * r.whitened - expected) < 1e-6


def test_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = queries.QUERIES["op13_whitening"](spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare([(r.vec_id, r.embedding) for r in table.collect()], got.collect())


def test_repeats_nulls_and_other_dimensions(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.standard_normal(5).tolist(), 1) for i in range(60)]
    odd = [(100, None, 1), (101, [1.0, None, 1.0, 1.0, 1.0], 1), (102, [float("nan")] * 5, 1), (103, [float("inf")] * 5, 1),
           (104, [], 1), (105, [0.5, 0.5], 1)]
    rows += [rows[0]] * 40 + [(None, rows[1][1], None), (7, rows[7][1], 2)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumnRenamed("label", "x").repartition(5)
    got = whitening.whiten(df, 3).collect()
    compare([r[:2] for r in rows], got, 3)


def test_few_vectors(spark):
    same = [(i, [1.0, 2.0, 3.0], 0) for i in range(3)]
    got = whitening.whiten(spark.createDataFrame(same, SCHEMA)).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, 0.0, 0.0)} and len(got) == 9
    two = same + [(9, [2.0, 4.0, 6.0], 0)]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(two, SCHEMA)).collect()}
    assert abs(abs(got[9, 1].whitened) - 1) < 1e-12 and got[9, 2].whitened is None and got[9, 1].explained == pytest.approx(1)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wide_numbers_stay_exact(spark):
    rows = [(1, [1e12, 0.0], 0), (2, [-1e12, 1.0], 0), (3, [3e9, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    xs = [[math.floor(64 * c) + 1000000 for c in v] for _, v, _ in rows]
    want = [sum((3 * a - s) ** 2 for a, s in zip(x, map(sum, zip(*xs)))) for x in xs]
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, 1).collect()}
    assert got == {i + 1: w if w < 1 << 63 else None for i, w in enumerate(want)}


@pytest.mark.parametrize("seed", range(6))
def test_counts_of_inertia(seed):
    draw = np.random.default_rng(seed)
    for n in (1, 2, 5, 30):
        a = draw.standard_normal((n, n))
        a += a.T
        for shift in draw.standard_normal(5) * 3:
            assert spectrum.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
        np.fill_diagonal(a, 0)  # pivots of size two
        assert spectrum.above(a, 0.0) == (np.linalg.eigvalsh(a) > 0).sum()


@pytest.mark.parametrize("values", [range(1, 41), [5, 5, 5, 4, 4, 3 + 1e-13, 3] + [1] * 20, [1e8, 1, 1e-8, 0, 0], [2] * 9, [0] * 4,
                                    [1] + [0] * 30])
def test_leading_pairs(values):
    values = np.array(sorted(values, reverse=True), float)
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((len(values),) * 2))
    a = (q * values) @ q.T
    got, vectors = spectrum.leading(a, 16)
    scale = max(values[0], 1e-300)
    assert len(got) == min(16, len(values)) and np.abs(got - values[:16]).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() <= 1e-13 * scale
