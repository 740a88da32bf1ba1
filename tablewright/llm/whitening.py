"""Whitening of embeddings: centred vectors projected on the leading components of their covariance, at unit variance.

Entries become fixed-point numbers, so that sums and deviations are exact integers.  The covariance is taken over the
fit list, each distinct fixed-point vector once.  Tasks add up sums, then centred products, each to one matrix of the
size of a dimension squared; the driver sees their total only, and cuts its spectrum (module ``spectrum``).

Edge cases: rows whose vector is null, empty, or holds a null or non-finite entry are left out, as are vectors that are not of
the most common dimension (of several, the smallest).  A component without variance (rank below its number, one distinct
vector) has ``whitened`` null; ``explained`` is 0 where no component has variance.  A deviation beyond 64 bits is null; an
entry beyond the range of fixed-point numbers raises.  Null ids stay null, repeated rows give equal rows, equal eigenvalues
leave the choice of vectors open.  Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common, spectrum

LARGEST = 1 << 62


def fixed_point(df: DataFrame, scale: int = 64, shift: int = 1_000_000, id_column: str = "vec_id",
                vector_column: str = "embedding") -> DataFrame:
    """(id, x array<long>): x = floor(scale * entry) + shift, for the vectors that have finite entries only."""
    vector = df[vector_column].cast("array<double>")
    rows = df.select(df[id_column].alias("id"), vector.alias("vector")).where(
        (F.size("vector") > 0) & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.select("id", F.transform("vector", lambda c: (F.floor(F.lit(float(scale)) * c) + F.lit(shift)).cast("bigint")).alias("x"))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers where they suffice, else Python's."""
    most = max(int(np.abs(x).max(initial=0)), 1) * n + max(abs(s) for s in sums)
    if most < LARGEST:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _numerators(x, n, sums).astype(np.float64) / n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per dimension of a task, in Python's integers, as text."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, 0)
            wide = x if int(np.abs(x).max()) < LARGEST // len(x) else x.astype(object)
            own = [int(s) for s in wide.sum(0)]
            total = own if total is None else [a + b for a, b in zip(total, own)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()),
                                          pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "s"])


def _products(project):
    """Sums of y y' over the rows of a task, for y = project(x)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                y = project(_matrix(batch.slice(start, 4096), 0))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                                             ["i", "j", "s"])
    return each


def _covariance(fit: DataFrame, n: int, size: int, project) -> np.ndarray:
    out = np.zeros((size, size))
    cells = fit.mapInArrow(_products(project), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for row in cells.collect():  # size squared numbers, whatever the number of rows
        out[row.i, row.j] = out[row.j, row.i] = row.s / n
    return out


class Whitening:
    """A fitted whitening: n vectors with sums S, components as columns, eigenvalues, and how far from the identity
    the covariance of what it makes is."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        floor = len(sums) * np.finfo(float).eps * max(trace, 0.0)
        self.fine = values > floor
        self.identity_error = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of the components that have variance."""
        return _centred(x, self.n, self.sums) @ (self.vectors[:, self.fine] / np.sqrt(self.values[self.fine]))

    def rows(self):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(self.values)
            explained = self.values / self.trace if self.trace > 0 else np.zeros(k)
            for whole in batches:
                for start in range(0, whole.num_rows, 2048):
                    batch = whole.slice(start, 2048)
                    x = _matrix(batch, 1)
                    numerators = _numerators(x, self.n, self.sums)
                    if numerators.dtype == object or int(np.abs(numerators).max()) ** 2 * x.shape[1] >= LARGEST:
                        far = [int(d) for d in (numerators.astype(object) ** 2).sum(1)]
                        deviation = pa.array([d if d < 1 << 63 else None for d in far], pa.int64())
                    else:
                        deviation = pa.array((numerators * numerators).sum(1))
                    values = np.full((len(x), k), np.nan)
                    values[:, self.fine] = self.project(x)
                    rows = pa.array(np.repeat(np.arange(len(x)), k))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                         pa.array(np.full(len(rows), self.n)), deviation.take(rows),
                         pa.array(values.ravel(), mask=np.isnan(values.ravel())), pa.array(np.tile(explained, len(x))),
                         pa.array(np.full(len(rows), self.identity_error))],
                        ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        return each


def fit(x: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors in column ``x``; None where there are none."""
    distinct = common.stored(x.select("x").distinct(), "fit")
    sums = [int(r.s) for r in distinct.mapInArrow(_sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
            .orderBy("i").collect()]
    n = distinct.count()
    if not n:
        return None
    covariance = _covariance(distinct, n, len(sums), lambda block: _centred(block, n, sums))
    values, vectors = spectrum.leading(covariance, components)
    found = Whitening(n, sums, values, vectors, float(np.trace(covariance)))
    if size := int(found.fine.sum()):
        made = _covariance(distinct, n, size, found.project)
        found.identity_error = float(np.abs(made - np.eye(size)).max())
    return found


def whiten(df: DataFrame, components: int = 16, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id_column``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` for
    every row with a usable vector and every component."""
    rows = fixed_point(df, id_column=id_column, vector_column=vector_column)
    common_size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size("x") == (common_size.size if common_size else 0))
    kind = df.schema[id_column].dataType.simpleString()
    schema = (f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    found = fit(rows, components)
    if found is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    return rows.mapInArrow(found.rows(), schema).withColumnRenamed("id", id_column)
