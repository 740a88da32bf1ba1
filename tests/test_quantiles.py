import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import quantiles as Q

SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(5)


def cases():
    rng = np.random.default_rng(3)
    yield "uniform", rng.random(4000)
    yield "heavy tail", rng.pareto(0.7, 3000)
    yield "hot value", np.concatenate([np.full(1500, 42.0), rng.normal(40, 5, 3000)])
    yield "two hot values", np.concatenate([np.full(1500, -1.0), np.full(1400, 9.0), rng.random(500)])
    yield "constant", np.full(700, 3.0)
    yield "few", np.array([5.0])


@pytest.mark.parametrize("label, values", list(cases()), ids=[c[0] for c in cases()])
@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_exact_against_numpy(spark, label, values, limit):
    """Both ways, by value counts and by narrowing, give the linear quantiles exactly."""
    df = frame(spark, list(values) + [None, float("nan")])
    found = Q.exact_quantiles(df, {"v": SHARES}, state_limit=limit, accuracy=50)["v"]
    for p in SHARES:
        assert found[p] == pytest.approx(np.quantile(values, p), rel=1e-12), p


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_trimmed_mean(spark, limit):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(900, 2.0), rng.normal(0, 10, 1700)])
    k = int(len(values) * 0.05)
    want = np.sort(values)[k:len(values) - k].mean()
    got = Q.trimmed_means(frame(spark, values), ["v"], 0.05, state_limit=limit, accuracy=50)["v"]
    assert got == pytest.approx(want)


def test_trimmed_mean_small(spark):
    df = frame(spark, [0, 10, 20, 30, 100])
    assert Q.trimmed_means(df, ["v"], 0.2)["v"] == pytest.approx(20.0)
    assert Q.trimmed_means(df, ["v"], 0.0)["v"] == pytest.approx(32.0)


def test_empty_column(spark):
    df = spark.range(3).select(F.lit(None).cast("double").alias("v"))
    assert Q.exact_quantiles(df, {"v": [0.5]})["v"] == {0.5: None}


def test_times_and_longs(spark):
    df = spark.range(101).select(F.col("id"), F.timestamp_seconds(F.col("id")).alias("t"))
    found = Q.exact_quantiles(df, {"id": [0.25], "t": [0.5]})
    assert found["id"][0.25] == 25.0
    assert found["t"][0.5] == 50e6
