"""How often joint statistics read their table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import ordering as O
from tablewright.operators import profile as P
from tablewright.operators import quantiles as Q


def counted(df):
    """The table, and how many times all of its rows have been read."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    rows = df.count()
    return df.mapInArrow(each, df.schema), lambda: seen.value / rows


@pytest.fixture(scope="module")
def wide(spark):
    """60 columns of all scales, with gaps, ties and a third of one value."""
    rng = np.random.default_rng(4)
    columns = {}
    for k in range(60):
        v = rng.standard_normal(700) * 10.0 ** (k - 30)
        if k % 3 == 0:
            v[rng.random(700) < 0.3] = 7.5
        if k % 4 == 0:
            v[rng.random(700) < 0.1] = np.nan
        columns[f"c{k}"] = v
    columns["c5"][:3] = np.inf, -np.inf, 5e-324
    rows = [tuple(None if np.isnan(v[i]) else float(v[i]) for v in columns.values()) for i in range(700)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3).persist()
    return df, columns


def test_all_ranks_in_six_scans(wide):
    df, columns = wide
    table, scans = counted(df)
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    found = Q.exact_quantiles(table, {c: shares for c in columns if c != "c5"}, state_limit=0)
    assert scans() <= 6
    for c, got in found.items():
        want = np.quantile(columns[c][~np.isnan(columns[c])], shares)
        assert [got[p] for p in shares] == pytest.approx(list(want), rel=1e-12), c
    ranks = Q.select_ranks(df, {"c5": [0, 1, 350, 698, 699]})["c5"]
    assert ranks == {r: sorted(columns["c5"])[r] for r in ranks} and len(ranks) == 5


def test_trimmed_means_in_seven_scans(wide):
    df, columns = wide
    names = [c for c in columns if c != "c5"]
    table, scans = counted(df)
    found = Q.trimmed_means(table, names, 0.05, state_limit=0)
    assert scans() <= 7
    for c in names:
        own = np.sort(columns[c][~np.isnan(columns[c])])
        k = int(len(own) * 0.05)
        assert found[c] == pytest.approx(own[k:len(own) - k].mean(), rel=1e-9, abs=1e-9 * np.abs(own).max()), c


def test_correlation_in_one_scan(wide):
    df, columns = wide
    table, scans = counted(df.drop("c5"))
    got = {(r.col_i, r.col_j): r.r for r in P.correlation_matrix(table).collect()}
    assert scans() == 1 and len(got) == 59 * 59
    for a in ("c0", "c4", "c7", "c59"):
        for b in ("c1", "c4", "c8", "c30"):
            both = ~np.isnan(columns[a]) & ~np.isnan(columns[b])
            want = 1.0 if a == b else np.corrcoef(columns[a][both], columns[b][both])[0, 1]
            assert got[a, b] == pytest.approx(want, abs=1e-9)


def test_correlation_does_not_cancel_out(spark):
    df = spark.range(0, 1000, numPartitions=5).select(
        (F.col("id") + 1e12).alias("a"), (2.0 * F.col("id") - 1e12).alias("b"), F.lit(3.0).alias("c"),
        F.when(F.col("id") < 1, 1.0).alias("d"))
    got = {(r.col_i, r.col_j): r.r for r in P.correlation_matrix(df).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "c"] == 0.0 and got["a", "d"] == 0.0 and got["d", "d"] == 1.0


@pytest.mark.parametrize("fold", [2, 1000])
def test_sortedness_in_one_shuffle(spark, monkeypatch, fold):
    monkeypatch.setattr(O, "BLOCK_ROWS", 50)
    monkeypatch.setattr(O, "FOLD", fold)
    df = spark.range(0, 1000, numPartitions=4).select(
        "id", F.col("id").cast("double").alias("up"), F.when(F.col("id") == 777, 0).otherwise(F.col("id")).alias("dip"),
        F.when(F.col("id") > 990, float("nan")).otherwise(1.0).alias("nan_last"), (F.col("id") > 500).alias("flag"),
        F.lpad(F.col("id").cast("string"), 4, "0").alias("text"), F.lit(None).cast("date").alias("none"))
    got = {r["column"]: r for r in O.sortedness(df, df.columns[1:], ["id"]).collect()}
    assert [c for c in got if got[c]["ascending"]] == ["up", "nan_last", "flag", "text", "none"]
    assert [c for c in got if got[c]["strictly_ascending"]] == ["up", "text", "none"]
    assert [c for c in got if got[c]["descending"]] == ["none"]
    plan = O.sortedness(df, ["up"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan or "SinglePartition" not in plan.split("Window [")[1]
