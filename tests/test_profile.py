import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggregates as A
from tablewright.operators import insights as I
from tablewright.operators import profile as P


def profile(spark, rows, schema, order_by=None):
    return {r["name"]: r for r in P.profile_table(spark.createDataFrame(rows, schema), order_by).collect()}


def test_numeric(spark):
    got = profile(spark, [(1.0,), (1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")["v"]
    n = got["numeric"]
    assert got["kind"] == "Numeric" and got["null_count"] == 1 and got["distinct_count"] == 5
    assert (n["min"], n["max"], n["mean"], n["median"]) == (1.0, 10.0, 3.4, 2.0)
    assert sum(b["count"] for b in n["histogram"]) == 5
    assert n["is_integer"] and n["zero_count"] == 0


def test_nan_is_not_a_value(spark):
    got = profile(spark, [(float("nan"),), (1.0,), (3.0,)], "v double")["v"]
    assert got["nan_count"] == 1 and got["numeric"]["max"] == 3.0 and got["numeric"]["mean"] == 2.0


def test_constant_histogram(spark):
    h = profile(spark, [(2.0,)] * 3, "v double")["v"]["numeric"]["histogram"]
    assert len(h) == 20 and h[10]["count"] == 3 and h[0]["bin_start"] == -8.0
    assert sum(b["count"] for b in h) == 3


def test_effective_boolean(spark):
    got = profile(spark, [(1,), (0,), (None,), (1,)], "v int")["v"]
    assert got["kind"] == "Boolean" and got["boolean"].asDict() == {"true_count": 2, "false_count": 1}


def test_categories(spark):
    got = profile(spark, [("CARD",)] * 3 + [("CASH",)] * 2 + [(None,)], "v string")["v"]
    assert got["kind"] == "Categorical" and got["frequency"] == {"CARD": 3, "CASH": 2}
    assert got["distinct_count"] == 2 and got["text"]["top_value"] == "CARD"


def test_long_text_is_text(spark):
    rows = [(f"{i} " + "word " * 60,) for i in range(150)] + [("7 " + "word " * 60,)]
    got = profile(spark, rows, "v string")["v"]
    assert got["kind"] == "Text" and got["distinct_count"] == 150
    assert got["text"]["top_count"] == 2 and got["text"]["top_value"].startswith("7 ")


def test_nested_and_empty(spark):
    got = profile(spark, [([1.0, 2.0], None)], "v array<double>, e string")
    assert got["v"]["kind"] == "Nested" and got["e"]["null_pct"] == 100.0
    assert profile(spark, [], "v double")["v"]["row_count"] == 0


def test_temporal_order(spark):
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)) for i in range(40)]
    got = profile(spark, rows, "i int, t timestamp", ["i"])
    assert got["t"]["is_sorted"] and not got["t"]["is_sorted_desc"]
    assert len(got["t"]["temporal"]["timeline"]) == 20
    assert sum(b["count"] for b in got["t"]["temporal"]["timeline"]) == 40


def test_state_limit_does_not_change_the_profile(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    want = P.profile_rows(df)
    monkeypatch.setattr(P.Q, "STATE_LIMIT", 100)
    for name in ("exact_quantiles", "trimmed_means", "order_statistics", "column_sizes"):
        fn = getattr(P.Q, name)
        defaults = tuple(100 if d == 1_000_000 else d for d in fn.__defaults__)
        monkeypatch.setattr(fn, "__defaults__", defaults)
    got = P.profile_rows(df)
    flat = lambda rows: [[round(x, 6) if isinstance(x, float) else x for x in r[15]] if r[15] else None for r in rows]
    assert [r[9] for r in got] == [r[9] for r in want]
    assert [x[:12] for x in flat(got)] == [x[:12] for x in flat(want)]


def test_correlation(spark):
    df = spark.createDataFrame([(1, 2.0, 3, "x", 1), (2, 4.0, 2, "y", 1), (3, 6.0, 1, "z", 1)],
                               "a int, b double, c int, d string, e int")
    r = {(x["col_i"], x["col_j"]): x["r"] for x in P.correlation_matrix(df).collect()}
    assert r["a", "b"] == pytest.approx(1) and r["a", "c"] == pytest.approx(-1)
    assert r["a", "e"] == 0.0 and r["e", "e"] == 1.0 and ("a", "d") not in r
    assert P.correlation_matrix(df.select("a", "d")).count() == 0


def test_correlation_with_gaps(spark):
    import numpy as np
    rows = [(1.0, 2.0), (2.0, None), (3.0, 1.0), (None, 5.0), (5.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    both = np.array([r for r in rows if None not in r])
    r = P.correlation_matrix(df).where("col_i = 'a' AND col_j = 'b'").first()["r"]
    assert r == pytest.approx(np.corrcoef(both.T)[0, 1])


def test_health(spark):
    clean = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "a int, b string")
    assert P.health_score(P.profile_table(clean)).first()["score"] == 1.0
    dirty = spark.createDataFrame([(1, "a\r"), (None, "b"), (None, "c")], "a int, b string")
    row = P.health_score(P.profile_table(dirty)).first()
    assert row["score"] == pytest.approx(0.85) and len(row["risks"]) == 2


def test_outlier_insights(spark):
    df = spark.createDataFrame([(10.0,)] * 95 + [(float(v),) for v in (1000, 2000, 3000, 4000, 5000)], "v double")
    codes = {r["code"] for r in I.insights(P.profile_table(df)).collect()}
    assert {"outliers", "one_bin", "clustered", "mean_median_gap", "steeper_than_normal"} <= codes


def test_identifier_advice(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c"), (2, "d"), (3, "e")], "customer_id int, order_id string")
    flags = {r["name"]: r for r in I.with_advice_flags(P.profile_table(df)).collect()}
    assert flags["customer_id"]["is_identifier"] and flags["order_id"]["is_identifier"]
    assert flags["customer_id"]["advise_identifier_by_name"]


def test_wide_table(spark):
    df = spark.range(20).select(*[(F.col("id") * (i + 1)).cast("string").alias(f"c{i}") for i in range(120)])
    assert P.profile_table(df).count() == 120


def test_fingerprint_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (2, None), (3, "x")], "a int, b string")
    assert A.duplicate_row_count(df).first()[0] == 3
    f = lambda d: A.table_fingerprint(d).first()["fingerprint"]
    assert f(df) == f(df.orderBy("b")) != f(df.distinct())
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (2, None), (4, "x")], "a int, b string")
    assert f(df) != f(pairs)


def test_distinct_longs_beyond_the_digits_of_a_double(spark):
    from tablewright.operators.profile import profile_table
    df = spark.range(1000).selectExpr("(1L << 60) + id AS big", "CAST(id AS DECIMAL(30,0)) + 1000000000000000000000 AS wide")
    got = {r["name"]: r["distinct_count"] for r in profile_table(df).collect()}
    assert got == {"big": 1000, "wide": 1000}
