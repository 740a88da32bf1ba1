import pytest
from pyspark.sql import functions as F

from tablewright.operators import ordering as O


def test_row_index_with_hot_key(spark):
    """A third of the rows share one key; positions are still complete and spread over tasks."""
    df = spark.range(0, 9000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = O.row_index(df, ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = got.orderBy("row_index").select("row_index", "k").collect()
    assert [r["row_index"] for r in rows] == list(range(9000))
    keys = [r["k"] for r in rows]
    assert keys == sorted(keys)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 9000 * 0.6


def test_slice_and_stride(spark):
    df = spark.range(100, numPartitions=3).withColumn("id", 99 - F.col("id"))
    assert [r[0] for r in O.row_slice(df, ["id"], 10, 3).orderBy("id").collect()] == [10, 11, 12]
    assert sorted(r[0] for r in O.sample_stride(df, ["id"], 7).collect()) == [0, 14, 28, 42, 56, 70, 84]


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_sortedness_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(O, "BLOCK_ROWS", block)
    columns = {
        "up": list(range(20)), "flat": [1] * 20, "down": list(range(20, 0, -1)),
        "dip": [*range(10), 3, *range(11, 20)],
        "holes": [None if i % 4 == 1 else i for i in range(20)],
        "hidden": [5, None, None, None, 4, None, *range(6, 20)],
        "none": [None] * 20,
    }
    rows = list(zip(range(20), *columns.values()))
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} int" for c in columns))
    got = {r["column"]: r for r in O.sortedness(df, list(columns), ["i"]).collect()}
    for name, values in columns.items():
        seen = [v for v in values if v is not None]
        pairs = list(zip(seen, seen[1:]))
        assert got[name]["ascending"] == all(a <= b for a, b in pairs), name
        assert got[name]["strictly_descending"] == all(a > b for a, b in pairs), name


def test_sort_puts_nulls_first(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert [r[0] for r in O.sort_rows(df, ["v"]).collect()] == [None, 1, 2]
    assert [r[0] for r in O.sort_rows(df, ["v"], [True]).collect()] == [None, 2, 1]


def test_samples(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    a = O.sample_reservoir(orders, ["o_orderkey"], 50)
    b = O.sample_reservoir(orders.repartition(7), ["o_orderkey"], 50)
    assert {r["o_orderkey"] for r in a.collect()} == {r["o_orderkey"] for r in b.collect()}
    assert a.count() == 50
    head = O.sample_head_random(orders, 20, order_by=["o_orderkey"])
    first = {r[0] for r in orders.select("o_orderkey").orderBy("o_orderkey").limit(40).collect()}
    keys = [r["o_orderkey"] for r in head.collect()]
    assert len(keys) == len(set(keys)) == 20 and set(keys) <= first


@pytest.mark.parametrize("rows, columns, wanted, size, expected", [
    (5_000, 80, 10_000, 1 << 30, None), (1_000_000, 10, 10_000, 1 << 20, None),
    (1_000_000, 10, 10_000, 1 << 30, 10_000), (1_000_000, 60, 10_000, 0, 7_500),
    (1_000_000, 200, 10_000, 0, 25_000), (20_000, 10, 600_000, 1 << 30, 20_000), (20_000, 10, 5, 1 << 30, 1_000)])
def test_sample_size_policy(rows, columns, wanted, size, expected):
    assert O.sample_size(rows, columns, wanted, size) == expected
