"""Compatibility of columns with more categories than a profile keeps."""

from pyspark.sql import functions as F

from tablewright.operators import columns as C
from tablewright.operators.profile import profile_table


def test_rare_values_count(spark):
    """1,200 numbers 30 times each, and in one column a rare word that the 1,000 kept values do not show."""
    df = spark.range(36000).select((F.col("id") % 1200).cast("string").alias("good")).withColumn("bad", F.col("good"))
    df = df.union(spark.createDataFrame([("1", "word")], "good string, bad string"))
    profile = profile_table(df).cache()
    assert {(r["name"], r["kind"], r["frequency_truncated"]) for r in profile.collect()} == {
        ("good", "Categorical", True), ("bad", "Categorical", True)}
    answer = lambda *table: {r["name"]: r["compatible"] for r in C.type_compatibility(profile, "Numeric", *table).collect()}
    assert answer(df) == {"good": True, "bad": False}
    assert answer() == {"good": None, "bad": None}
