"""Column measures gathered in one aggregation and turned into one row per column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import casts, text

Measure = Callable[[Column], Column]

# A wide aggregation is cut into pieces of about this many aggregate expressions: generated
# methods beyond 8000 bytes are never compiled by the JVM, which costs more than another pass
# over a few Parquet columns.  The pieces are independent jobs and run side by side.
AGGREGATES_PER_PASS = 32
CONCURRENT_JOBS = 4


def as_double(c: Column, dtype: T.DataType) -> Column:
    """Numeric or temporal values as double; NaN counts as missing."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, T.DateType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double")
    return c.try_cast("double")


def null_count(c: Column) -> Column:
    return F.count_if(c.isNull())


def null_pct(c: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(c.isNull()) * 100.0, F.count(F.lit(1))), F.lit(0.0))


def distinct_count(c: Column) -> Column:
    """Null counts as one value."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("bigint")), F.lit(0))


MEASURES: dict[str, Measure] = {
    "row_count": lambda c: F.count(F.lit(1)),
    "null_count": null_count,
    "null_pct": null_pct,
    "non_null_count": F.count,
    "distinct_count": distinct_count,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "sum": lambda c: F.sum(c.cast("double")),
    "stddev": lambda c: F.stddev_samp(c),
    "zero_count": lambda c: F.count_if(c == 0),
    "negative_count": lambda c: F.count_if(c < 0),
    "is_integer": lambda c: F.coalesce(F.bool_and(c == F.floor(c)), F.lit(True)),
    "true_count": F.count_if,
    "false_count": lambda c: F.count_if(~c),
    "min_length": lambda c: F.min(F.char_length(c)),
    "max_length": lambda c: F.max(F.char_length(c)),
    "avg_length": lambda c: F.avg(F.char_length(c)),
    "has_special": lambda c: F.coalesce(F.bool_or(text.has_carriage_return(c)), F.lit(False)),
    "has_control": lambda c: F.coalesce(F.bool_or(text.has_control_character(c)), F.lit(False)),
}


def batches(items: Sequence, size: int) -> Iterator[Sequence]:
    for start in range(0, len(items), max(1, size)):
        yield items[start:start + size]


def field(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def describe_columns(df: DataFrame, columns: Sequence[str], measures: Sequence[str],
                     prepare: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per column with the named measures, from a single aggregation per batch.

    All listed columns must give one common type per measure (all numbers, all texts, ...).
    """
    prepare = prepare or (lambda c: c)
    parts = []
    for batch in batches(list(columns), AGGREGATES_PER_PASS // max(1, len(measures))):
        aggregated = df.agg(*[
            MEASURES[m](prepare(field(name))).alias(f"c{i}_{m}")
            for i, name in enumerate(batch) for m in measures
        ])
        rows = F.array(*[
            F.struct(F.lit(name).alias("column"), *[F.col(f"c{i}_{m}").alias(m) for m in measures])
            for i, name in enumerate(batch)
        ])
        parts.append(aggregated.select(F.inline(rows)))
    return union_all(parts)


def run_jobs(spark: SparkSession, jobs: Sequence[Callable[[], Any]]) -> list:
    """Run independent small Spark jobs side by side and return their results in order."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(CONCURRENT_JOBS) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]


def collect_measures(df: DataFrame, wanted: dict[str, dict[str, Column]]) -> dict[str, dict]:
    """Evaluate aggregate expressions per column; the result is one small row per batch."""
    result: dict[str, dict] = {name: {} for name in wanted}
    pieces: list[list[tuple]] = [[]]
    for name, exprs in wanted.items():
        if pieces[-1] and len(pieces[-1]) + len(exprs) > AGGREGATES_PER_PASS:
            pieces.append([])
        pieces[-1] += [(name, key, expr) for key, expr in exprs.items()]
    pieces = [part for piece in pieces for part in batches(piece, 2 * AGGREGATES_PER_PASS)]
    frames = [df.agg(*[expr.alias(f"a{i}") for i, (_, _, expr) in enumerate(piece)])
              for piece in pieces]
    for piece, row in zip(pieces, run_jobs(df.sparkSession, [f.first for f in frames])):
        for value, (name, key, _) in zip(row, piece):
            result[name][key] = value
    return result


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if casts.is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def digest(c: Column) -> list[Column]:
    """128 bits that stand for a value in a shuffle: two 64-bit hashes over the whole value."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in all columns; digests are shuffled, not rows."""
    row = F.struct(*[field(c) for c in df.columns])
    counted = df.select(*digest(row)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    return counted.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_key_count(df: DataFrame, column: str) -> DataFrame:
    c = field(column)
    return (df.groupBy(c.alias("key")).agg(F.count(F.lit(1)).alias("copies"))
            .agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
                 F.count(F.lit(1)).alias("distinct_count"))
            .withColumn("duplicate_keys", F.col("row_count") - F.col("distinct_count")))


def group_aggregate(df: DataFrame, keys: Sequence[str], aggregates: dict[str, str]) -> DataFrame:
    """``aggregates`` maps output names to SQL aggregate expressions."""
    return df.groupBy(*[field(k) for k in keys]).agg(
        *[F.expr(expression).alias(name) for name, expression in aggregates.items()])


# ---------------------------------------------------------------- value frequencies

def stacked(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """(i, v): the values of several columns of one type below each other, from one scan."""
    return df.select(F.posexplode(F.array(*values)).alias("i", "v"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for all listed columns; null stays a value of its own.

    One scan, pre-aggregated before its shuffle: a value that fills a third of the table
    arrives as one row per task.
    """
    names = F.array(*[F.lit(c) for c in columns])
    return (stacked(df, [field(c).cast("string") for c in columns])
            .groupBy("i", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .select(names[F.col("i")].alias("column"), "value", "n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct values per column, null counted as one.

    Columns of one type are stacked and share a scan and a shuffle; equal values are merged
    before it.
    """
    by_type: dict[T.DataType, list[str]] = {}
    for name in columns:
        by_type.setdefault(df.schema[name].dataType, []).append(name)
    parts = []
    for names in by_type.values():
        label = F.array(*[F.lit(c) for c in names])
        parts.append(stacked(df, [field(c) for c in names]).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
                     .groupBy("i").agg(F.count(F.lit(1)).alias("distinct_count"))
                     .select(label[F.col("i")].alias("column"), "distinct_count"))
    return union_all(parts)


def frequency_summary(counts: DataFrame) -> DataFrame:
    """Per column of ``value_counts``: top value (ties: smallest), extremes of the counts."""
    known = F.col("value").isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("n")).alias("neg"), F.col("value"))))
    return (counts.groupBy("column")
            .agg(F.count(F.lit(1)).alias("distinct_count"),
                 F.count("value").alias("value_count"),
                 F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null_count"),
                 F.min(F.when(known, F.col("n"))).alias("min_n"),
                 F.max(F.when(known, F.col("n"))).alias("max_n"),
                 best.alias("best"))
            .select("column", "distinct_count", "value_count", "non_null_count", "min_n", "max_n",
                    F.col("best.value").alias("top_value"), (-F.col("best.neg")).alias("top_count")))


# Longer texts are counted by digest, so that a shuffle never carries them.
LONG_TEXT = 128
TIED_DIGESTS = 10_000


def long_text_summary(df: DataFrame, column: str) -> dict:
    """``frequency_summary`` of one column of long texts, without shuffling the texts."""
    c = field(column)
    counts = df.where(c.isNotNull()).select(*digest(c)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.count(F.lit(1)).alias("values"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                       F.min("n").alias("least"), F.max("n").alias("most"),
                       F.max(F.struct("n", "h1", "h2")).alias("top")).first()
    nulls = df.where(c.isNull()).limit(1).count()
    result = {"column": column, "distinct_count": found["values"] + nulls, "value_count": found["values"],
              "non_null_count": found["rows"], "min_n": found["least"], "max_n": found["most"],
              "top_value": None, "top_count": found["most"]}
    if not found["values"]:
        return result
    if found["most"] == 1:      # all texts differ: the smallest of them wins the tie
        result["top_value"] = df.agg(F.min(c)).first()[0]
        return result
    tied = counts.where(F.col("n") == found["most"]).select("h1", "h2")
    few = tied.limit(TIED_DIGESTS + 1).count() <= TIED_DIGESTS
    # Beyond that many ties each digest covers a tiny share of the rows: a plain join has no hot key.
    winners = df.select(c.alias("v"), *digest(c)).join(F.broadcast(tied) if few else tied, ["h1", "h2"], "left_semi")
    result["top_value"] = winners.agg(F.min("v")).first()[0]
    return result


def value_frequency(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> DataFrame:
    """The ``limit`` most frequent values of each column, most frequent first."""
    from pyspark.sql import Window

    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (value_counts(df, columns).where(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= limit))


def top_k_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return (df.where(field(column).isNotNull())
            .groupBy(field(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("value")).limit(k))


def mode_value(df: DataFrame, column: str):
    """Most frequent non-null value, the smallest of ties."""
    best = (df.where(field(column).isNotNull()).groupBy(field(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("best"))
            .select("best.value").first())
    return best[0]


# ---------------------------------------------------------------- fingerprints

def fingerprint_columns(prefix: str, value: Column) -> list[Column]:
    """Order-free digest of a multiset of values: xor and sum of a 64-bit hash, and a count."""
    digest = F.xxhash64(value)
    return [
        F.bit_xor(digest).alias(f"{prefix}_xor"),
        F.sum(digest.cast("decimal(20,0)")).alias(f"{prefix}_sum"),
        F.count(F.lit(1)).alias(f"{prefix}_n"),
    ]


def hashable(value: Column, dtype: T.DataType) -> Column:
    """Maps as sorted arrays of their entries, wherever they are; other values as they are."""
    if isinstance(dtype, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(
            hashable(e["key"], dtype.keyType).alias("key"), hashable(e["value"], dtype.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: hashable(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[hashable(value[f.name], f.dataType).alias(f.name) for f in dtype]))
    return value


def _holds_map(dtype: T.DataType) -> bool:
    return "map<" in dtype.simpleString()


def table_fingerprint(df: DataFrame) -> DataFrame:
    """SHA-256 over the schema, the row count and an order-free digest of all rows."""
    digest = df.agg(*fingerprint_columns("rows", F.struct(*[
        hashable(field(f.name), f.dataType).alias(f.name) if _holds_map(f.dataType) else field(f.name) for f in df.schema])))
    described = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rows_xor", "rows_sum", "rows_n")]
    return digest.select(
        F.sha2(F.concat_ws("|", F.lit(described), *parts), 256).alias("fingerprint"),
        F.col("rows_n").alias("row_count"))
