"""Catalog snapshots (a data dictionary): one row per column plus one row for the dataset."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import insights
from tablewright.operators.aggregates import duplicate_row_count, table_fingerprint
from tablewright.operators.profile import profile_table, quality_summary

# The fields that count towards completeness.
DATASET_FIELDS = ["description", "intended_use", "owner_or_steward", "refresh_expectation",
                  "sensitivity_classification", "known_limitations"]
COLUMN_FIELDS = ["business_definition", "business_rules", "sensitivity_tag"]
COLUMN_EXTRA = ["approved_examples", "notes"]
SAMPLE_VALUES = 5


def column_id(name: Column) -> Column:
    """A stable UUID made of the first half of the SHA-256 of the name."""
    digest = F.sha2(name.cast("binary"), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


def catalog_columns(profile: DataFrame) -> DataFrame:
    """The column rows of a snapshot, from a profile."""
    as_text = {
        "min": F.coalesce(F.col("numeric.min").cast("string"), F.col("temporal.min").cast("string")),
        "max": F.coalesce(F.col("numeric.max").cast("string"), F.col("temporal.max").cast("string"))}
    stats = F.to_json(F.struct("numeric", "text", "temporal", "boolean", "frequency"))
    warned = insights.column_warnings(profile).select("position", "warnings")
    rows = profile.select(
        "position", column_id(F.col("name")).alias("column_id"), F.col("name").alias("column_name"),
        F.when(F.col("name") != F.col("standard_name"), F.col("standard_name")).alias("standard_name"),
        "kind", "spark_type", (F.col("null_count") > 0).alias("nullable"), "null_pct",
        "distinct_count", as_text["min"].alias("min_value"), as_text["max"].alias("max_value"),
        F.slice("samples", 1, SAMPLE_VALUES).alias("samples"), stats.alias("stats_json"))
    empty = [F.lit(None).cast("string").alias(c) for c in (*COLUMN_FIELDS, *COLUMN_EXTRA)]
    return rows.join(warned, "position").select("*", *empty)


def catalog_snapshot(df: DataFrame, dataset: str, fmt: str = "parquet", file_sha256: str | None = None,
                     profile: DataFrame | None = None, previous: str | None = None) -> DataFrame:
    """A snapshot as one table: level ``dataset`` (one row) and level ``column``."""
    spark = df.sparkSession
    profile = profile if profile is not None else profile_table(df)
    snapshot = str(uuid.uuid4())
    now = datetime.datetime.now(datetime.timezone.utc)
    finger = table_fingerprint(df).first()
    quality = quality_summary(profile).first()
    duplicates = duplicate_row_count(df).first()[0] if _groupable(df) else None
    head = spark.createDataFrame(
        [(dataset, fmt, finger["row_count"], len(df.columns), finger["fingerprint"], file_sha256,
          quality["avg_null_pct"], quality["empty_columns"], quality["constant_columns"], duplicates,
          quality["score"])],
        "dataset string, format string, row_count bigint, column_count int, data_sha256 string, "
        "file_sha256 string, avg_null_pct double, empty_columns bigint, constant_columns bigint, "
        "duplicate_rows bigint, score double")
    top = head.select(F.lit("dataset").alias("level"), "*",
                      *[F.lit(None).cast("string").alias(c) for c in DATASET_FIELDS])
    columns = catalog_columns(profile).withColumn("level", F.lit("column")).withColumn("dataset", F.lit(dataset))
    return (top.unionByName(columns, allowMissingColumns=True)
            .withColumn("snapshot_id", F.lit(snapshot)).withColumn("previous_snapshot_id", F.lit(previous).cast("string"))
            .withColumn("created_at", F.lit(now)))


def _groupable(df: DataFrame) -> bool:
    from pyspark.sql import types as T

    return not any(isinstance(f.dataType, (T.MapType,)) for f in df.schema)


def catalog_append(snapshot: DataFrame, root: str) -> str:
    """Add a snapshot to the catalog table; snapshots are never changed afterwards."""
    snapshot.coalesce(1).write.mode("append").parquet(root)
    return snapshot.select("snapshot_id").first()[0]


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    return spark.read.parquet(root).where(F.col("snapshot_id") == snapshot_id)


def annotate_columns(columns: DataFrame, notes: DataFrame, key: str = "column_name") -> DataFrame:
    """Attach business metadata by column name; given values replace stored ones.

    ``notes`` has at most one row per column of the table, so its size is that of a schema.
    """
    extra = [c for c in notes.columns if c != key]
    marked = notes.select(key, *[F.col(c).alias(f"__{c}") for c in extra])
    joined = columns.join(F.broadcast(marked), key, "left")
    result = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in extra else F.col(c) for c in columns.columns]
    new = [F.col(f"__{c}").alias(c) for c in extra if c not in columns.columns]
    return joined.select(*result, *new)


def catalog_annotate(snapshot: DataFrame, column_notes: Mapping[str, Mapping[str, Any]] | None = None,
                     dataset_notes: Mapping[str, str] | None = None) -> DataFrame:
    """A new snapshot with changed business metadata that points to the one before."""
    spark = snapshot.sparkSession
    previous = snapshot.select("snapshot_id").first()[0]
    unknown = [f for notes in (column_notes or {}).values() for f in notes if f not in (*COLUMN_FIELDS, *COLUMN_EXTRA)]
    unknown += [f for f in (dataset_notes or {}) if f not in DATASET_FIELDS]
    if unknown:
        raise ValueError(f"unknown fields {sorted(set(unknown))}")
    fields = [*COLUMN_FIELDS, *COLUMN_EXTRA]
    result = snapshot
    if column_notes:
        rows = [(name, *[notes.get(f) for f in fields]) for name, notes in column_notes.items()]
        table = spark.createDataFrame(rows, "column_name string, " + ", ".join(f"{f} string" for f in fields))
        result = annotate_columns(result, table)
    for name, value in (dataset_notes or {}).items():
        result = result.withColumn(name, F.when(F.col("level") == "dataset", F.lit(value)).otherwise(F.col(name)))
    return (result.withColumn("previous_snapshot_id", F.lit(previous))
            .withColumn("snapshot_id", F.lit(str(uuid.uuid4())))
            .withColumn("created_at", F.lit(datetime.datetime.now(datetime.timezone.utc))))


def catalog_completeness(snapshot: DataFrame) -> DataFrame:
    """Share of business fields that are filled: 6 of the dataset and 3 of each column."""
    filled = F.lit(0)
    for level, names in (("dataset", DATASET_FIELDS), ("column", COLUMN_FIELDS)):
        number = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
        filled = filled + F.when(F.col("level") == level, number).otherwise(0)
    total = F.when(F.col("level") == "dataset", len(DATASET_FIELDS)).otherwise(len(COLUMN_FIELDS))
    return snapshot.select("snapshot_id", filled.alias("filled"), total.alias("total")).groupBy("snapshot_id").agg(
        F.sum("filled").alias("filled"), F.sum("total").alias("total")).withColumn(
        "completeness", F.coalesce(F.try_divide(F.col("filled") * 100.0, F.col("total")), F.lit(0.0)))


def catalog_undocumented(snapshot: DataFrame) -> DataFrame:
    rows = snapshot.where("level = 'column'")
    for name in COLUMN_FIELDS:
        rows = rows.where(F.col(name).isNull())
    return rows.select("snapshot_id", "column_name")


def catalog_warned(snapshot: DataFrame) -> DataFrame:
    return snapshot.where((F.col("level") == "column") & (F.size("warnings") > 0)).select(
        "snapshot_id", "column_name", "warnings")


def catalog_list(catalog: DataFrame, data_sha256: str | None = None) -> DataFrame:
    """Snapshots, newest first."""
    rows = catalog.where("level = 'dataset'")
    if data_sha256:
        rows = rows.where(F.col("data_sha256") == data_sha256)
    return rows.select("snapshot_id", "previous_snapshot_id", "dataset", "created_at", "row_count",
                       "column_count", "data_sha256", "score").orderBy(F.desc("created_at"), "snapshot_id")
