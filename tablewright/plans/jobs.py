"""Whole jobs: read, clean, write, record."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.clean import Settings, auto_settings, clean
from tablewright.operators.columns import auto_clean_basic, user_transform
from tablewright.operators.profile import profile_table
from tablewright.operators import insights
from tablewright.operators.profile import correlation_matrix, health_score
from tablewright.plans import catalog, manifest
from tablewright.plans.sql import sql_query
from tablewright.sources import files, jdbc


@dataclass
class Analysis:
    """What one look at a table yields."""

    profile: DataFrame
    health: DataFrame
    correlation: DataFrame
    preview: DataFrame


def analyse_table(df: DataFrame, order_by: list[str] | None = None, preview: int = 100) -> Analysis:
    profile = insights.with_insights(profile_table(df, order_by))
    return Analysis(profile, health_score(profile), correlation_matrix(df), df.limit(preview))


def cleaned(df: DataFrame, settings: Settings | str | None, restricted: bool = True) -> DataFrame:
    """``settings`` is a mapping, ``"auto"`` (from the profile), ``"trim"`` or None."""
    if settings is None:
        return df
    if settings == "auto":
        return clean(df, auto_settings(profile_table(df)), restricted)
    if settings == "trim":
        return auto_clean_basic(df)
    return clean(df, settings, restricted)


def job_clean(spark: SparkSession, source: str, target: str, settings: Settings | str | None = "auto",
              restricted: bool = True, overwrite: bool = True) -> str:
    load = files.load_columnar if settings == "auto" else files.load
    return files.save(cleaned(load(spark, source), settings, restricted), target, overwrite=overwrite)


def job_convert(spark: SparkSession, source: str, target: str, settings: Settings | str | None = None,
                overwrite: bool = True) -> str:
    load = files.load_columnar if settings else files.load
    return files.save(cleaned(load(spark, source), settings), target, overwrite=overwrite)


def job_import(spark: SparkSession, source: str, url: str, table: str | None = None,
               schema_name: str | None = None, settings: Settings | str | None = None,
               properties: Mapping[str, str] | None = None) -> None:
    """File to database table; the table is named after the file unless told otherwise."""
    name = table or jdbc.table_name(None, None, source).strip('"')
    jdbc.sink_jdbc(cleaned(files.load(spark, source), settings), url, name, schema_name, properties)


@dataclass
class Export:
    path: str
    snapshot: DataFrame
    manifest: DataFrame


def job_export(df: DataFrame, target: str, query: str | None = None,
               script: Callable[[DataFrame], DataFrame] | None = None,
               settings: Settings | str | None = None, restricted: bool = True,
               overwrite: bool = True, catalog_root: str | None = None) -> Export:
    """Source, optional SQL or user function, cleaning (once), sink, catalog snapshot, manifest."""
    spark = df.sparkSession
    if query:
        df = sql_query(df, query, limit=None)
    if script:
        df = user_transform(df, script)
    result = cleaned(df, settings, restricted)
    path = files.save(result, target, overwrite=overwrite)
    fmt = files.format_of(path, "parquet")
    written = files.load_written(spark, path, fmt, result.schema)
    receipt = manifest.manifest_create(spark, path, fmt, df=written)
    digest = receipt.where("level = 'dataset'").first()["sha256"]
    snapshot = catalog.catalog_snapshot(written, path.rstrip("/").rsplit("/", 1)[-1], fmt, digest)
    if catalog_root:
        catalog.catalog_append(snapshot, catalog_root)
    return Export(path, snapshot, receipt)
