"""SQL over one table, named ``data``, or over several versions of it."""

from __future__ import annotations

import threading
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.clean import Settings, clean
from tablewright.sources import files

PREVIEW_ROWS = 100


_VIEWS = threading.Lock()


def _temporary_view(spark: SparkSession, name: str) -> DataFrame | None:
    try:
        return spark.table(name) if spark.catalog.getTable(name).isTemporary else None
    except AnalysisException:
        return None


def sql_tables(tables: Mapping[str, DataFrame], query: str) -> DataFrame:
    """Run a query in which each name stands for the given table.

    The names are resolved while the query is analysed; right after, views of the caller that have the same names are
    put back, and the others go.  One query is analysed at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    with _VIEWS:
        before = {name: _temporary_view(spark, name) for name in tables}
        try:
            for name, df in tables.items():
                df.createOrReplaceTempView(name)
            return spark.sql(query.strip().rstrip(";"))
        finally:
            for name, view in before.items():
                if view is None:
                    spark.catalog.dropTempView(name)
                else:
                    view.createOrReplaceTempView(name)


def sql_query(df: DataFrame, query: str, limit: int | None = PREVIEW_ROWS) -> DataFrame:
    """Run a query on table ``data``; the first rows only, unless ``limit`` is None."""
    result = sql_tables({"data": df}, query)
    return result if limit is None else result.limit(limit)


def sql_on_cleaned(df: DataFrame, settings: Settings, query: str, limit: int | None = PREVIEW_ROWS,
                   restricted: bool = True) -> DataFrame:
    return sql_query(clean(df, settings, restricted), query, limit)


def sql_export(df: DataFrame, query: str, path: str, fmt: str | None = None, overwrite: bool = True) -> str:
    """Write the whole result; two columns of one name are refused."""
    return files.save(sql_query(df, query, limit=None), path, fmt, overwrite)
