"""Database source and sink over Spark's JDBC connector."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH_ROWS = 10_000

# Column types of a created table, by Spark type; anything else becomes TEXT.
COLUMN_TYPES = {
    T.ByteType: "BIGINT", T.ShortType: "BIGINT", T.IntegerType: "BIGINT", T.LongType: "BIGINT",
    T.FloatType: "DOUBLE PRECISION", T.DoubleType: "DOUBLE PRECISION",
    T.BooleanType: "BOOLEAN", T.DateType: "DATE",
    T.TimestampType: "TIMESTAMPTZ", T.TimestampNTZType: "TIMESTAMPTZ",
}


def column_type(dtype: T.DataType) -> str:
    return COLUMN_TYPES.get(type(dtype), "TEXT")


def create_table_columns(schema: T.StructType) -> str:
    """Value of the writer option ``createTableColumnTypes``, for the types Spark can parse."""
    return ", ".join(f"`{f.name}` {column_type(f.dataType)}" for f in schema)


def table_name(schema_name: str | None, table: str | None, source: str | None = None) -> str:
    """Quoted ``schema.table``; the table defaults to the stem of the source file."""
    name = table or re.sub(r"\.[^.]*$", "", (source or "data").rstrip("/").rsplit("/", 1)[-1])
    quoted = ['"' + part.replace('"', '""') + '"' for part in (schema_name, name) if part]
    return ".".join(quoted)


def writable(df: DataFrame) -> DataFrame:
    """Columns the target has no type for travel as text."""
    from pyspark.sql import functions as F

    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested)
        else F.col(f"`{f.name}`").cast("string").alias(f.name)
        if column_type(f.dataType) == "TEXT" and not isinstance(f.dataType, T.StringType)
        else F.col(f"`{f.name}`") for f in df.schema])


def writer_options(url: str, table: str, properties: Mapping[str, str] | None = None,
                   partitions: int | None = None) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "batchsize": str(BATCH_ROWS), **dict(properties or {})}
    if partitions:
        options["numPartitions"] = str(partitions)
    return options


def sink_jdbc(df: DataFrame, url: str, table: str, schema_name: str | None = None,
              properties: Mapping[str, str] | None = None, partitions: int | None = None) -> None:
    """Create the table if it is missing and append."""
    target = table_name(schema_name, table)
    (writable(df).write.format("jdbc").mode("append")
     .options(**writer_options(url, target, properties, partitions)).save())


def reader_options(url: str, table: str | None = None, query: str | None = None,
                   partition_column: str | None = None, bounds: tuple | None = None,
                   partitions: int | None = None,
                   properties: Mapping[str, str] | None = None) -> dict[str, str]:
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    options = {"url": url, "fetchsize": str(BATCH_ROWS), **dict(properties or {})}
    if partition_column:
        if not bounds or not partitions:
            raise ValueError("a partitioned read needs bounds and a number of partitions")
        options |= {"dbtable": table or f"({query}) q", "partitionColumn": partition_column,
                    "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
                    "numPartitions": str(partitions)}
    elif table:
        options["dbtable"] = table
    else:
        options["query"] = query
    return options


def source_jdbc(spark: SparkSession, url: str, **how) -> DataFrame:
    """Read a table or query; with a partition column the read is spread over tasks."""
    return spark.read.format("jdbc").options(**reader_options(url, **how)).load()
