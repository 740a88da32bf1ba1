"""Registry of queries and their equivalents in plain SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- tables with gaps and dirt

def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing prices, quantities and flags."""
    li = table(spark, sf_dir, "lineitem")
    return (li.withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")))
            .withColumn("l_quantity", F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity")))
            .withColumn("l_returnflag", F.when(F.col("l_suppkey") % 13 != 0, F.col("l_returnflag"))))


GAPPY = """gappy AS (
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_linestatus, l_shipdate,
           CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS l_extendedprice,
           CASE WHEN l_partkey % 11 <> 0 THEN l_quantity END AS l_quantity,
           CASE WHEN l_suppkey % 13 <> 0 THEN l_returnflag END AS l_returnflag
    FROM lineitem)"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with blanks of several kinds, symbols, letters beyond ASCII and words for null."""
    p = table(spark, sf_dir, "part")
    raw = (F.when(F.col("p_partkey") % 11 == 0, "N/A").when(F.col("p_partkey") % 13 == 0, "")
           .when(F.col("p_partkey") % 17 == 0, F.col("p_name"))
           .otherwise(F.concat(F.lit("　  "), F.col("p_name"), F.lit(" #"), F.col("p_size").cast("string"),
                               F.lit(".5 - é\t"))))
    token = (F.when(F.col("p_size") % 5 == 0, "YES").when(F.col("p_size") % 5 == 1, "no")
             .when(F.col("p_size") % 5 == 2, "1").when(F.col("p_size") % 5 == 3, "maybe"))
    return p.select("p_partkey", raw.alias("raw"), token.alias("token"), "p_size", "p_brand", "p_type",
                    "p_retailprice")


DIRTY = """dirty AS (
    SELECT p_partkey, p_size, p_brand, p_type, p_retailprice,
           CASE WHEN p_partkey % 11 = 0 THEN 'N/A' WHEN p_partkey % 13 = 0 THEN ''
                WHEN p_partkey % 17 = 0 THEN p_name
                ELSE concat(chr(12288), '  ', p_name, ' #', CAST(p_size AS VARCHAR), '.5 - ', chr(233), chr(9)) END AS raw,
           CASE p_size % 5 WHEN 0 THEN 'YES' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' END AS token
    FROM part)"""

TRIMMED = r"regexp_replace(raw, '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g')"


def per_column(columns: Iterable[str], select: str, source: str) -> str:
    """One SELECT per column, put together; ``{c}`` stands for the column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {select.replace('{c}', c)} FROM {source}"
                              for c in columns)


def named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("column", "column_name")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def stamp(column: str) -> Column:
    """A time as text, the same whatever the zone of the session."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
