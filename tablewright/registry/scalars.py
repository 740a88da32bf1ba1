"""Queries of the scalar functions."""

from pyspark.sql import functions as F

from tablewright.functions import casts, text
from tablewright.operators import columns as C
from tablewright.operators import prepare
from tablewright.operators.profile import profile_table
from tablewright.registry.core import DIRTY, TRIMMED, dirty, query, table


def _on_raw(fn, source="raw"):
    def run(spark, sf):
        return dirty(spark, sf).select("p_partkey", fn(F.col(source)).alias("result"))
    return run


def _scalar(name, fn, sql, source="raw"):
    query(name, f"WITH {DIRTY} SELECT p_partkey, {sql} AS result FROM dirty")(_on_raw(fn, source))


_scalar("trim_whitespace", text.trim_whitespace, TRIMMED)
_scalar("lower_case", text.lower_case, "lower(raw)")
_scalar("upper_case", text.upper_case, "upper(raw)")
_scalar("remove_special_chars", text.remove_special_chars,
        r"regexp_replace(raw, '[^a-zA-Z0-9\s\x{3000}]', '', 'g')")
_scalar("remove_non_ascii", text.remove_non_ascii, r"regexp_replace(raw, '[^\x00-\x7F]', '', 'g')")
_scalar("regex_replace", lambda c: text.regex_replace(c, r"(\w+) (\w+) #(\d+)", "${3}:$2 $1"),
        r"regexp_replace(raw, '(\w+) (\w+) #(\d+)', '\3:\2 \1', 'g')")
_scalar("extract_numbers", text.extract_numbers,
        r"TRY_CAST(nullif(regexp_extract(raw, '(\d+\.?\d*)', 1), '') AS DOUBLE)")
_scalar("standardise_nulls", text.standardise_nulls,
        "CASE WHEN raw NOT IN ('null', 'NULL', '', 'N/A', 'nan', 'NaN') THEN raw END")
_scalar("cast_boolean_tokens", casts.cast_boolean_tokens,
        "CASE WHEN lower(token) IN ('true', '1', 'yes') THEN true "
        "WHEN lower(token) IN ('false', '0', 'no') THEN false END", source="token")


@query("title_case", """
SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '),
       lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', ' ') AS result FROM part""")
def title_case(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.title_case(F.col("p_name")).alias("result"))


@query("cast_types", f"""
WITH {DIRTY} SELECT p_partkey, CASE WHEN token = '1' THEN CAST(1 AS BIGINT) END AS as_long,
       CASE WHEN token = '1' THEN CAST(1 AS DOUBLE) END AS as_double,
       CAST(p_size AS VARCHAR) AS as_text, CAST(trunc(p_retailprice) AS BIGINT) AS price FROM dirty""")
def cast_types(spark, sf):
    df = dirty(spark, sf).select("p_partkey", F.col("token").alias("as_long"), F.col("token").alias("as_double"),
                                 F.col("p_size").alias("as_text"), F.col("p_retailprice").alias("price"))
    return C.cast_columns(df, {"as_long": "i64", "as_double": "f64", "as_text": "String", "price": "Numeric"})


@query("cast_kind", f"""
WITH {DIRTY} SELECT p_partkey, CAST(p_size AS DOUBLE) AS as_number,
       CASE WHEN p_partkey % 2 = 0 THEN '2024-02-03 04:05:06' END AS as_time,
       CASE WHEN lower(token) IN ('true', '1', 'yes') THEN true
            WHEN lower(token) IN ('false', '0', 'no') THEN false END AS as_flag,
       p_brand AS as_category FROM dirty""")
def cast_kind(spark, sf):
    when = F.when(F.col("p_partkey") % 2 == 0, "2024-02-03 04:05:06").otherwise("some day")
    return dirty(spark, sf).select(
        "p_partkey", casts.cast_kind(F.col("p_size").cast("string"), "Numeric").alias("as_number"),
        F.date_format(casts.cast_kind(when, "Temporal"), "yyyy-MM-dd HH:mm:ss").alias("as_time"),
        casts.cast_kind(F.col("token"), "Boolean").alias("as_flag"),
        casts.cast_kind(F.col("p_brand"), "Categorical").alias("as_category"))


@query("parse_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day,
       CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS other FROM orders""")
def parse_dates(spark, sf):
    o = table(spark, sf, "orders")
    df = o.select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"),
                  F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy/MM/dd"))
                  .otherwise("unknown").alias("other"))
    parsed = C.parse_date_columns(df, {"day": "dd.MM.yyyy", "other": "yyyy/MM/dd"})
    return parsed.select("o_orderkey", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("day", "other")])


@query("to_utc", """
SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM events""")
def to_utc(spark, sf):
    utc = casts.to_utc(F.col("ts").cast("timestamp"), "+02:00")
    return table(spark, sf, "events").select("event_id", F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("round_numeric", "SELECT p_partkey, round(p_retailprice, 1) AS result FROM part")
def round_numeric(spark, sf):
    return table(spark, sf, "part").select("p_partkey", casts.round_numeric(F.col("p_retailprice"), 1).alias("result"))


@query("cap_rare_values", """
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand),
t AS (SELECT CAST(floor(avg(n)) AS BIGINT) AS least FROM c)
SELECT p_partkey, CASE WHEN n >= least THEN c.p_brand ELSE 'Other' END AS p_brand
FROM part JOIN c USING (p_brand) CROSS JOIN t""")
def cap_rare_values(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    n = part.groupBy("p_brand").count().agg(F.floor(F.avg("count"))).first()[0]
    return prepare.cap_rare_values(part, "p_brand", n)


@query("type_compatibility", """
SELECT * FROM (VALUES ('event_id', 'Boolean', true), ('ts', 'Boolean', false), ('user_id', 'Boolean', true),
 ('event_type', 'Boolean', false), ('value', 'Boolean', true), ('props', 'Boolean', false),
 ('event_id', 'Temporal', true), ('ts', 'Temporal', true), ('user_id', 'Temporal', true),
 ('value', 'Temporal', true)) v(name, target, compatible)
UNION ALL SELECT c, 'Temporal', ok FROM (
  SELECT 'event_type' AS c, bool_and(TRY_CAST(event_type AS DOUBLE) IS NOT NULL OR regexp_matches(event_type, '[-/:]')) AS ok FROM events
  UNION ALL
  SELECT 'props', bool_and(TRY_CAST(props AS DOUBLE) IS NOT NULL OR regexp_matches(props, '[-/:]')) FROM events)""")
def type_compatibility(spark, sf):
    events = table(spark, sf, "events")
    profile = profile_table(events)
    both = C.type_compatibility(profile, "Boolean", events).unionByName(C.type_compatibility(profile, "Temporal", events))
    return both.select("name", "target", "compatible")


@query("computed_column", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem""")
def computed_column(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge")
