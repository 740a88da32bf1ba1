"""Queries of the profile: measures, quantiles, histograms, frequencies, correlation, verdicts."""

from pyspark.sql import functions as F

from tablewright.operators import aggregates as A
from tablewright.operators import profile as P
from tablewright.operators import quantiles as Q
from tablewright.plans.jobs import analyse_table
from tablewright.registry.core import GAPPY, gappy, named, per_column, query, rounded, table

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]
ALL = [*NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
GAPS = ["l_extendedprice", "l_quantity", "l_returnflag"]


def _measure(name, columns, measures, select, digits=(), with_gaps=True, source="lineitem"):
    """A query of plain measures per column, over lineitem (with gaps) or another table."""
    text = per_column(columns, select, "gappy" if with_gaps else source)

    @query(name, f"WITH {GAPPY} {text}" if with_gaps else text)
    def run(spark, sf):
        df = gappy(spark, sf) if with_gaps else table(spark, sf, source)
        result = rounded(named(A.describe_columns(df, columns, measures)), 4, *digits)
        return rounded(result, 1, "sum")
    return run


@query("profile_row_count", "SELECT CAST(count(*) AS BIGINT) AS row_count FROM lineitem")
def profile_row_count(spark, sf):
    return A.row_count(table(spark, sf, "lineitem"))


_measure("profile_null_count", ALL, ["null_count", "null_pct"],
         "CAST(count(*) - count({c}) AS BIGINT) AS null_count, round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct",
         ["null_pct"])


@query("profile_distinct_count", f"WITH {GAPPY} " + per_column(
    ALL, "CAST(count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) AS BIGINT) AS distinct_count, "
         "round((count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER)) / CAST(count(*) AS DOUBLE), 6) AS uniqueness_ratio",
    "gappy"))
def profile_distinct_count(spark, sf):
    df = gappy(spark, sf)
    n = df.count()
    return named(A.distinct_counts(df, ALL)).withColumn("uniqueness_ratio", F.round(F.col("distinct_count") / n, 6))


_measure("profile_min_max", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["min", "max"],
         "min({c}) AS min, max({c}) AS max")
_measure("profile_mean_sum", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"], ["mean", "sum"],
         "round(avg({c}), 4) AS mean, round(sum(CAST({c} AS DOUBLE)), 1) AS sum", ["mean"])
_measure("profile_stddev", NUMBERS, ["stddev"], "round(stddev_samp({c}), 4) AS stddev", ["stddev"])
_measure("profile_zero_count", NUMBERS, ["zero_count"], "CAST(count(*) FILTER (WHERE {c} = 0) AS BIGINT) AS zero_count")
_measure("profile_negative_count", ["c_acctbal", "c_custkey", "c_nationkey"], ["negative_count"],
         "CAST(count(*) FILTER (WHERE {c} < 0) AS BIGINT) AS negative_count", with_gaps=False, source="customer")
_measure("profile_is_integer", NUMBERS, ["is_integer"], "bool_and({c} = floor({c})) AS is_integer")
_measure("profile_text_lengths", ["text", "lang", "source"], ["min_length", "max_length", "avg_length"],
         "CAST(min(length({c})) AS BIGINT) AS min_length, CAST(max(length({c})) AS BIGINT) AS max_length, "
         "round(avg(length({c})), 4) AS avg_length", ["avg_length"], with_gaps=False, source="documents")


def _quantile_rows(spark, df, requests):
    found = Q.exact_quantiles(df, requests)
    return [(c, p, v) for c, ps in found.items() for p, v in ps.items()]


@query("profile_median", f"WITH {GAPPY} " + per_column(NUMBERS, "round(median({c}), 4) AS median", "gappy"))
def profile_median(spark, sf):
    rows = _quantile_rows(spark, gappy(spark, sf), {c: [0.5] for c in NUMBERS})
    return spark.createDataFrame([(c, round(v, 4)) for c, _, v in rows], "column_name string, median double")


@query("profile_quantiles", f"WITH {GAPPY} " + per_column(
    NUMBERS, ", ".join(f"round(quantile_cont({{c}}, {p}), 4) AS {n}" for n, p in
                       (("p05", 0.05), ("q1", 0.25), ("q3", 0.75), ("p95", 0.95))), "gappy"))
def profile_quantiles(spark, sf):
    shares = {"p05": 0.05, "q1": 0.25, "q3": 0.75, "p95": 0.95}
    found = Q.exact_quantiles(gappy(spark, sf), {c: list(shares.values()) for c in NUMBERS})
    rows = spark.createDataFrame([(c, *[ps[p] for p in shares.values()]) for c, ps in found.items()],
                                 "column_name string, " + ", ".join(f"{n} double" for n in shares))
    return rounded(rows, 4, *shares)


NUMERIC_PARTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"]


@query("profile_skew", f"""
WITH {GAPPY}, s AS ({per_column(NUMERIC_PARTS, "avg({c}) AS m, median({c}) AS med, quantile_cont({c}, 0.25) AS q1, "
                                "quantile_cont({c}, 0.75) AS q3, stddev_samp({c}) AS sd", "gappy")})
SELECT column_name, round(CASE WHEN sd > 0 AND q3 > q1 THEN (3 * (m - med) / sd + (q3 + q1 - 2 * med) / (q3 - q1)) / 2
       WHEN sd > 0 THEN 3 * (m - med) / sd END, 6) AS skew FROM s""")
def profile_skew(spark, sf):
    profile = P.profile_table(gappy(spark, sf).select(*NUMERIC_PARTS))
    return profile.select(F.col("name").alias("column_name"), F.round("numeric.skew", 6).alias("skew"))


@query("profile_trimmed_mean", f"WITH {GAPPY} " + " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(avg(v), 4) AS trimmed_mean FROM (
    SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM gappy WHERE {c} IS NOT NULL)
WHERE r > floor(n * 0.05) AND r <= n - floor(n * 0.05)""" for c in NUMERIC_PARTS))
def profile_trimmed_mean(spark, sf):
    found = Q.trimmed_means(gappy(spark, sf), NUMERIC_PARTS, 0.05)
    return spark.createDataFrame([(c, round(v, 4)) for c, v in found.items()],
                                 "column_name string, trimmed_mean double")


BINNED = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query("profile_histogram", f"""
WITH {GAPPY}, s AS ({per_column(BINNED, "min({c}) AS lo, max({c}) AS hi, quantile_cont({c}, 0.25) AS q1, "
                                "quantile_cont({c}, 0.75) AS q3, count({c}) AS n", "gappy")}),
b AS (SELECT column_name, lo, CAST(least(50, greatest(5, ceil((hi - lo) /
        CASE WHEN q3 > q1 THEN 2 * (q3 - q1) / cbrt(n) ELSE (hi - lo) / sqrt(n) END))) AS INTEGER) AS bins, hi FROM s),
w AS (SELECT column_name, lo, bins, (hi - lo) / bins AS width FROM b),
v AS ({per_column(BINNED, "CAST({c} AS DOUBLE) AS v", "gappy")}),
c AS (SELECT column_name, CAST(least(floor((v - lo) / width), bins - 1) AS INTEGER) AS bin, count(*) AS n
      FROM v JOIN w USING (column_name) WHERE v IS NOT NULL GROUP BY 1, 2),
f AS (SELECT column_name, CAST(unnest(range(bins)) AS INTEGER) AS bin, lo, width FROM w)
SELECT column_name, bin, round(lo + bin * width, 4) AS bin_start, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM f LEFT JOIN c USING (column_name, bin)""")
def profile_histogram(spark, sf):
    return rounded(named(P.histogram(gappy(spark, sf), BINNED)), 4, "bin_start")


@query("profile_histogram_constant", """
SELECT CAST(range AS INTEGER) AS bin, CAST(7.0 - 10 + range AS DOUBLE) AS bin_start,
       CAST(CASE WHEN range = 10 THEN (SELECT count(*) FROM lineitem WHERE l_orderkey % 7 <> 0) ELSE 0 END AS BIGINT) AS n
FROM range(20)""")
def profile_histogram_constant(spark, sf):
    same = gappy(spark, sf).select(F.when(F.col("l_extendedprice").isNotNull(), 7.0).alias("same"))
    return P.histogram(same, ["same"]).drop("column")


@query("profile_effective_boolean", """
SELECT 'quality' AS column_name, 'Boolean' AS kind, CAST(sum(quality) AS BIGINT) AS true_count,
       CAST(count(*) - sum(quality) AS BIGINT) AS false_count FROM labels
UNION ALL SELECT 'toxic_or_null', 'Boolean', CAST(sum(toxic) FILTER (WHERE doc_id % 5 <> 0) AS BIGINT),
       CAST(count(*) FILTER (WHERE doc_id % 5 <> 0 AND toxic = 0) AS BIGINT) FROM labels
UNION ALL SELECT 'doc_id', 'Numeric', NULL, NULL""")
def profile_effective_boolean(spark, sf):
    df = table(spark, sf, "labels").select(
        "doc_id", "quality", F.when(F.col("doc_id") % 5 != 0, F.col("toxic")).alias("toxic_or_null"))
    return P.profile_table(df).select(F.col("name").alias("column_name"), "kind", "boolean.true_count", "boolean.false_count")


FLAGS = ["is_view", "is_large"]


@query("profile_boolean", per_column(
    FLAGS, "CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS true_count, CAST(count(*) FILTER (WHERE NOT {c}) AS BIGINT) AS false_count, "
           "CAST(count(*) - count({c}) AS BIGINT) AS null_count",
    "(SELECT event_type = 'view' AS is_view, CASE WHEN user_id % 4 <> 0 THEN value > 50 END AS is_large FROM events)"))
def profile_boolean(spark, sf):
    df = table(spark, sf, "events").select(
        (F.col("event_type") == "view").alias("is_view"), F.when(F.col("user_id") % 4 != 0, F.col("value") > 50).alias("is_large"))
    return named(A.describe_columns(df, FLAGS, ["true_count", "false_count", "null_count"]))


@query("profile_categorical_routing", per_column(
    ["text", "lang", "source"],
    "CASE WHEN count(DISTINCT {c}) < 100 OR count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) < 0.05 "
    "THEN 'Categorical' ELSE 'Text' END AS kind, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count", "documents"))
def profile_categorical_routing(spark, sf):
    profile = P.profile_table(table(spark, sf, "documents").select("text", "lang", "source"))
    return profile.select(F.col("name").alias("column_name"), "kind", "distinct_count")


@query("profile_value_frequency", f"WITH {GAPPY} " + " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n,
       CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank
FROM gappy WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 1000"""
                                                                   for c in ("l_returnflag", "l_linestatus", "l_partkey")))
def profile_value_frequency(spark, sf):
    return named(A.value_frequency(gappy(spark, sf), ["l_returnflag", "l_linestatus", "l_partkey"]))


@query("profile_top_value", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{c}' AS column_name, {c} AS top_value, CAST(count(*) AS BIGINT) AS top_count FROM {t}
GROUP BY {c} ORDER BY top_count DESC, {c} LIMIT 1)""" for c, t in (
    ("text", "documents"), ("lang", "documents"), ("source", "documents"))))
def profile_top_value(spark, sf):
    counts = A.value_counts(table(spark, sf, "documents"), ["text", "lang", "source"])
    return named(A.frequency_summary(counts).select("column", "top_value", "top_count"))


@query("profile_special_chars", """
SELECT 'text' AS column_name, bool_or(contains(text, chr(13))) AS has_special FROM documents
UNION ALL SELECT 'lang', bool_or(contains(lang, chr(13))) FROM documents
UNION ALL SELECT 'marked', bool_or(lang = 'en') FROM documents""")
def profile_special_chars(spark, sf):
    df = table(spark, sf, "documents").withColumn(
        "marked", F.concat("lang", F.when(F.col("lang") == "en", "\r").otherwise("")))
    return named(A.describe_columns(df, ["text", "lang", "marked"], ["has_special"]))


@query("profile_control_chars", r"""
SELECT 'text' AS column_name, bool_or(regexp_matches(text, '[\x00-\x08\x0A-\x1F\x7F\x{FFFD}]')) AS has_control FROM documents
UNION ALL SELECT 'lang', bool_or(regexp_matches(lang, '[\x00-\x08\x0A-\x1F\x7F\x{FFFD}]')) FROM documents
UNION ALL SELECT 'html', bool_or(regexp_matches(html, '[\x00-\x08\x0A-\x1F\x7F\x{FFFD}]')) FROM pages
UNION ALL SELECT 'url', bool_or(regexp_matches(url, '[\x00-\x08\x0A-\x1F\x7F\x{FFFD}]')) FROM pages""")
def profile_control_chars(spark, sf):
    return named(A.describe_columns(table(spark, sf, "documents"), ["text", "lang"], ["has_control"]).unionByName(
        A.describe_columns(table(spark, sf, "pages"), ["html", "url"], ["has_control"])))


@query("profile_temporal", """
SELECT 'ts' AS column_name, 'Temporal' AS kind, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_time,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_time, CAST(count(DISTINCT ts) AS BIGINT) AS distinct_count,
       (SELECT bool_and(coalesce(p <= ts, true)) FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events)) AS is_sorted,
       false AS is_sorted_desc FROM events""")
def profile_temporal(spark, sf):
    profile = P.profile_table(table(spark, sf, "events").select("event_id", "ts"), order_by=["event_id"])
    return profile.where("kind = 'Temporal'").select(
        F.col("name").alias("column_name"), "kind",
        F.date_format("temporal.min", "yyyy-MM-dd HH:mm:ss").alias("first_time"),
        F.date_format("temporal.max", "yyyy-MM-dd HH:mm:ss").alias("last_time"),
        "distinct_count", "is_sorted", "is_sorted_desc")


@query("profile_timeline", """
WITH s AS (SELECT CAST(epoch_us(min(o_orderdate)) AS DOUBLE) AS lo, CAST(epoch_us(max(o_orderdate)) AS DOUBLE) AS hi FROM orders),
c AS (SELECT CAST(least(floor((epoch_us(o_orderdate) - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n
      FROM orders CROSS JOIN s GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, round(lo + range * ((hi - lo) / 20), 0) AS bin_start, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM range(20) CROSS JOIN s LEFT JOIN c ON c.bin = range""")
def profile_timeline(spark, sf):
    return rounded(P.timeline(table(spark, sf, "orders"), ["o_orderdate"]).drop("column"), 0, "bin_start")


@query("profile_samples", """
SELECT 'event_id' AS column_name, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY event_id) AS samples
FROM (SELECT * FROM events ORDER BY event_id LIMIT 10)
UNION ALL SELECT 'event_type', string_agg(event_type, '|' ORDER BY event_id) FROM (SELECT * FROM events ORDER BY event_id LIMIT 10)
UNION ALL SELECT 'props', string_agg(props, '|' ORDER BY event_id) FROM (
    SELECT * FROM (SELECT * FROM events ORDER BY event_id LIMIT 100) WHERE user_id % 2 = 0 ORDER BY event_id LIMIT 10)""")
def profile_samples(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("user_id") % 2 == 0, F.col("props")).alias("props"))
    return P.profile_table(df, order_by=["event_id"]).select(
        F.col("name").alias("column_name"), F.array_join("samples", "|").alias("samples"))


@query("correlation_matrix", f"WITH {GAPPY} " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_i, '{b}' AS col_j, " + ("1.0 AS r" if a == b else f"round(coalesce(corr({a}, {b}), 0), 6) AS r FROM gappy")
    for a in NUMBERS for b in NUMBERS))
def correlation_matrix(spark, sf):
    return rounded(P.correlation_matrix(gappy(spark, sf).select(*NUMBERS)), 6, "r")


HEALTH_SQL = f"""
WITH {GAPPY}, g AS (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN l_shipdate END AS seldom,
                           l_linestatus || CASE WHEN l_linenumber = 1 THEN chr(13) ELSE '' END AS marked,
                           l_quantity * l_quantity * l_quantity * l_quantity AS steep FROM gappy),
s AS ({per_column(["l_extendedprice", "l_quantity", "l_tax", "steep"],
                  "100.0 * (count(*) - count({c})) / count(*) AS pct, CASE WHEN max({c}) > min({c}) AND "
                  "abs(avg({c}) - median({c})) / (max({c}) - min({c})) > 0.1 THEN 5 ELSE 0 END AS skewed, 0 AS special", "g")}
      UNION ALL {per_column(["l_returnflag", "seldom"], "100.0 * (count(*) - count({c})) / count(*), 0, 0", "g")}
      UNION ALL SELECT 'marked', 0, 0, CASE WHEN bool_or(contains(marked, chr(13))) THEN 5 ELSE 0 END FROM g)"""


def _health_profile(spark, sf):
    df = gappy(spark, sf).select(
        "l_extendedprice", "l_quantity", "l_tax",
        (F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity")).alias("steep"),
        "l_returnflag", F.when(F.col("l_orderkey") % 5 == 0, F.col("l_shipdate")).alias("seldom"),
        F.concat("l_linestatus", F.when(F.col("l_linenumber") == 1, "\r").otherwise("")).alias("marked"))
    return P.profile_table(df)


@query("health_score", HEALTH_SQL + """
SELECT round(greatest(0, 100 - sum(CASE WHEN pct > 15 THEN 10 WHEN pct > 5 THEN 5 ELSE 0 END + skewed + special)) / 100.0, 4) AS score,
       CAST(sum(CAST(pct > 15 AS INTEGER) + CAST(skewed > 0 AS INTEGER) + CAST(special > 0 AS INTEGER)) AS BIGINT) AS risks FROM s""")
def health_score(spark, sf):
    return P.health_score(_health_profile(spark, sf)).select(
        F.round("score", 4).alias("score"), F.size("risks").cast("bigint").alias("risks"))


@query("quality_summary", HEALTH_SQL + """
SELECT round(avg(pct), 4) AS avg_null_pct, CAST(0 AS BIGINT) AS empty_columns, CAST(0 AS BIGINT) AS constant_columns,
       round(greatest(0, 100 - sum(CASE WHEN pct > 15 THEN 10 WHEN pct > 5 THEN 5 ELSE 0 END + skewed + special)), 4) AS score FROM s""")
def quality_summary(spark, sf):
    return rounded(P.quality_summary(_health_profile(spark, sf)), 4, "avg_null_pct", "score").withColumn(
        "score", F.col("score").cast("double"))


@query("duplicate_row_count", """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, n_chars // 100 FROM documents)) AS BIGINT) AS duplicate_rows
FROM documents""")
def duplicate_row_count(spark, sf):
    return A.duplicate_row_count(table(spark, sf, "documents").selectExpr("lang", "source", "n_chars div 100 AS size"))


@query("duplicate_key_count", """
SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS distinct_count,
       CAST(count(*) - count(DISTINCT l_orderkey) AS BIGINT) AS duplicate_keys FROM lineitem""")
def duplicate_key_count(spark, sf):
    return A.duplicate_key_count(table(spark, sf, "lineitem"), "l_orderkey")


@query("mean_shift", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean_old, round(avg({n}), 4) AS mean_new,
       round((avg({n}) - avg({c})) / avg({c}) * 100, 4) AS change_pct, round(median({c}), 4) AS median_old,
       round(median({n}), 4) AS median_new, round(stddev_samp({c}), 4) AS stddev_old, round(stddev_samp({n}), 4) AS stddev_new
FROM lineitem""" for c, n in (("l_quantity", "l_quantity * 1.5"), ("l_tax", "l_tax"),
                              ("l_extendedprice", "(CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END)"))))
def mean_shift(spark, sf):
    from tablewright.operators.diff import mean_shift as shift
    old = table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_extendedprice")
    new = table(spark, sf, "lineitem").select(
        (F.col("l_quantity") * 1.5).alias("l_quantity"), "l_tax",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("l_extendedprice"))
    result = named(shift(old, new))
    return rounded(result, 4, *[c for c in result.columns if c != "column_name"])


@query("table_fingerprint", """
SELECT CAST(count(*) AS BIGINT) AS row_count, true AS same_after_reordering, false AS same_after_edit FROM orders""")
def table_fingerprint(spark, sf):
    """The digest holds for any order of the rows and changes with a single value."""
    o = table(spark, sf, "orders")
    first = o.agg(F.min("o_orderkey")).first()[0]
    edited = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == first, F.col("o_totalprice") + 0.01)
                          .otherwise(F.col("o_totalprice")))
    plain, mixed, other = (A.table_fingerprint(df) for df in (o, o.orderBy("o_totalprice"), edited))
    digests = [d.select(F.lit(label).alias("which"), "fingerprint", "row_count")
               for label, d in (("plain", plain), ("mixed", mixed), ("edited", other))]
    pick = {w: F.max(F.when(F.col("which") == w, F.col("fingerprint"))) for w in ("plain", "mixed", "edited")}
    return A.union_all(digests).agg(
        F.max("row_count").alias("row_count"), (pick["plain"] == pick["mixed"]).alias("same_after_reordering"),
        (pick["plain"] == pick["edited"]).alias("same_after_edit"))


def _flat_sql(source: str) -> str:
    numbers = per_column(NUMBERS, """CASE WHEN count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) <= 3
        AND min({c}) >= 0 AND max({c}) <= 1 THEN 'Boolean' ELSE 'Numeric' END AS kind,
        CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count,
        CAST(count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) AS BIGINT) AS distinct_count,
        CAST(min({c}) AS DOUBLE) AS num_min, CAST(max({c}) AS DOUBLE) AS num_max, round(avg({c}), 4) AS num_mean,
        round(median({c}), 4) AS num_median, round(stddev_samp({c}), 4) AS num_stddev,
        round(quantile_cont({c}, 0.05), 4) AS num_p05, round(quantile_cont({c}, 0.95), 4) AS num_p95,
        CAST(count(*) FILTER (WHERE {c} = 0) AS BIGINT) AS zero_count, bool_and({c} = floor({c})) AS is_integer,
        CAST(NULL AS VARCHAR) AS top_value, CAST(NULL AS VARCHAR) AS first_time""", source)
    texts = per_column(["l_returnflag", "l_linestatus"], """'Categorical', CAST(count(*) AS BIGINT),
        CAST(count(*) - count({c}) AS BIGINT), CAST(count(DISTINCT {c}) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        NULL, NULL, (SELECT {c} FROM """ + source + """ WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), NULL""", source)
    times = per_column(["l_shipdate"], """'Temporal', CAST(count(*) AS BIGINT), CAST(count(*) - count({c}) AS BIGINT),
        CAST(count(DISTINCT {c}) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        strftime(min({c}), '%Y-%m-%d %H:%M:%S')""", source)
    return f"{numbers} UNION ALL {texts} UNION ALL {times}"


def _flat(profile):
    return P.flat_profile(profile).select(
        F.col("name").alias("column_name"), "kind", "row_count", "null_count", "distinct_count", "num_min", "num_max",
        "num_mean", "num_median", "num_stddev", "num_p05", "num_p95", "zero_count", "is_integer",
        F.when(F.col("kind") == "Categorical", F.col("top_value")).alias("top_value"),
        F.date_format("first_time", "yyyy-MM-dd HH:mm:ss").alias("first_time"))


@query("profile_table", f"WITH {GAPPY} {_flat_sql('gappy')}")
def profile_table(spark, sf):
    return _flat(P.profile_table(gappy(spark, sf)))


@query("analyse_table", f"""
WITH p AS ({_flat_sql('lineitem')})
SELECT column_name, kind, distinct_count, num_mean, num_median, CAST(1.0 AS DOUBLE) AS health,
       (SELECT round(corr(l_quantity, l_extendedprice), 6) FROM lineitem) AS quantity_price, CAST(100 AS BIGINT) AS preview_rows FROM p""")
def analyse_table_query(spark, sf):
    found = analyse_table(table(spark, sf, "lineitem"))
    health = found.health.first()["score"]
    r = found.correlation.where("col_i = 'l_quantity' AND col_j = 'l_extendedprice'").first()["r"]
    return _flat(found.profile).select(
        "column_name", "kind", "distinct_count", "num_mean", "num_median", F.lit(float(health)).alias("health"),
        F.round(F.lit(r), 6).alias("quantity_price"), F.lit(found.preview.count()).cast("bigint").alias("preview_rows"))
