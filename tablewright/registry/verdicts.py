"""Queries of findings, advice, automatic settings and validation rules."""

from pyspark.sql import functions as F

from tablewright.operators import clean as K
from tablewright.operators import insights as I
from tablewright.operators import rules as R
from tablewright.operators.profile import profile_table
from tablewright.registry.core import GAPPY, gappy, per_column, query, table

NUMBERS = ["event_id", "user_id", "value", "holed", "mixed", "same"]

EVENTS = """e AS (
    SELECT event_id, user_id, value, CASE WHEN event_id % 4 <> 0 THEN value END AS holed,
           CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE -value END AS mixed, CAST(5 AS DOUBLE) AS same,
           event_type, props, ts, ts + CASE WHEN user_id % 2 = 0 THEN INTERVAL 400 DAY ELSE INTERVAL 0 DAY END AS jumping,
           value > 1000000 AS never, user_id % 2 = 0 AS even FROM events)"""


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "user_id", "value", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("holed"),
        F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(-F.col("value")).alias("mixed"), F.lit(5.0).alias("same"),
        "event_type", "props", "ts",
        F.expr("CASE WHEN user_id % 2 = 0 THEN ts + INTERVAL 400 DAYS ELSE ts END").alias("jumping"),
        (F.col("value") > 1000000).alias("never"), (F.col("user_id") % 2 == 0).alias("even"))


STATS = f"""{EVENTS}, s AS ({per_column(NUMBERS, '''
    CAST(count(*) AS DOUBLE) AS rows_all, count(*) - count({c}) AS nulls, 100.0 * (count(*) - count({c})) / count(*) AS pct,
    count({c}) AS n, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, avg({c}) AS mean, median({c}) AS med,
    stddev_samp({c}) AS sd, quantile_cont({c}, 0.05) AS p05, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
    quantile_cont({c}, 0.95) AS p95, count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negs,
    bool_and({c} = floor({c})) AS whole, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS INTEGER) AS dist,
    (SELECT bool_and(coalesce(p <= v, true)) FROM (SELECT {c} AS v, lag({c}) OVER (ORDER BY event_id) AS p FROM e WHERE {c} IS NOT NULL)) AS up,
    (SELECT bool_and(coalesce(p >= v, true)) FROM (SELECT {c} AS v, lag({c}) OVER (ORDER BY event_id) AS p FROM e WHERE {c} IS NOT NULL)) AS down''', 'e')}),
k AS (SELECT *, CASE WHEN sd > 0 AND q3 > q1 THEN (3 * (mean - med) / sd + (q3 + q1 - 2 * med) / (q3 - q1)) / 2
                     WHEN sd > 0 THEN 3 * (mean - med) / sd END AS skew FROM s)"""

BINS = f"""b AS (SELECT column_name, lo, hi, CASE WHEN hi = lo THEN 20 ELSE CAST(least(50, greatest(5, ceil((hi - lo) /
        CASE WHEN q3 > q1 THEN 2 * (q3 - q1) / cbrt(n) ELSE (hi - lo) / sqrt(n) END))) AS INTEGER) END AS bins FROM s),
w AS (SELECT column_name, lo, hi, bins, CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / bins END AS width FROM b),
v AS ({per_column(NUMBERS, "CAST({c} AS DOUBLE) AS v", "e")}),
c AS (SELECT column_name, CASE WHEN hi = lo THEN 10 ELSE CAST(least(floor((v - lo) / width), bins - 1) AS INTEGER) END AS bin,
             count(*) AS n FROM v JOIN w USING (column_name) WHERE v IS NOT NULL GROUP BY 1, 2),
f AS (SELECT column_name, CAST(unnest(range(bins)) AS INTEGER) AS bin, bins, width FROM w),
h AS (SELECT column_name, bin, bins, width, coalesce(n, 0) AS n,
             lag(coalesce(n, 0)) OVER (PARTITION BY column_name ORDER BY bin) AS before,
             lead(coalesce(n, 0)) OVER (PARTITION BY column_name ORDER BY bin) AS after
      FROM f LEFT JOIN c USING (column_name, bin)),
x AS (SELECT column_name, max(n) AS peak, sum(n) AS total, any_value(bins) AS bins, any_value(width) AS width,
             bool_or(n = 0 AND bin > 0 AND bin < bins - 1) AS hollow,
             min(n) FILTER (WHERE n > 0) AS least_n,
             count(*) FILTER (WHERE n > before AND n > after AND n > 1.2 * (before + n + after) / 3.0) AS peaks FROM h GROUP BY 1),
y AS (SELECT * FROM k JOIN x USING (column_name))"""


def _cases(source: str, **codes: str) -> str:
    return " UNION ALL ".join(f"SELECT column_name, '{code}' AS code FROM {source} WHERE {when}"
                              for code, when in codes.items())


def _found(spark, sf, columns, *groups):
    df = _events(spark, sf).select("event_id", *[c for c in columns if c != "event_id"])
    found = I.insights(profile_table(df, order_by=["event_id"]), *groups)
    return found.where(F.col("name").isin(list(columns))).select(F.col("name").alias("column_name"), "code")


@query("insight_missing", f"WITH {STATS} " + _cases(
    "k", complete="nulls = 0", missing_much="nulls > 0 AND pct > 15", missing_some="nulls > 0 AND pct > 5 AND pct <= 15"))
def insight_missing(spark, sf):
    return _found(spark, sf, NUMBERS, "missing")


@query("insight_numeric", f"WITH {STATS} " + _cases(
    "k", constant="hi = lo", ascending="up", descending="NOT up AND down", whole_numbers="whole", has_zeros="zeros > 0",
    many_zeros="zeros > 0 AND zeros / CAST(n AS DOUBLE) > 0.3", has_negatives="negs > 0",
    outliers="lo < q1 - 1.5 * (q3 - q1) OR hi > q3 + 1.5 * (q3 - q1)"))
def insight_numeric(spark, sf):
    return _found(spark, sf, NUMBERS, "numeric")


_SYM = "(CASE WHEN skew IS NOT NULL THEN abs(skew) < 0.5 ELSE abs(mean - med) / greatest(q3 - q1, coalesce(sd, 0) * 0.1, 1e-9) < 0.5 END)"
_RIGHT = "(CASE WHEN skew IS NOT NULL THEN skew > 0 ELSE mean > med END)"


@query("insight_distribution", f"WITH {STATS} " + _cases(
    "k", symmetric=_SYM, right_skewed=f"NOT {_SYM} AND {_RIGHT}", left_skewed=f"NOT {_SYM} AND NOT {_RIGHT}",
    mean_median_gap="abs(med) > 1e-9 AND abs(mean - med) / abs(med) > 0.1",
    unreliable_deviation="sd > 0 AND abs(mean - med) / sd > 0.3",
    high_variation="sd > 0 AND abs(mean) > 1e-9 AND sd / abs(mean) > 1",
    low_variation="sd > 0 AND abs(mean) > 1e-9 AND sd / abs(mean) < 0.1"))
def insight_distribution(spark, sf):
    return _found(spark, sf, NUMBERS, "distribution")


@query("insight_histogram", f"WITH {STATS}, {BINS} " + _cases(
    "y", clustered="hi > lo AND (q3 - q1) / (hi - lo) < 0.1", spread_out="hi > lo AND (q3 - q1) / (hi - lo) > 0.6",
    gaps="hi > lo AND hollow", fine_grained="hi > lo AND bins > 40",
    stretched="hi > lo AND p95 > p05 AND hi - lo > 3 * (p95 - p05)",
    tiny_bars="hi > lo AND least_n < peak * 0.005", one_bin="hi > lo AND peak / CAST(total AS DOUBLE) > 0.9",
    steeper_than_normal="sd > 0 AND peak > 1.5 * total * width / (sd * sqrt(2 * pi()))",
    flatter_than_normal="sd > 0 AND peak < total * width / (sd * sqrt(2 * pi())) / 1.5",
    several_peaks="bins > 5 AND peaks >= 2"))
def insight_histogram(spark, sf):
    return _found(spark, sf, NUMBERS, "histogram")


def _cat_sql(cols_tables):
    return " UNION ALL ".join(f"""SELECT '{name}' AS column_name, count(*) AS k, sum(n) AS total, max(n) AS most, min(n) AS least_n
    FROM (SELECT count(*) AS n FROM (SELECT {expr} AS v FROM {src}) WHERE v IS NOT NULL GROUP BY v)""" for name, expr, src in cols_tables)


@query("insight_categorical", f"""WITH {EVENTS}, c AS ({_cat_sql([
    ('event_type', 'event_type', 'e'), ('props', 'props', 'e'), ('one', "'x'", 'e'),
    ('two', "CASE WHEN user_id = 1 THEN 'a' ELSE 'b' END", 'e')])}) """ + _cases(
    "c", constant="k = 1", unique="most = 1 AND k > 1", category="NOT (most = 1 AND k > 1)", two_values="k = 2",
    uneven="k > 1 AND most / CAST(least_n AS DOUBLE) > 5", mostly_unique="k / CAST(total AS DOUBLE) > 0.5",
    many_values="k / CAST(total AS DOUBLE) <= 0.5 AND k > 100"))
def insight_categorical(spark, sf):
    df = _events(spark, sf).select("event_type", "props", F.lit("x").alias("one"),
                                   F.when(F.col("user_id") == 1, "a").otherwise("b").alias("two"))
    return I.insights(profile_table(df), "categorical").select(F.col("name").alias("column_name"), "code")


_TIME = """t AS (
    SELECT 'ts' AS column_name, CAST(epoch_us(ts) AS DOUBLE) AS v FROM e UNION ALL SELECT 'jumping', CAST(epoch_us(jumping) AS DOUBLE) FROM e),
r AS (SELECT column_name, min(v) AS lo, (max(v) - min(v)) / 20 AS width, count(DISTINCT v) AS dist FROM t GROUP BY 1),
g AS (SELECT DISTINCT column_name, least(floor((v - lo) / width), 19) AS bin, width, dist FROM t JOIN r USING (column_name)),
d AS (SELECT column_name, width, dist, (bin - lag(bin) OVER (PARTITION BY column_name ORDER BY bin)) * width AS step FROM g),
z AS (SELECT column_name, any_value(width) AS width, any_value(dist) AS dist, count(*) AS filled, max(step) AS longest,
             avg(step) AS mean_step, var_pop(step) AS var_step FROM d GROUP BY 1)"""


@query("insight_temporal", f"WITH {EVENTS}, {_TIME} " + _cases(
    "z", time_sequence="true", chronological="column_name = 'ts'", time_gaps="longest > 2.5 * width",
    regular="dist > 10 AND filled > 2 AND var_step < (0.1 * mean_step) * (0.1 * mean_step)"))
def insight_temporal(spark, sf):
    return _found(spark, sf, ["ts", "jumping"], "temporal")


@query("insight_text", """
WITH d AS (SELECT 'text' AS column_name, count(DISTINCT text) AS k, count(*) AS n, min(length(text)) AS a, max(length(text)) AS b FROM documents
           UNION ALL SELECT 'code', count(*), count(*), 8, 8 FROM documents)
""" + _cases("d", constant="k = 1", unique="k = n", free_text="k <> n", fixed_length="a = b AND a > 0"))
def insight_text(spark, sf):
    df = table(spark, sf, "documents").select("text", F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("code"))
    return I.insights(profile_table(df), "text").select(F.col("name").alias("column_name"), "code")


@query("insight_boolean", f"""WITH {EVENTS}, d AS ({per_column(["never", "even"], "bool_or({c}) AS any_true, bool_and({c}) AS all_true", "e")}) """
       + _cases("d", two_values="true", constant="NOT any_true OR all_true"))
def insight_boolean(spark, sf):
    return _found(spark, sf, ["never", "even"], "boolean")


@query("insight_quality", """
WITH d AS (SELECT 'text' AS column_name, bool_or(contains(text, chr(13))) AS special, false AS odd FROM documents
           UNION ALL SELECT 'Odd Name', bool_or(contains(lang || chr(13), chr(13))), true FROM documents)
""" + _cases("d", special_characters="special", odd_name="odd"))
def insight_quality(spark, sf):
    df = table(spark, sf, "documents").select("text", F.concat("lang", F.lit("\r")).alias("Odd Name"))
    return I.insights(profile_table(df), "quality").select(F.col("name").alias("column_name"), "code")


@query("business_summary", f"WITH {STATS} " + _cases(
    "k", complete="nulls = 0", missing_much="nulls > 0 AND pct > 15", missing_some="nulls > 0 AND pct > 5 AND pct <= 15",
    constant="hi = lo", ascending="up", whole_numbers="whole", has_negatives="negs > 0",
    many_zeros="zeros > 0 AND zeros / CAST(n AS DOUBLE) > 0.3", some_zeros="zeros > 0 AND zeros / CAST(n AS DOUBLE) <= 0.3",
    balanced_plain="skew IS NOT NULL AND abs(skew) < 0.5", high_tail_plain="abs(skew) >= 0.5 AND skew > 0",
    low_tail_plain="abs(skew) >= 0.5 AND skew <= 0", unreliable_deviation="sd > 0 AND abs(mean - med) / sd > 0.3",
    percent_plain="lo >= 0 AND hi <= 100 AND p05 >= 0 AND p95 <= 100",
    central_plain="NOT (lo >= 0 AND hi <= 100 AND p05 >= 0 AND p95 <= 100)"))
def business_summary(spark, sf):
    profile = profile_table(_events(spark, sf).select(*NUMBERS), order_by=["event_id"])
    return I.business_summary(profile).select(F.col("name").alias("column_name"), "code")


# ---------------------------------------------------------------- advice

_ADVICE = f"""{STATS}, a AS (
    SELECT column_name, 'Numeric' AS kind, nulls, pct, zeros / rows_all AS zero_share, skew, dist, dist / rows_all AS ratio,
           coalesce((dist = rows_all AND nulls = 0)
             OR (regexp_matches(column_name, '(^|_)(id|uuid|pk|key|code)(_|$)') AND dist / rows_all > 0.3)
             OR (whole AND up AND dist / rows_all > 0.5), false) AS ident FROM k
    UNION ALL {per_column(["event_type", "props"], "'Categorical', count(*) - count({c}), 100.0 * (count(*) - count({c})) / count(*), 0, NULL, "
               "count(DISTINCT {c}), count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), count(DISTINCT {c}) = count(*)", "e")}
    UNION ALL {per_column(["even"], "'Boolean', 0, 0, 0, NULL, count(DISTINCT {c}), count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), false", "e")})"""

_ADVISED = [*NUMBERS, "event_type", "props", "even"]


def _advised(spark, sf, codes=None):
    profile = profile_table(_events(spark, sf).select(*_ADVISED), order_by=["event_id"])
    advice = I.ml_advice(profile)
    if codes:
        advice = advice.where(F.col("code").isin(codes))
    return advice.select(F.col("name").alias("column_name"), "code")


@query("ml_identifier_detect", f"""WITH {_ADVICE}
SELECT column_name, ident AS is_identifier FROM a""")
def ml_identifier_detect(spark, sf):
    profile = profile_table(_events(spark, sf).select(*_ADVISED), order_by=["event_id"])
    return I.with_advice_flags(profile).select(F.col("name").alias("column_name"), "is_identifier")


_MODEL = {"exclude_identifier": "ident",
          "identifier_by_name": "ident AND regexp_matches(column_name, '(^|_)(id|uuid|pk|key|code)(_|$)')",
          "no_linear_feature": "kind = 'Numeric' AND ident", "regression": "kind = 'Numeric' AND NOT ident",
          "clip": "kind = 'Numeric' AND abs(skew) > 0.5", "classification": "kind IN ('Categorical', 'Boolean')",
          "one_hot": "kind IN ('Categorical', 'Boolean')", "cap_categories": "kind = 'Categorical' AND dist > 20"}
_PREPROCESS = {"exclude_missing": "nulls > 0 AND pct > 40", "impute_mean": "nulls > 0 AND pct <= 40 AND kind = 'Numeric'",
               "impute_mode": "nulls > 0 AND pct <= 40 AND kind <> 'Numeric'", "scale": "kind = 'Numeric' AND NOT ident",
               "zero_inflated": "kind = 'Numeric' AND NOT ident AND zero_share > 0.3"}


@query("ml_advice_model", f"WITH {_ADVICE} " + _cases("a", **_MODEL))
def ml_advice_model(spark, sf):
    return _advised(spark, sf, list(_MODEL))


@query("ml_advice_preprocess", f"WITH {_ADVICE} " + _cases("a", **_PREPROCESS))
def ml_advice_preprocess(spark, sf):
    return _advised(spark, sf, list(_PREPROCESS))


@query("auto_clean_configs", f"""WITH {_ADVICE}
SELECT column_name, column_name AS new_name, kind = 'Categorical' AS trim_whitespace, kind = 'Categorical' AS standardise_nulls,
       coalesce(kind = 'Numeric' AND abs(skew) > 0.5, false) AS clip_outliers, kind = 'Numeric' AND NOT ident AS scale,
       nulls > 0 AND pct <= 40 AND kind = 'Numeric' AS impute, kind <> 'Numeric' AS one_hot_encode FROM a""")
def auto_clean_configs(spark, sf):
    profile = profile_table(_events(spark, sf).select(*_ADVISED), order_by=["event_id"])
    rows = [(c, s.new_name, s.trim_whitespace, s.standardise_nulls, s.clip_outliers, s.normalisation == "zscore",
             s.impute_mode == "mean", s.one_hot_encode) for c, s in K.auto_settings(profile).items()]
    return spark.createDataFrame(rows, "column_name string, new_name string, trim_whitespace boolean, standardise_nulls boolean, "
                                       "clip_outliers boolean, scale boolean, impute boolean, one_hot_encode boolean")


# ---------------------------------------------------------------- validation rules

def _rule(name, checks, sql):
    @query(name, f"WITH {GAPPY} {sql}")
    def run(spark, sf):
        return R.validate_table(gappy(spark, sf), checks).select("position", "passed")
    return run


def _positions(*conditions: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS position, {c} AS passed FROM gappy"
                              for i, c in enumerate(conditions))


_NULLS = "100.0 * (count(*) - count({c})) / count(*)"
_rule("rule_max_null_percent", [R.max_null_percent("l_extendedprice", 20), R.max_null_percent("l_extendedprice", 10),
                                R.max_null_percent("l_quantity", 9.5), R.max_null_percent("l_tax", 0)],
      _positions(f"{_NULLS.format(c='l_extendedprice')} <= 20", f"{_NULLS.format(c='l_extendedprice')} <= 10",
                 f"{_NULLS.format(c='l_quantity')} <= 9.5", f"{_NULLS.format(c='l_tax')} <= 0"))
_rule("rule_column_exists", [R.column_exists("l_tax"), R.column_exists("l_colour")],
      _positions("count(*) >= 0", "count(*) < 0"))
_rule("rule_row_count_range", [R.row_count_range(1, 1_000_000_000), R.row_count_range(0, 100)],
      _positions("count(*) BETWEEN 1 AND 1000000000", "count(*) BETWEEN 0 AND 100"))
_rule("rule_value_range", [R.value_range("l_discount", 0, 0.1), R.value_range("l_quantity", 1, 20), R.value_range("l_linestatus", 0, 1)],
      _positions("min(l_discount) >= 0 AND max(l_discount) <= 0.1", "min(l_quantity) >= 1 AND max(l_quantity) <= 20",
                 "count(TRY_CAST(l_linestatus AS DOUBLE)) > 0"))
_rule("rule_matches_pattern", [R.matches_pattern("l_returnflag", "^[ANR]$"), R.matches_pattern("l_linestatus", "^O$")],
      _positions("count(*) FILTER (WHERE NOT regexp_matches(l_returnflag, '^[ANR]$')) = 0",
                 "count(*) FILTER (WHERE NOT regexp_matches(l_linestatus, '^O$')) = 0"))
_rule("rule_custom_condition", [R.custom_condition("l_discount < 0.5 AND l_tax >= 0"), R.custom_condition("l_extendedprice > 0")],
      _positions("count(*) FILTER (WHERE NOT coalesce(l_discount < 0.5 AND l_tax >= 0, false)) = 0",
                 "count(*) FILTER (WHERE NOT coalesce(l_extendedprice > 0, false)) = 0"))


@query("rule_no_duplicates", """
SELECT CAST(0 AS INTEGER) AS position, count(*) = count(DISTINCT o_orderkey) AS passed FROM orders
UNION ALL SELECT 1, count(*) = count(DISTINCT o_custkey) FROM orders""")
def rule_no_duplicates(spark, sf):
    return R.validate_table(table(spark, sf, "orders"), [R.no_duplicates("o_orderkey"), R.no_duplicates("o_custkey")]
                            ).select("position", "passed")


_MIXED = [R.max_null_percent("l_quantity", 50), R.column_exists("l_shipdate"), R.value_range("l_tax", 0, 1),
          R.custom_condition("l_quantity > 10"), R.matches_pattern("l_linestatus", "^[FO]$")]


@query("validate_table", f"""WITH {GAPPY} SELECT * FROM ({_positions(
    "100.0 * (count(*) - count(l_quantity)) / count(*) <= 50", "count(*) >= 0", "min(l_tax) >= 0 AND max(l_tax) <= 1",
    "count(*) FILTER (WHERE NOT coalesce(l_quantity > 10, false)) = 0",
    "count(*) FILTER (WHERE NOT regexp_matches(l_linestatus, '^[FO]$')) = 0")})
JOIN (VALUES (0, 'max_null_percent(l_quantity)'), (1, 'column_exists(l_shipdate)'), (2, 'value_range(l_tax)'),
      (3, 'custom_condition'), (4, 'matches_pattern(l_linestatus)')) v(position, rule) USING (position)""")
def validate_table(spark, sf):
    return R.validate_table(gappy(spark, sf), _MIXED).select("position", "rule", "passed")


@query("validation_gate", f"""WITH {GAPPY}
SELECT l_linestatus, l_quantity > 10 IS TRUE AS fulfilled, CAST(count(*) AS BIGINT) AS n FROM gappy GROUP BY 1, 2""")
def validation_gate(spark, sf):
    """Data that passes goes through; data that does not is stopped or split."""
    df = gappy(spark, sf)
    passed = R.validation_gate(df, [c for c in _MIXED if c.kind != "custom_condition"])
    try:
        R.validation_gate(df, _MIXED)
    except R.ValidationFailed:
        good, bad = R.quarantine(passed, [R.custom_condition("l_quantity > 10")])
        return (good.withColumn("fulfilled", F.lit(True)).unionByName(bad.withColumn("fulfilled", F.lit(False)))
                .groupBy("l_linestatus", "fulfilled").agg(F.count(F.lit(1)).alias("n")))
    raise AssertionError("the gate let broken data through")
