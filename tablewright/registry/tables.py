"""Queries of scans, sinks, projections, filters, sorts, joins and SQL."""

from pyspark.sql import functions as F

from tablewright.operators import aggregates as A
from tablewright.operators import clean as K
from tablewright.operators import columns as C
from tablewright.operators import diff as D
from tablewright.operators import ordering as O
from tablewright.plans import catalog, jobs, manifest, sql, templates
from tablewright.plans.document import Document, Target, apply_steps, run_document
from tablewright.plans.steps import apply_transforms
from tablewright.plans.versions import VersionStore
from tablewright.registry.core import (DIRTY, GAPPY, TRIMMED, dirty, gappy, literal_rows, query, rounded,
                                       stamp, table)
from tablewright.session import scratch_path
from tablewright.sources import files

ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"""


def _orders_out(df):
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                     stamp("o_orderdate").alias("o_orderdate"), "o_orderpriority")


def _orders_text(spark, sf):
    """orders with the date as text, as in a file without types."""
    return table(spark, sf, "orders").withColumn("o_orderdate", stamp("o_orderdate"))


# ---------------------------------------------------------------- sources and sinks

@query("scan_csv", ORDERS)
def scan_csv(spark, sf):
    path = files.sink_csv(_orders_text(spark, sf), scratch_path(spark, "scan") + ".csv")
    return _orders_out(files.load(spark, path))


WHOLE_DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@query("scan_csv_text", WHOLE_DOCUMENTS)
def scan_csv_text(spark, sf):
    """Texts with line breaks, quotes and blanks, out and in again."""
    path = files.sink_csv(table(spark, sf, "documents"), scratch_path(spark, "scan") + ".csv")
    return files.load(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


@query("scan_parquet", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def scan_parquet(spark, sf):
    return files.scan_parquet(spark, f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("scan_json", """
SELECT doc_id, lang, source, n_chars, length(text) AS text_length FROM documents""")
def scan_json(spark, sf):
    path = files.sink_json(table(spark, sf, "documents"), scratch_path(spark, "scan") + ".jsonl")
    return files.load(spark, path).select("doc_id", "lang", "source", "n_chars",
                                          F.char_length("text").cast("bigint").alias("text_length"))


@query("scan_json_text", WHOLE_DOCUMENTS)
def scan_json_text(spark, sf):
    """The same through ``.json``, whose folders hold a record per line."""
    path = files.sink_json(table(spark, sf, "documents"), scratch_path(spark, "scan") + ".json")
    return files.load(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


@query("promote_temporal_columns", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS mostly,
       CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE 'open' END AS seldom,
       'timestamp' AS mostly_type, 'string' AS seldom_type FROM orders""")
def promote_temporal_columns(spark, sf):
    day = stamp("o_orderdate")
    df = table(spark, sf, "orders").select(
        "o_orderkey", day.alias("mostly"), F.when(F.col("o_orderkey") % 3 == 0, day).otherwise("open").alias("seldom"))
    done = C.promote_temporal_columns(df)
    types = {f.name: f.dataType.simpleString() for f in done.schema}
    return done.select("o_orderkey", stamp("mostly").alias("mostly"), F.col("seldom").cast("string"),
                       F.lit(types["mostly"]).alias("mostly_type"), F.lit(types["seldom"]).alias("seldom_type"))


def _sink(name, suffix, sink):
    @query(name, ORDERS)
    def run(spark, sf):
        path = sink(_orders_text(spark, sf), scratch_path(spark, name) + suffix)
        return _orders_out(files.load(spark, path))
    return run


_sink("sink_parquet", ".parquet", lambda df, path: files.sink_parquet(df, path, max_records_per_file=50_000))
_sink("sink_csv", ".csv", files.sink_csv)
_sink("sink_json", ".json", files.sink_json)


@query("job_clean", f"""
WITH {DIRTY} SELECT p_partkey, CASE WHEN t NOT IN ('N/A', '') THEN t END AS label, p_size
FROM (SELECT p_partkey, p_size, {TRIMMED} AS t FROM dirty)""")
def job_clean(spark, sf):
    source = files.sink_parquet(dirty(spark, sf).select("p_partkey", "raw", "p_size"),
                                scratch_path(spark, "job") + ".parquet")
    settings = {"raw": K.CleanSetting(new_name="label", trim_whitespace=True, standardise_nulls=True)}
    target = jobs.job_clean(spark, source, scratch_path(spark, "job") + ".parquet", settings)
    return files.load(spark, target)


@query("job_convert", ORDERS)
def job_convert(spark, sf):
    source = files.sink_csv(_orders_text(spark, sf), scratch_path(spark, "job") + ".csv")
    return _orders_out(files.load(spark, jobs.job_convert(spark, source, scratch_path(spark, "job") + ".parquet")))


@query("job_export", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total,
       CAST(5 AS BIGINT) AS catalog_rows, CAST(3 AS BIGINT) AS catalog_columns, true AS verified
FROM orders GROUP BY o_orderpriority""")
def job_export(spark, sf):
    out = jobs.job_export(
        table(spark, sf, "orders"), scratch_path(spark, "export") + ".parquet",
        query="SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM data GROUP BY 1",
        catalog_root=scratch_path(spark, "catalog"))
    head = out.snapshot.where("level = 'dataset'").first()
    verified = manifest.manifest_verify(spark, out.path).first()["passed"]
    return files.load(spark, out.path).select(
        "*", F.lit(head["row_count"]).cast("bigint").alias("catalog_rows"),
        F.lit(head["column_count"]).cast("bigint").alias("catalog_columns"), F.lit(verified).alias("verified"))


# ---------------------------------------------------------------- projections and filters

@query("drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_columns(spark, sf):
    return C.drop_columns(table(spark, sf, "orders"), ["o_orderstatus", "o_orderdate", "o_orderpriority"])


@query("rename_columns", "SELECT c_custkey AS id, c_name AS nation_name, c_nationkey AS nation, c_acctbal, c_mktsegment FROM customer")
def rename_columns(spark, sf):
    return C.rename_columns(table(spark, sf, "customer"),
                            {"c_custkey": "id", "c_name": "nation_name", "c_nationkey": "nation"})


@query("select_columns", "SELECT l_tax, l_orderkey, l_linenumber FROM lineitem")
def select_columns(spark, sf):
    return C.select_columns(table(spark, sf, "lineitem"), ["l_tax", "l_orderkey", "l_linenumber"])


@query("filter_rows", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity > 25 AND l_returnflag IN ('A', 'N') AND l_shipdate < TIMESTAMP '1998-01-01'""")
def filter_rows(spark, sf):
    kept = C.filter_rows(table(spark, sf, "lineitem"),
                         "l_quantity > 25 AND l_returnflag IN ('A', 'N') AND l_shipdate < TIMESTAMP_NTZ '1998-01-01'")
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("drop_nulls_subset", f"""
WITH {GAPPY} SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag FROM gappy
WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL""")
def drop_nulls_subset(spark, sf):
    df = gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    return C.drop_nulls(df, ["l_extendedprice", "l_quantity"])


@query("drop_nulls_any", f"""
WITH {GAPPY} SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag FROM gappy
WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_returnflag IS NOT NULL""")
def drop_nulls_any(spark, sf):
    return C.drop_nulls(gappy(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag"))


@query("deactivate_columns", "SELECT p_partkey, p_brand AS brand, p_size, p_retailprice FROM part")
def deactivate_columns(spark, sf):
    return K.clean(table(spark, sf, "part"), {"p_name": K.CleanSetting(active=False),
                                              "p_type": K.CleanSetting(active=False),
                                              "p_brand": K.CleanSetting(new_name="brand")})


@query("standardise_names", """
SELECT c_custkey AS customer_id, c_name AS full_name, c_nationkey AS full_name_1, c_acctbal AS col_1st_balance,
       c_mktsegment AS col FROM customer""")
def standardise_names(spark, sf):
    odd = table(spark, sf, "customer").toDF(" Customer ID ", "Full  Name", "full-name", "1st Balance", "***")
    return C.standardise_column_names(odd)


@query("auto_clean_basic", f"""
WITH {DIRTY} SELECT p_partkey, {TRIMMED} AS raw, p_brand, p_size FROM dirty""")
def auto_clean_basic(spark, sf):
    return C.auto_clean_basic(dirty(spark, sf).select("p_partkey", "raw", "p_brand", "p_size"))


CLEAN_SQL = f"""
WITH {DIRTY},
a AS (SELECT p_partkey, CASE WHEN t IN ('n/a', '') THEN NULL ELSE t END AS label,
             CASE WHEN lower(token) IN ('true', '1', 'yes') THEN true
                  WHEN lower(token) IN ('false', '0', 'no') THEN false END AS flag,
             CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS price
      FROM (SELECT *, lower({TRIMMED}) AS t FROM dirty)),
b AS (SELECT *, coalesce(price, avg(price) OVER ()) AS filled FROM a),
q AS (SELECT quantile_cont(filled, 0.05) AS lo, quantile_cont(filled, 0.95) AS hi FROM b),
c AS (SELECT *, round(least(greatest(filled, lo), hi), 1) AS clipped FROM b CROSS JOIN q),
s AS (SELECT avg(clipped) AS m, stddev_samp(clipped) AS sd FROM c)
SELECT p_partkey, CASE WHEN label <> 'n/a' AND label <> '' THEN label END AS label, flag,
       round((clipped - m) / sd, 6) AS price FROM c CROSS JOIN s"""


@query("clean", CLEAN_SQL)
def clean(spark, sf):
    df = dirty(spark, sf).select("p_partkey", "raw", "token", F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice"))
                                 .alias("p_retailprice"), "p_brand")
    done = K.clean(df, {
        "raw": K.CleanSetting(new_name="label", trim_whitespace=True, text_case="lower", regex_find="^n/a$",
                              regex_replace="", standardise_nulls=True),
        "token": K.CleanSetting(new_name="flag", target_dtype="Boolean"),
        "p_retailprice": K.CleanSetting(new_name="price", ml_preprocessing=True, impute_mode="mean",
                                        clip_outliers=True, rounding=1, normalisation="zscore"),
        "p_brand": K.CleanSetting(active=False)})
    return rounded(done, 6, "price")


RUN_SQL = f"""
WITH {GAPPY},
i AS (SELECT l_orderkey, l_linenumber, l_shipdate, coalesce(l_extendedprice, avg(l_extendedprice) OVER ()) AS price,
             coalesce(l_quantity, median(l_quantity) OVER ()) AS quantity, l_linestatus FROM gappy),
q AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM i),
c AS (SELECT *, least(greatest(price, lo), hi) AS clipped FROM i CROSS JOIN q),
m AS (SELECT min(clipped) AS a, max(clipped) AS b FROM c)
SELECT l_orderkey, l_linenumber, round((clipped - a) / (b - a), 6) AS price, quantity,
       CAST(l_linestatus = 'F' AS INTEGER) AS status_F, CAST(l_linestatus = 'O' AS INTEGER) AS status_O
FROM c CROSS JOIN m"""

RUN_STEPS = [
    {"op": "drop_columns", "columns": ["l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]},
    {"op": "rename_columns", "mapping": {"l_extendedprice": "price", "l_quantity": "quantity", "l_linestatus": "status"}},
    {"op": "trim_whitespace", "columns": ["status"]},
    {"op": "impute", "strategy": "mean", "columns": ["price"]},
    {"op": "impute", "strategy": "median", "columns": ["quantity"]},
    {"op": "clip_outliers", "columns": ["price"], "lower_quantile": 0.01, "upper_quantile": 0.99},
    {"op": "normalize_columns", "method": "min_max", "columns": ["price"]},
    {"op": "one_hot_encode", "columns": ["status"], "drop_original": True},
]


@query("run_pipeline", RUN_SQL)
def run_pipeline(spark, sf):
    document = Document.from_dict({"name": "prepare lines", "steps": RUN_STEPS})
    target = scratch_path(spark, "run") + ".parquet"
    report = run_document(spark, document, source=gappy(spark, sf), target=target, on_error="fail")
    if report.rows_before != report.rows_after or report.steps_applied != len(RUN_STEPS):
        raise AssertionError(f"unexpected report {report}")
    return rounded(files.load(spark, target), 6, "price")


@query("transform_sequence", f"""
WITH {GAPPY} SELECT l_orderkey AS key, l_linenumber, round(l_extendedprice, 0) AS price FROM gappy
WHERE l_linenumber <= 3 AND l_extendedprice IS NOT NULL""")
def transform_sequence(spark, sf):
    return apply_transforms(gappy(spark, sf), [
        {"transform_type": "select_columns", "parameters": {"columns": ["l_orderkey", "l_linenumber", "l_extendedprice"]}},
        {"transform_type": "filter_rows", "parameters": {"condition": "l_linenumber <= 3"}},
        {"transform_type": "drop_nulls", "parameters": {"columns": ["l_extendedprice"]}},
        {"transform_type": "clean", "parameters": {"configs": {"l_extendedprice": {"rounding": 0, "new_name": "price"}}}},
        {"transform_type": "rename_columns", "parameters": {"mapping": {"l_orderkey": "key"}}},
        {"transform_type": "sort", "parameters": {"by_columns": ["key", "l_linenumber"], "descending": [True]}}])


@query("version_query_builder", """
SELECT event_id, event_type, value FROM events WHERE value > 50 AND event_type = 'view' ORDER BY value DESC, event_id LIMIT 500""")
def version_query_builder(spark, sf):
    store = VersionStore(spark, scratch_path(spark, "store"))
    store.version_create_raw("events", f"{sf}/events.parquet")
    store.version_apply("events", [{"transform_type": "sort", "parameters": {
        "by_columns": ["value", "event_id"], "descending": [True, False]}}], "Cleaned")
    hits = store.version_query("events", "stage:Cleaned", columns=["event_id", "event_type", "value"],
                               condition="value > 50 AND event_type = 'view'")
    return O.sort_rows(hits, ["value", "event_id"], [True, False]).limit(500)


@query("user_transform", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type""")
def user_transform(spark, sf):
    def script(df):
        return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))
    return C.user_transform(table(spark, sf, "events"), script)


# ---------------------------------------------------------------- joins

@query("sql_self_join", """
SELECT a.o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(b.o_totalprice), 2) AS total
FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey GROUP BY a.o_orderstatus""")
def sql_self_join(spark, sf):
    return sql.sql_query(table(spark, sf, "orders"), """
        SELECT a.o_orderstatus, count(*) AS n, round(sum(b.o_totalprice), 2) AS total
        FROM data a JOIN data b ON a.o_orderkey = b.o_orderkey GROUP BY a.o_orderstatus""")


@query("sql_cross_version_join", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(abs(value - least(value, 100))), 2) AS moved
FROM events WHERE value > 20 GROUP BY event_type""")
def sql_cross_version_join(spark, sf):
    store = VersionStore(spark, scratch_path(spark, "store"))
    raw = store.version_create_raw("events", f"{sf}/events.parquet")
    kept = store.version_apply("events", [{"transform_type": "filter_rows",
                                           "parameters": {"condition": "value > 20"}}], "Cleaned")
    return store.sql_across("events", {"before": raw, "after": kept}, """
        SELECT a.event_type, count(*) AS n, round(sum(abs(b.value - least(a.value, 100))), 2) AS moved
        FROM after a JOIN before b ON a.event_id = b.event_id GROUP BY a.event_type""")


def changed_orders(spark, sf):
    o = table(spark, sf, "orders")
    extra = o.where(F.col("o_orderkey") % 50 == 0).withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return (o.where(F.col("o_orderkey") % 40 != 0)
            .withColumn("o_totalprice", F.when(F.col("o_orderkey") % 9 == 0, F.col("o_totalprice") + 1)
                        .otherwise(F.col("o_totalprice"))).unionByName(extra))


CHANGED = """changed AS (
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS o_totalprice,
           o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 40 <> 0
    UNION ALL SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 50 = 0)"""


@query("diff_rows_by_key", f"""
WITH {CHANGED},
j AS (SELECT CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
             WHEN a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
               OR a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderdate IS DISTINCT FROM b.o_orderdate
               OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'modified' ELSE 'unchanged' END AS change,
             CAST(a.o_orderkey IS NOT NULL AS BIGINT) AS o, CAST(b.o_orderkey IS NOT NULL AS BIGINT) AS n
      FROM orders a FULL OUTER JOIN changed b ON a.o_orderkey = b.o_orderkey)
SELECT change, CAST(count(*) AS BIGINT) AS keys, CAST(sum(o) AS BIGINT) AS old_rows, CAST(sum(n) AS BIGINT) AS new_rows
FROM j GROUP BY change""")
def diff_rows_by_key(spark, sf):
    return D.diff_rows_by_key(table(spark, sf, "orders"), changed_orders(spark, sf), ["o_orderkey"])


@query("annotate_columns", """
WITH s AS (SELECT 'o_custkey' AS name, count(DISTINCT o_custkey) AS n FROM orders
           UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
           UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice) FROM orders)
SELECT name, CAST(n AS BIGINT) AS distinct_count,
       CASE name WHEN 'o_totalprice' THEN 'sum of all lines' WHEN 'o_custkey' THEN 'who ordered' END AS business_definition,
       CASE name WHEN 'o_totalprice' THEN 'internal' END AS sensitivity_tag FROM s""")
def annotate_columns(spark, sf):
    columns = A.distinct_counts(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_totalprice"])
    notes = literal_rows(spark, [("o_totalprice", "sum of all lines", "internal"), ("o_custkey", "who ordered", None)],
                         "column string, business_definition string, sensitivity_tag string")
    return catalog.annotate_columns(columns, notes, key="column").withColumnRenamed("column", "name")


@query("manifest_compare", """
SELECT * FROM (VALUES ('orders', 'ok'), ('lineitem', 'changed'), ('part', 'missing'), ('events', 'new')) v(file, status)""")
def manifest_compare(spark, sf):
    """Recorded and found digests of four tables, one of them edited, one gone, one new."""
    def digest(name, edit=False):
        df = table(spark, sf, name)
        if edit:
            df = df.withColumn("l_tax", F.col("l_tax") + F.when(F.col("l_linenumber") == 1, 0.01).otherwise(0.0))
        return A.table_fingerprint(df).select(F.lit(name).alias("file"), F.col("fingerprint").alias("sha256"))
    recorded = A.union_all([digest("orders"), digest("lineitem"), digest("part")])
    found = A.union_all([digest("orders"), digest("lineitem", edit=True), digest("events")])
    return manifest.manifest_compare(recorded, found).select("file", "status")


# ---------------------------------------------------------------- order, positions, samples

@query("sort_rows", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey""")
def sort_rows(spark, sf):
    return O.sort_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"),
                       ["o_orderpriority", "o_totalprice", "o_orderkey"], [False, True, False])


@query("limit_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 250")
def limit_rows(spark, sf):
    ordered = O.sort_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                          ["o_totalprice", "o_orderkey"], [True, False])
    return C.limit_rows(ordered, 250)


@query("preview_rows", "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 100")
def preview_rows(spark, sf):
    return C.preview_rows(O.sort_rows(table(spark, sf, "events").select("event_id", "user_id", "value"), ["event_id"]))


@query("top_k_values", """
SELECT CAST(user_id AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id
ORDER BY n DESC, user_id LIMIT 20""")
def top_k_values(spark, sf):
    return A.top_k_values(table(spark, sf, "events"), "user_id", 20).withColumn("value", F.col("value").cast("string"))


@query("row_index", """
SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_extendedprice, l_shipdate) - 1 AS BIGINT) AS row_index FROM lineitem""")
def row_index(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return O.row_index(table(spark, sf, "lineitem").select(*keys), keys).select("l_orderkey", "l_linenumber", "row_index")


@query("row_slice", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 500 OFFSET 1000")
def row_slice(spark, sf):
    return O.row_slice(table(spark, sf, "events").select("event_id", "value"), ["event_id"], 1000, 500)


@query("sample_stride", """
WITH n AS (SELECT greatest(1, count(*) // 300) AS stride FROM orders),
p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey FROM p CROSS JOIN n WHERE i % stride = 0 AND i < 300 * stride""")
def sample_stride(spark, sf):
    return O.sample_stride(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 300)


@query("sample_head_random")
def sample_head_random(spark, sf):
    return O.sample_head_random(table(spark, sf, "orders"), 200, order_by=["o_orderkey"])


@query("sample_reservoir")
def sample_reservoir(spark, sf):
    return O.sample_reservoir(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 200)


@query("sample_head_random_counts", """
SELECT CAST(200 AS BIGINT) AS n_rows, CAST(200 AS BIGINT) AS n_keys, CAST(0 AS BIGINT) AS n_outside FROM orders HAVING count(*) >= 400""")
def sample_head_random_counts(spark, sf):
    """Size, distinct keys, and rows that are not from the head the sample is drawn from."""
    head = O.sort_rows(table(spark, sf, "orders"), ["o_orderkey"]).limit(400).agg(F.max("o_orderkey").alias("last"))
    return sample_head_random(spark, sf).crossJoin(F.broadcast(head)).agg(
        F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"),
        F.count_if(F.col("o_orderkey") > F.col("last")).alias("n_outside"))


@query("sample_reservoir_counts", """
SELECT CAST(200 AS BIGINT) AS n_rows, CAST(200 AS BIGINT) AS n_keys, CAST(0 AS BIGINT) AS n_outside FROM lineitem HAVING count(*) >= 200""")
def sample_reservoir_counts(spark, sf):
    """Size, distinct rows, and sampled rows that the table does not have."""
    li = table(spark, sf, "lineitem")
    drawn = sample_reservoir(spark, sf).withColumn("drawn", F.lit(1))
    return drawn.join(li.select("l_orderkey", "l_linenumber").distinct().withColumn("there", F.lit(1)),
                      ["l_orderkey", "l_linenumber"], "left").agg(
        F.count("*").alias("n_rows"), F.count_distinct(F.struct(*li.columns)).alias("n_keys"),
        F.count_if(F.col("there").isNull()).alias("n_outside"))


SORTED_SQL = """
WITH p AS (SELECT event_id, ts, value, lag(ts) OVER w AS p_ts, lag(value) OVER w AS p_value, lag(user_id) OVER w AS p_user,
                  lag(-event_id) OVER w AS p_neg, user_id FROM events WINDOW w AS (ORDER BY event_id))
SELECT 'ts' AS column_name, bool_and(coalesce(p_ts {op} ts, true)) AS result FROM p
UNION ALL SELECT 'value', bool_and(coalesce(p_value {op} value, true)) FROM p
UNION ALL SELECT 'user_id', bool_and(coalesce(p_user {op} user_id, true)) FROM p
UNION ALL SELECT 'backwards', bool_and(coalesce(p_neg {op} -event_id, true)) FROM p"""


def _sorted(spark, sf, label):
    ev = table(spark, sf, "events").withColumn("backwards", -F.col("event_id"))
    return O.sortedness(ev, ["ts", "value", "user_id", "backwards"], ["event_id"]).select(
        F.col("column").alias("column_name"), F.col(label).alias("result"))


@query("is_sorted_asc", SORTED_SQL.replace("{op}", "<="))
def is_sorted_asc(spark, sf):
    return _sorted(spark, sf, "ascending")


@query("is_sorted_desc", SORTED_SQL.replace("{op}", ">="))
def is_sorted_desc(spark, sf):
    return _sorted(spark, sf, "descending")


# ---------------------------------------------------------------- schema

@query("schema_diff", """
SELECT * FROM (VALUES ('o_orderkey', 'type_changed', 'bigint', 'string'), ('o_custkey', 'unchanged', 'bigint', 'bigint'),
 ('o_orderstatus', 'removed', 'string', NULL), ('o_totalprice', 'unchanged', 'double', 'double'),
 ('o_orderdate', 'unchanged', 'timestamp_ntz', 'timestamp_ntz'), ('o_orderpriority', 'unchanged', 'string', 'string'),
 ('status', 'added', NULL, 'string')) v(name, change, old_type, new_type)""")
def schema_diff(spark, sf):
    o = table(spark, sf, "orders")
    return D.schema_diff(o, o.withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
                         .withColumnRenamed("o_orderstatus", "status"))


@query("schema_rename_detect", """
SELECT * FROM (VALUES ('o_totalprice', 'total', 'double'), ('o_orderstatus', 'status', 'string')) v(old_name, new_name, type)""")
def schema_rename_detect(spark, sf):
    o = table(spark, sf, "orders")
    new = o.select("o_orderkey", F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"),
                   (F.col("o_custkey") + 1).alias("customer"))
    return D.schema_rename_detect(o, new)


# ---------------------------------------------------------------- SQL

@query("sql_query", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc,
       CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def sql_query(spark, sf):
    return sql.sql_query(table(spark, sf, "lineitem"), """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc,
               count(*) AS n FROM data GROUP BY l_returnflag, l_linestatus""")


@query("sql_on_cleaned", f"""
WITH {DIRTY}, c AS (SELECT CASE WHEN t NOT IN ('N/A', '') THEN t END AS label FROM (SELECT {TRIMMED} AS t FROM dirty))
SELECT label IS NULL AS missing, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT label) AS BIGINT) AS labels FROM c GROUP BY 1""")
def sql_on_cleaned(spark, sf):
    settings = {"raw": K.CleanSetting(new_name="label", trim_whitespace=True, standardise_nulls=True)}
    return sql.sql_on_cleaned(dirty(spark, sf), settings, """
        SELECT label IS NULL AS missing, count(*) AS n, count(DISTINCT label) AS labels FROM data GROUP BY 1""")


@query("sql_project_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def sql_project_filter(spark, sf):
    return sql.sql_query(table(spark, sf, "orders"),
                         "SELECT o_orderkey, o_totalprice FROM data WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
                         limit=None)


@query("sql_group_order", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(max(o_totalprice), 2) AS top FROM orders
GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority""")
def sql_group_order(spark, sf):
    return sql.sql_query(table(spark, sf, "orders"), """
        SELECT o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS top FROM data
        GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority""")


@query("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def sql_order_limit(spark, sf):
    return sql.sql_query(table(spark, sf, "orders"),
                         "SELECT o_orderkey, o_totalprice FROM data ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")


@query("sql_export", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY l_orderkey""")
def sql_export(spark, sf):
    path = sql.sql_export(table(spark, sf, "lineitem"), """
        SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM data GROUP BY l_orderkey""",
                          scratch_path(spark, "sql") + ".parquet")
    return files.load(spark, path)


@query("group_aggregate_sql", """
SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total,
       round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment, c_nationkey""")
def group_aggregate_sql(spark, sf):
    return A.group_aggregate(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], {
        "n": "count(*)", "total": "round(sum(c_acctbal), 2)", "mean": "round(avg(c_acctbal), 4)"})


# ---------------------------------------------------------------- ready step lists

def _template(name, sql_text, source, steps, round_to=()):
    @query(name, sql_text)
    def run(spark, sf):
        return rounded(apply_steps(source(spark, sf), steps, on_error="fail")[0], 6, *round_to)
    return run


_template("template_column_selection", "SELECT p_partkey AS id, p_brand, p_size, p_retailprice FROM part",
          lambda spark, sf: table(spark, sf, "part"),
          templates.column_selection(["p_name", "p_type"], {"p_partkey": "id"}))

_template("template_data_cleaning", f"""
WITH {DIRTY} SELECT p_partkey, {TRIMMED} AS raw, round(coalesce(price, avg(price) OVER ()), 6) AS price
FROM (SELECT *, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS price FROM dirty)""",
          lambda spark, sf: dirty(spark, sf).select("p_partkey", "raw", "token", F.when(
              F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("price")),
          templates.data_cleaning(["raw"], ["token"], ["price"]), ["price"])


@query("template_date_normalisation", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day FROM orders""")
def template_date_normalisation(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    done = apply_steps(df, templates.date_normalisation({"day": "yyyyMMdd"}, {"o_orderkey": "String"}), on_error="fail")[0]
    return done.select("o_orderkey", stamp("day").alias("day"))


_template("template_missing_data", f"""
WITH {GAPPY}, m AS (SELECT l_returnflag AS v FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, avg(l_quantity) OVER ()), 6) AS l_quantity,
       coalesce(l_returnflag, m.v) AS l_returnflag FROM gappy CROSS JOIN m""",
          lambda spark, sf: gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_tax"),
          templates.missing_data(["l_tax"], ["l_quantity"], ["l_returnflag"]), ["l_quantity"])

_template("template_ml_preprocessing", f"""
WITH {GAPPY}, a AS (SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_linestatus,
                           coalesce(l_quantity, avg(l_quantity) OVER ()) AS q FROM gappy)
SELECT l_orderkey, l_linenumber, round((q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()), 6) AS l_quantity,
       CAST(l_linestatus = 'F' AS INTEGER) AS l_linestatus_F, CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus_O FROM a""",
          lambda spark, sf: gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus"),
          templates.ml_preprocessing({"l_linenumber": "f64"}, ["l_quantity"], ["l_quantity"], ["l_linestatus"]),
          ["l_quantity"])

_template("template_outlier_handling", """
WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events),
c AS (SELECT event_id, least(greatest(value, lo), hi) AS v FROM events CROSS JOIN q),
s AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM c)
SELECT event_id, round((v - m) / sd, 6) AS value FROM c CROSS JOIN s""",
          lambda spark, sf: table(spark, sf, "events").select("event_id", "value"),
          templates.outlier_handling(["value"], ["value"]), ["value"])

_template("template_text_processing", f"""
WITH {DIRTY} SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, {TRIMMED} AS label FROM dirty""",
          lambda spark, sf: dirty(spark, sf).select("p_partkey", "raw"),
          templates.text_processing(["raw"], {"raw": "label"}, {"p_partkey": "Text"}))


@query("template_type_conversion", """
SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day FROM orders""")
def template_type_conversion(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string"),
                                           F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    done = apply_steps(df, templates.type_conversion({"o_orderkey": "f64"}, {"day": "MM/dd/yyyy"}), on_error="fail")[0]
    return done.select("o_orderkey", stamp("day").alias("day"))
