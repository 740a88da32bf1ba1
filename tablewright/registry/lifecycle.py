"""Queries of versions, catalog, manifests, models and streaming."""

from pyspark.sql import functions as F

from tablewright.operators import diff as D
from tablewright.operators import models as M
from tablewright.operators.aggregates import union_all
from tablewright.operators.insights import column_warnings
from tablewright.operators.profile import profile_table
from tablewright.plans import catalog, manifest
from tablewright.plans.versions import VersionStore
from tablewright.registry.core import GAPPY, gappy, literal_rows, query, rounded, stamp, table
from tablewright.registry.tables import CHANGED, changed_orders
from tablewright.session import scratch_path
from tablewright.sources import files
from tablewright.streaming import ingest

_FILTER = [{"transform_type": "filter_rows", "parameters": {"condition": "value > 20"}}]
_SELECT = [{"transform_type": "select_columns", "parameters": {"columns": ["event_id", "value"]}}]
_RESTRICTED = [{"transform_type": "clean", "parameters": {
    "configs": {"event_type": {"trim_whitespace": True}}, "restricted": True}}]


def _store(spark, sf):
    """A dataset of events with a Raw, a Profiled, a Cleaned and an Advanced version."""
    store = VersionStore(spark, scratch_path(spark, "store"))
    ids = {"Raw": store.version_create_raw("events", f"{sf}/events.parquet"),
           "Profiled": store.version_apply("events", [], "Profiled"),
           "Cleaned": store.version_apply("events", _FILTER, "Cleaned"),
           "Advanced": store.version_apply("events", _SELECT, "Advanced")}
    return store, ids


_COUNTS = "WITH n AS (SELECT count(*) AS rows_all, count(*) FILTER (WHERE value > 20) AS kept FROM events)"
_LIST = _COUNTS + """
SELECT 'Raw' AS stage, CAST(rows_all AS BIGINT) AS row_count, CAST(6 AS INTEGER) AS column_count FROM n
UNION ALL SELECT 'Profiled', rows_all, 6 FROM n UNION ALL SELECT 'Cleaned', kept, 6 FROM n
UNION ALL SELECT 'Advanced', kept, 2 FROM n"""


@query("version_create_raw", "SELECT 'Raw' AS stage, CAST(count(*) AS BIGINT) AS row_count, CAST(6 AS INTEGER) AS column_count FROM events")
def version_create_raw(spark, sf):
    store = VersionStore(spark, scratch_path(spark, "store"))
    store.version_create_raw("events", f"{sf}/events.parquet")
    return store.version_list("events").select("stage", "row_count", "column_count")


@query("version_apply", "SELECT event_id, event_type, value FROM events WHERE value > 20")
def version_apply(spark, sf):
    store = VersionStore(spark, scratch_path(spark, "store"))
    store.version_create_raw("events", f"{sf}/events.parquet")
    store.version_apply("events", _FILTER, "Cleaned")
    return store.version_read("events").select("event_id", "event_type", "value")


@query("version_reuse_noop", _COUNTS + """
SELECT 'Profiled' AS stage, true AS reused, CAST(rows_all AS BIGINT) AS row_count, CAST(6 AS INTEGER) AS column_count FROM n
UNION ALL SELECT 'Cleaned', false, kept, 6 FROM n UNION ALL SELECT 'Advanced', true, kept, 6 FROM n
UNION ALL SELECT 'Validated', true, kept, 2 FROM n""")
def version_reuse_noop(spark, sf):
    store = VersionStore(spark, scratch_path(spark, "store"))
    store.version_create_raw("events", f"{sf}/events.parquet")
    rows = []
    for stage, transforms in (("Profiled", []), ("Cleaned", _FILTER), ("Advanced", _RESTRICTED), ("Validated", _SELECT)):
        before = store.get("events").location
        store.version_apply("events", transforms, stage)
        after = store.get("events")
        rows.append((stage, after.location == before, store.version_read("events").count(), len(store.version_read("events").columns)))
    return literal_rows(spark, rows, "stage string, reused boolean, row_count bigint, column_count int")


@query("version_read", _COUNTS + """
SELECT 'raw' AS selector, CAST(rows_all AS BIGINT) AS row_count, CAST(6 AS INTEGER) AS column_count FROM n
UNION ALL SELECT 'stage:Cleaned', kept, 6 FROM n UNION ALL SELECT 'latest', kept, 2 FROM n
UNION ALL SELECT 'active', rows_all, 6 FROM n UNION ALL SELECT 'id', kept, 6 FROM n""")
def version_read(spark, sf):
    store, ids = _store(spark, sf)
    store.set_active("events", ids["Profiled"])
    rows = []
    for label, which in (("raw", "raw"), ("stage:Cleaned", "stage:Cleaned"), ("latest", "latest"), ("active", "active"),
                         ("id", ids["Cleaned"])):
        df = store.version_read("events", which)
        rows.append((label, df.count(), len(df.columns)))
    return literal_rows(spark, rows, "selector string, row_count bigint, column_count int")


@query("version_publish", """
SELECT mode, event_id, value FROM events CROSS JOIN (VALUES ('snapshot'), ('view')) m(mode) WHERE value > 20""")
def version_publish(spark, sf):
    store, _ = _store(spark, sf)
    snapshot = store.version_publish("events", mode="snapshot")
    view = store.version_publish("events", mode="view", view="published_events")
    one = store.version_read("events", snapshot).withColumn("mode", F.lit("snapshot"))
    two = store.version_read("events", view).withColumn("mode", F.lit("view"))
    return one.unionByName(two)


@query("version_list", _LIST)
def version_list(spark, sf):
    return _store(spark, sf)[0].version_list("events").select("stage", "row_count", "column_count")


@query("version_schema", """
SELECT * FROM (VALUES ('event_id', 'bigint'), ('value', 'double')) v(name, type)""")
def version_schema(spark, sf):
    return _store(spark, sf)[0].version_schema("events").select("name", "type")


@query("version_lineage", """
SELECT CAST(depth AS INTEGER) AS depth, stage FROM (VALUES (0, 'Advanced'), (1, 'Cleaned'), (2, 'Profiled'), (3, 'Raw')) v(depth, stage)""")
def version_lineage(spark, sf):
    return _store(spark, sf)[0].version_lineage("events").select("depth", "stage")


@query("version_storage_stats", "SELECT count(*) > 0 AS has_files, sum(value) > 0 AS has_bytes FROM events WHERE value > 20")
def version_storage_stats(spark, sf):
    stats = _store(spark, sf)[0].version_storage_stats("events")
    return stats.select((F.col("files") > 0).alias("has_files"), (F.col("total_bytes") > 0).alias("has_bytes"))


@query("version_cleanup", "SELECT event_id, value FROM events WHERE value > 20")
def version_cleanup(spark, sf):
    """The kept version still reads; the folder nobody points to is gone."""
    store, ids = _store(spark, sf)
    extra = store.version_publish("events", mode="snapshot")
    removed = store.version_cleanup("events", keep=[ids["Raw"], ids["Advanced"]])
    if removed != [extra]:
        raise AssertionError(f"removed {removed}, expected {[extra]}")
    return store.version_read("events")


@query("diff_versions", """
WITH n AS (SELECT count(*) AS rows_all, count(*) FILTER (WHERE value > 20) AS kept FROM events)
SELECT 'row count' AS aspect, CAST(rows_all - kept AS BIGINT) AS changes, rows_all || ' -> ' || kept AS detail FROM n
UNION ALL SELECT 'rows removed', rows_all - kept, 'by key' FROM n
UNION ALL SELECT 'column removed', 1, c FROM (VALUES ('ts'), ('user_id'), ('event_type'), ('props')) v(c)""")
def diff_versions(spark, sf):
    store, ids = _store(spark, sf)
    return store.diff_versions("events", ids["Raw"], ids["Advanced"], keys=["event_id"]).summary()


@query("diff_row_counts", f"""
WITH {CHANGED}, a AS (SELECT count(*) AS o FROM orders), b AS (SELECT count(*) AS n FROM changed)
SELECT CAST(o AS BIGINT) AS rows_old, CAST(n AS BIGINT) AS rows_new, CAST(greatest(n - o, 0) AS BIGINT) AS net_added,
       CAST(greatest(o - n, 0) AS BIGINT) AS net_removed FROM a CROSS JOIN b""")
def diff_row_counts(spark, sf):
    return D.diff_row_counts(table(spark, sf, "orders"), changed_orders(spark, sf))


# ---------------------------------------------------------------- catalog

_COLUMNS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"]


def _snapshot(spark, sf, **how):
    return catalog.catalog_snapshot(gappy(spark, sf).select(*_COLUMNS), "lines", **how)


@query("catalog_snapshot", f"WITH {GAPPY} " + " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, substr(sha256('{c}'), 1, 8) || '-' || substr(sha256('{c}'), 9, 4) || '-' || substr(sha256('{c}'), 13, 4)
       || '-' || substr(sha256('{c}'), 17, 4) || '-' || substr(sha256('{c}'), 21, 12) AS column_id,
       '{"Categorical" if c == "l_returnflag" else "Numeric"}' AS kind, count(*) > count({c}) AS nullable,
       round(100.0 * (count(*) - count({c})) / count(*), 4) AS null_pct,
       CAST(count(DISTINCT {c}) {"" if c == "l_returnflag" else f"+ CAST(count(*) > count({c}) AS INTEGER)"} AS BIGINT) AS distinct_count
FROM gappy""" for c in _COLUMNS))
def catalog_snapshot(spark, sf):
    return _snapshot(spark, sf).where("level = 'column'").select(
        "column_name", "column_id", "kind", "nullable", F.round("null_pct", 4).alias("null_pct"), "distinct_count")


@query("column_warnings", """
SELECT 'event_id' AS column_name, CAST(CAST(count(DISTINCT event_id) > 100 AS INTEGER) AS INTEGER) AS warnings FROM events
UNION ALL SELECT 'value', CAST(count(DISTINCT value) / CAST(count(*) AS DOUBLE) > 0.95 AS INTEGER) FROM events
UNION ALL SELECT 'same', 1 UNION ALL SELECT 'seldom', 1 UNION ALL SELECT 'event_type', 0""")
def column_warning_query(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", F.lit("x").alias("same"), F.when(
        F.col("event_id") % 3 == 0, F.col("user_id")).alias("seldom"), "event_type")
    return column_warnings(profile_table(df)).select(F.col("name").alias("column_name"), F.size("warnings").alias("warnings"))


_NOTES = {"l_quantity": {"business_definition": "pieces", "sensitivity_tag": "none"},
          "l_returnflag": {"business_rules": "A, N or R", "notes": "missing for some suppliers"}}


def _annotated(spark, sf):
    return catalog.catalog_annotate(_snapshot(spark, sf), _NOTES, {"description": "lines of orders", "intended_use": "billing"})


@query("catalog_annotate", f"WITH {GAPPY} " + """
SELECT column_name, business_definition, business_rules, sensitivity_tag, notes, linked, n FROM (VALUES
 ('l_orderkey', NULL, NULL, NULL, NULL, true), ('l_quantity', 'pieces', NULL, 'none', NULL, true),
 ('l_extendedprice', NULL, NULL, NULL, NULL, true), ('l_returnflag', NULL, 'A, N or R', NULL, 'missing for some suppliers', true)
) v(column_name, business_definition, business_rules, sensitivity_tag, notes, linked)
JOIN (SELECT 'l_orderkey' AS column_name, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n FROM gappy
      UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) + 1 FROM gappy
      UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice) + 1 FROM gappy
      UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM gappy) USING (column_name)""")
def catalog_annotate(spark, sf):
    return _annotated(spark, sf).where("level = 'column'").select(
        "column_name", "business_definition", "business_rules", "sensitivity_tag", "notes",
        F.col("previous_snapshot_id").isNotNull().alias("linked"), F.col("distinct_count").alias("n"))


@query("catalog_completeness", f"WITH {GAPPY} SELECT CAST(5 AS BIGINT) AS filled, CAST(18 AS BIGINT) AS total, round(500.0 / 18, 4) AS completeness FROM gappy LIMIT 1")
def catalog_completeness(spark, sf):
    return rounded(catalog.catalog_completeness(_annotated(spark, sf)).drop("snapshot_id"), 4, "completeness")


@query("catalog_undocumented", "SELECT * FROM (VALUES ('l_orderkey'), ('l_extendedprice')) v(column_name)")
def catalog_undocumented(spark, sf):
    return catalog.catalog_undocumented(_annotated(spark, sf)).select("column_name")


@query("catalog_warned", """
SELECT column_name, CAST(1 AS INTEGER) AS warnings FROM (
  SELECT 'o_orderkey' AS column_name, count(DISTINCT o_orderkey) / CAST(count(*) AS DOUBLE) AS r, count(DISTINCT o_orderkey) AS n FROM orders
  UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice) / CAST(count(*) AS DOUBLE), count(DISTINCT o_totalprice) FROM orders
  UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) / CAST(count(*) AS DOUBLE), count(DISTINCT o_custkey) FROM orders)
WHERE r > 0.95 AND n > 100""")
def catalog_warned(spark, sf):
    snapshot = catalog.catalog_snapshot(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "orders")
    return catalog.catalog_warned(snapshot).select("column_name", F.size("warnings").alias("warnings"))


@query("catalog_list", """
SELECT 'customer' AS dataset, CAST(count(*) AS BIGINT) AS row_count, CAST(2 AS INTEGER) AS column_count, false AS has_previous FROM customer
UNION ALL SELECT 'customer', count(*), 2, true FROM customer UNION ALL SELECT 'part', count(*), 2, false FROM part""")
def catalog_list(spark, sf):
    root = scratch_path(spark, "catalog")
    first = catalog.catalog_append(catalog.catalog_snapshot(
        table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "customer"), root)
    catalog.catalog_append(catalog.catalog_snapshot(table(spark, sf, "part").select("p_partkey", "p_size"), "part"), root)
    catalog.catalog_append(catalog.catalog_annotate(catalog.read_snapshot(spark, root, first),
                                                    {"c_custkey": {"notes": "primary key"}}), root)
    listed = catalog.catalog_list(spark.read.parquet(root))
    return listed.select("dataset", "row_count", "column_count", F.col("previous_snapshot_id").isNotNull().alias("has_previous"))


# ---------------------------------------------------------------- manifests

@query("file_hash")
def file_hash(spark, sf):
    return manifest.file_hash(spark, sf, glob="*.parquet")


KEYS_OF_A_FILE = 10_000
LINES_SQL = f"""lines AS (
    SELECT o_orderkey // {KEYS_OF_A_FILE} AS bucket,
           string_agg(concat(CAST(o_orderkey AS VARCHAR), '|', o_orderpriority, chr(10)), '' ORDER BY o_orderkey) AS t
    FROM orders GROUP BY 1)"""


def _lines(spark, sf):
    """Text files whose bytes are known: sorted lines of orders, one file per range of keys."""
    path = scratch_path(spark, "lines")
    bucket = F.floor(F.col("o_orderkey") / KEYS_OF_A_FILE).cast("bigint")
    (table(spark, sf, "orders").select(
        "o_orderkey", bucket.alias("bucket"), F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("value"))
     .repartition("bucket").sortWithinPartitions("bucket", "o_orderkey").select("bucket", "value")
     .write.partitionBy("bucket").text(path))
    return path


def _bucket_of_file():
    return F.regexp_extract("file", "bucket=([0-9]+)", 1).cast("bigint").alias("bucket")


@query("file_hash_text", """
SELECT CAST(octet_length(encode(t)) AS BIGINT) AS size, sha256(t) AS sha256 FROM (
    SELECT string_agg(concat(CAST(o_orderkey AS VARCHAR), '|', o_orderpriority, chr(10)), '' ORDER BY o_orderkey) AS t FROM orders)""")
def file_hash_text(spark, sf):
    """The hash of a text whose bytes are known: lines of all orders, sorted.  Tasks write it side by side in parts."""
    path = scratch_path(spark, "lines")
    line = F.concat(F.coalesce(F.col("o_orderkey").cast("string"), F.lit("")), F.lit("|"), F.coalesce("o_orderpriority", F.lit("")))
    order = [F.col("o_orderkey").asc_nulls_last(), F.col("value")]
    (table(spark, sf, "orders").select("o_orderkey", line.alias("value")).repartitionByRange(*order)
     .sortWithinPartitions(*order).select("value").write.text(path))
    return manifest.joined_hash(spark, path)


@query("file_hash_buckets", f"""
WITH {LINES_SQL} SELECT CAST(bucket AS BIGINT) AS bucket, CAST(octet_length(encode(t)) AS BIGINT) AS size, sha256(t) AS sha256 FROM lines""")
def file_hash_buckets(spark, sf):
    """The hash of each file of sorted lines of orders, one file per range of keys."""
    return manifest.file_hash(spark, _lines(spark, sf)).select(_bucket_of_file(), "size", "sha256")


RANGE = 4096


@query("file_hash_ranges", f"""
WITH {LINES_SQL}, r AS (SELECT bucket, t, unnest(range(0, CAST(length(t) AS BIGINT), {RANGE})) AS o FROM lines WHERE length(t) > {RANGE}),
h AS (SELECT CAST(bucket AS BIGINT) AS bucket, CAST(o AS BIGINT) AS "offset", sha256(substr(t, CAST(o + 1 AS BIGINT), {RANGE})) AS sha256 FROM r)
SELECT bucket, "offset", sha256 FROM h UNION ALL SELECT bucket, CAST(-1 AS BIGINT), sha256(string_agg(sha256, '' ORDER BY "offset")) FROM h GROUP BY bucket
UNION ALL SELECT CAST(bucket AS BIGINT), CAST(-1 AS BIGINT), sha256(t) FROM lines WHERE length(t) <= {RANGE}""")
def file_hash_ranges(spark, sf):
    """Hashes of ranges of 4,096 bytes and, with offset -1, of the files that they make up."""
    path = _lines(spark, sf)
    ranges = manifest.range_hashes(spark, path, chunk=RANGE)
    whole = manifest.file_hash(spark, path, chunk=RANGE)
    return ranges.select(_bucket_of_file(), "offset", "sha256").union(
        whole.select(_bucket_of_file(), F.lit(-1).cast("bigint"), "sha256"))


def _written(spark, sf):
    df = table(spark, sf, "orders").repartition(4, "o_orderkey")
    return files.sink_parquet(df, scratch_path(spark, "receipt") + ".parquet")


@query("manifest_create", """
SELECT 'dataset' AS level, CAST(1 AS BIGINT) AS entries, CAST(count(*) AS BIGINT) AS row_count, CAST(6 AS BIGINT) AS column_count,
       'parquet' AS format FROM orders UNION ALL SELECT 'file', 4, count(*), 6, 'parquet' FROM orders""")
def manifest_create(spark, sf):
    return manifest.manifest_create(spark, _written(spark, sf)).groupBy("level").agg(
        F.count("sha256").alias("entries"), F.max("row_count").alias("row_count"),
        F.max("column_count").alias("column_count"), F.max("format").alias("format"))


@query("manifest_verify", """
SELECT 'untouched' AS state, count(*) > 0 AS passed, CAST(4 AS BIGINT) AS ok, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS new FROM orders
UNION ALL SELECT 'rewritten', false, 0, 4, 4 FROM (SELECT count(*) FROM orders)
UNION ALL SELECT 'partitioned', true, count(DISTINCT concat(o_orderstatus, o_orderkey % 8)), 0, 0 FROM orders
UNION ALL SELECT 'one partition gone', false, count(DISTINCT concat(o_orderstatus, o_orderkey % 8)) - min(lost.n), min(lost.n), 0
FROM orders, (SELECT count(DISTINCT o_orderkey % 8) AS n FROM orders WHERE o_orderstatus = (SELECT min(o_orderstatus) FROM orders)) AS lost""")
def manifest_verify(spark, sf):
    path = _written(spark, sf)
    manifest.manifest_create(spark, path)
    first = manifest.manifest_verify(spark, path).collect()
    files.sink_parquet(table(spark, sf, "orders").repartition(4, "o_custkey"), path)
    second = manifest.manifest_verify(spark, path).collect()
    parts = scratch_path(spark, "receipt") + ".parquet"
    orders = table(spark, sf, "orders").withColumn("part", F.col("o_orderkey") % 8)
    orders.repartition("o_orderstatus", "part").write.partitionBy("o_orderstatus", "part").parquet(parts)
    manifest.manifest_create(spark, parts)
    third = manifest.manifest_verify(spark, parts).collect()
    lost = orders.agg(F.min("o_orderstatus")).first()[0]
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{parts}/o_orderstatus={lost}")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    fourth = manifest.manifest_verify(spark, parts).collect()
    rows = [(state, r["passed"], r["ok"], r["missing"], r["new"]) for state, (r,) in (
        ("untouched", first), ("rewritten", second), ("partitioned", third), ("one partition gone", fourth))]
    return literal_rows(spark, rows, "state string, passed boolean, ok bigint, missing bigint, new bigint")


# ---------------------------------------------------------------- models

@query("ml_features", f"""
WITH {GAPPY} SELECT l_extendedprice, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
       CAST(l_linestatus = 'O' AS DOUBLE) AS is_open FROM gappy WHERE l_extendedprice IS NOT NULL""".replace(
    "CAST(l_linestatus = 'O' AS DOUBLE)", "CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE"))
def ml_features(spark, sf):
    df = gappy(spark, sf).select("l_extendedprice", "l_quantity", "l_linenumber", "l_returnflag",
                                 (F.col("l_linestatus") == "O").alias("is_open"))
    return M.ml_features(df, "l_extendedprice")[0]


@query("ml_split", """
WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders)
SELECT CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part, CAST(count(*) AS BIGINT) AS n,
       min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, round(sum(o_totalprice), 2) AS total FROM o GROUP BY 1""")
def ml_split(spark, sf):
    train, test = M.ml_split(table(spark, sf, "orders"), ["o_orderkey"])
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"),
                                    F.max("o_orderkey").alias("last_key"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("ml_class_check", "SELECT CAST(count(DISTINCT quality) AS BIGINT) AS classes, true AS constant_refused FROM labels")
def ml_class_check(spark, sf):
    labels = table(spark, sf, "labels")
    try:
        M.ml_class_check(labels.withColumn("quality", F.lit(1)), "quality")
        refused = False
    except M.ModelError:
        refused = True
    return literal_rows(spark, [(M.ml_class_check(labels, "quality"), refused)], "classes bigint, constant_refused boolean")


_FIT = """
WITH o AS (SELECT l_orderkey AS k, l_extendedprice AS y, l_quantity AS a, l_discount AS b,
                  row_number() OVER (ORDER BY l_orderkey) AS r, count(*) OVER () AS n FROM lineitem),
cut AS (SELECT max(k) AS edge FROM o WHERE r <= floor(n * 0.8)),
c AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb,
             avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM o CROSS JOIN cut WHERE k <= edge),
w AS (SELECT (bb * ya - ab * yb) / (aa * bb - ab * ab) AS wa, (aa * yb - ab * ya) / (aa * bb - ab * ab) AS wb, my, ma, mb FROM c),
m AS (SELECT wa, wb, my - wa * ma - wb * mb AS w0 FROM w),
t AS (SELECT y, w0 + wa * a + wb * b AS p FROM o CROSS JOIN cut CROSS JOIN m WHERE k > edge),
e AS (SELECT avg((y - p) * (y - p)) AS mse, 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2 FROM t)"""


def _linear(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_discount")
    return M.train_model(df, "linear_regression", "l_extendedprice", ["l_orderkey"], exclude=["l_orderkey"])


@query("ml_linear_regression", _FIT + """
SELECT round(wa, 4) AS quantity, round(wb, 2) AS discount, round(w0, 2) AS intercept, round(mse, 0) AS mse, round(r2, 6) AS r2 FROM m CROSS JOIN e""")
def ml_linear_regression(spark, sf):
    r = _linear(spark, sf)
    return literal_rows(spark, [(round(r.coefficients["l_quantity"], 4), round(r.coefficients["l_discount"], 2),
                                 round(r.intercept, 2), float(round(r.mse)), round(r.r2, 6))],
                        "quantity double, discount double, intercept double, mse double, r2 double")


def _classes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.size(F.split("text", "\n")).alias("lines"))
    return table(spark, sf, "labels").join(docs, "doc_id")


@query("ml_logistic_regression")
def ml_logistic_regression(spark, sf):
    df = _classes(spark, sf)
    return M.result_table(df, M.train_model(df, "logistic_regression", "quality", ["doc_id"], exclude=["doc_id"])).select(
        "kind", "target", "accuracy")


@query("ml_decision_tree")
def ml_decision_tree(spark, sf):
    df = _classes(spark, sf)
    return M.result_table(df, M.train_model(df, "decision_tree", "quality", ["doc_id"], exclude=["doc_id"])).select(
        "kind", "target", "accuracy")


# Classes by a rule that a feature shows, but for a tenth of the keys; gaps in the feature.
_RULE = """
WITH o AS (SELECT l_orderkey AS k, l_orderkey % 7 = 3 AS gap,
                  row_number() OVER (ORDER BY l_orderkey) AS r, count(*) OVER () AS n FROM lineitem),
cut AS (SELECT max(k) AS edge FROM o WHERE r <= floor(n * 0.8))
SELECT '{kind}' AS kind, round(avg(CASE WHEN k % 10 <> 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE k > edge AND NOT gap), 2) AS accuracy,
       CAST(count(*) FILTER (WHERE gap) AS BIGINT) AS rows_with_gaps FROM o CROSS JOIN cut"""


def _by_rule(kind):
    @query(f"ml_{kind}_rule", _RULE.replace("{kind}", kind))
    def run(spark, sf):
        many = F.col("l_linenumber") > 3
        df = table(spark, sf, "lineitem").select(
            "l_orderkey", F.when(F.col("l_orderkey") % 7 != 3, many.cast("int")).alias("shown"),
            F.when(many != (F.col("l_orderkey") % 10 == 0), "many").otherwise("few").alias("size"))
        found = M.train_model(df, kind, "size", ["l_orderkey"], exclude=["l_orderkey"])
        return rounded(M.result_table(df, found), 2, "accuracy").select("kind", "accuracy", "rows_with_gaps")
    return run


_by_rule("logistic_regression")
_by_rule("decision_tree")


@query("ml_target_suitability", """
SELECT 'event_id' AS name, true AS linear_regression, false AS logistic_regression, false AS decision_tree
UNION ALL SELECT 'ts', false, false, false UNION ALL SELECT 'user_id', true, false, false
UNION ALL SELECT 'event_type', false, true, true UNION ALL SELECT 'value', true, false, false
UNION ALL SELECT 'props', false, count(DISTINCT props) < 100 OR count(DISTINCT props) / CAST(count(*) AS DOUBLE) < 0.05,
          count(DISTINCT props) < 100 OR count(DISTINCT props) / CAST(count(*) AS DOUBLE) < 0.05 FROM events""")
def ml_target_suitability(spark, sf):
    return M.target_suitability(profile_table(table(spark, sf, "events"))).drop("kind")


@query("ml_interpretation", _FIT + """
SELECT CASE WHEN r2 > 0.7 THEN 'strong' WHEN r2 > 0.3 THEN 'moderate' ELSE 'weak' END AS code, CAST(1 AS BIGINT) AS n FROM e
UNION ALL SELECT 'driver', 2 FROM e""")
def ml_interpretation(spark, sf):
    results = M.result_table(table(spark, sf, "lineitem"), _linear(spark, sf))
    return M.ml_interpretation(results).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- streaming

def _arrived(spark, sf, parts=2):
    """orders as CSV files in a folder, as they would be handed over."""
    df = table(spark, sf, "orders").withColumn("o_orderdate", stamp("o_orderdate"))
    return files.sink_csv(df.repartition(parts, "o_orderkey"), scratch_path(spark, "arrived"))


_CSV = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def _csv_schema(spark):
    return spark.createDataFrame([], _CSV).schema


def _stream_to_table(spark, stream):
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    running = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
               .trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.parquet(out)


@query("stream_folder_source", """
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus""")
def stream_folder_source(spark, sf):
    stream = ingest.stream_folder_source(spark, _arrived(spark, sf, 4), "csv", _csv_schema(spark), glob="part-*.csv")
    return _stream_to_table(spark, stream).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("stream_file_ready", "SELECT count(*) > 0 AS ready, CAST(4 AS BIGINT) AS files FROM orders")
def stream_file_ready(spark, sf):
    return ingest.await_files_ready(spark, _arrived(spark, sf, 4), "part-*.csv").groupBy("ready").agg(
        F.count(F.lit(1)).alias("files"))


def _ingested(spark, sf, **how):
    folder, root = _arrived(spark, sf), scratch_path(spark, "ingest")
    stream = ingest.stream_files(spark, folder, "part-*.csv")
    log = ingest.IngestLog(spark, f"{root}/ingest_log")
    store = VersionStore(spark, root)
    ingest.stream_ingest(stream, store, log, "csv", f"{root}/state", available_now=True, **how).awaitTermination()
    return store, log


@query("stream_ingest", """
SELECT stage, CAST(2 AS BIGINT) AS versions, CAST(count(*) AS BIGINT) AS row_count FROM orders
CROSS JOIN (VALUES ('Raw'), ('Profiled')) v(stage) GROUP BY stage""")
def stream_ingest(spark, sf):
    store, _ = _ingested(spark, sf)
    return store.events().groupBy("stage").agg(F.count(F.lit(1)).alias("versions"), F.sum("row_count").alias("row_count"))


@query("stream_ingest_log", """
SELECT state, CAST(2 AS BIGINT) AS files, CAST(CASE WHEN state = 'succeeded' THEN (SELECT count(*) FROM orders) END AS BIGINT) AS row_count
FROM (VALUES ('detected'), ('ready'), ('started'), ('succeeded')) v(state)""")
def stream_ingest_log(spark, sf):
    _, log = _ingested(spark, sf)
    return log.read().groupBy("state").agg(F.count(F.lit(1)).alias("files"), F.sum("row_count").alias("row_count"))


@query("stream_ingest_now", "SELECT 'succeeded' AS state, CAST(2 AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS row_count FROM orders")
def stream_ingest_now(spark, sf):
    log = ingest.stream_ingest_now(spark, _arrived(spark, sf), "csv", scratch_path(spark, "ingest"), glob="part-*.csv")
    return log.where("state = 'succeeded'").groupBy("state").agg(
        F.count(F.lit(1)).alias("files"), F.sum("row_count").alias("row_count"))


@query("stream_archive_source", """
SELECT place, CAST(n AS BIGINT) AS n, CAST(keys AS BIGINT) AS keys FROM (
    SELECT 'source' AS place, 0 AS n, 0 AS keys FROM (SELECT count(*) FROM orders)
    UNION ALL SELECT 'archive', 3, count(DISTINCT o_orderkey) FROM orders
    UNION ALL SELECT 'versions', 3, count(DISTINCT o_orderkey) FROM orders)""")
def stream_archive_source(spark, sf):
    """Files and keys left in the source folder, in the archive, and readable through the versions after the move."""
    folder, archive, root = _arrived(spark, sf, 3), scratch_path(spark, "processed"), scratch_path(spark, "ingest")
    log = ingest.stream_ingest_now(spark, folder, "csv", root, archive_dir=archive, glob="part-*.csv")
    left = ingest.stream_file_ready(spark, folder, "part-*.csv", 0).count()
    moved = ingest.stream_file_ready(spark, archive, "part-*.csv", 0).count()
    store = VersionStore(spark, root)
    names = [r["dataset"] for r in log.where("state = 'succeeded'").select("dataset").distinct().collect()]
    read = union_all([store.version_read(name).select("o_orderkey") for name in names])
    kept = files.load(spark, f"{archive}/part-*.csv", "csv").select("o_orderkey")
    count = lambda df: df.select("o_orderkey").distinct().count()
    return literal_rows(spark, [("source", left, 0), ("archive", moved, count(kept)), ("versions", len(names), count(read))],
                        "place string, n bigint, keys bigint")
