import hashlib
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from tablewright.operators import diff as D
from tablewright.operators import rules as R
from tablewright.plans import catalog, jobs, manifest, sql, templates
from tablewright.plans import document as DOC
from tablewright.plans.steps import StepError, apply_transforms
from tablewright.plans.versions import VersionError, VersionStore, can_follow, diff_tables
from tablewright.sources import files, jdbc


# ---------------------------------------------------------------- files

def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a,\"b\"", "2024-01-02", "true"), (2, None, "line", "2024-01-03", "false")],
                               "i int, d double, t string, day string, flag string")
    got = files.load(spark, files.save(df, str(tmp_path / "x.csv")))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "double", "string", "timestamp", "boolean"]
    assert got.orderBy("i").first()["t"] == 'a,"b"'


def test_csv_options(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("1;two\n3;four\n", encoding="latin-1")
    got = files.scan_csv(spark, str(path), header=False, delimiter=";", encoding="latin-1")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "two"), (3, "four")]


def test_csv_keeps_every_value(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("v,code,day\n" + "".join(f"{i},{i:03d},2024-01-02\n" for i in range(12_000)) + "late,x,open\n")
    df = files.scan_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["string"] * 3
    assert df.where("v is null or code is null or day is null").isEmpty() and df.where("code = '007'").count() == 1


@pytest.mark.parametrize("suffix", [".csv", ".json", ".jsonl", ".parquet"])
def test_texts_survive_a_round_trip(spark, tmp_path, suffix):
    texts = ["a\nb", 'say "x", y', " blanks ", "", None, "007", "back\\slash", "c\r\nd", "'", "é😀", "null", "1,5"]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string").repartition(2)
    path = files.save(df, str(tmp_path / ("t" + suffix)))
    for got in (files.load(spark, path), files.load_written(spark, path, None, df.schema)):
        assert dict(map(tuple, got.collect())) == dict(enumerate(texts))


def test_json_array_or_lines_is_seen_from_the_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(' \n[{"a": 1},\n {"a": 2}]')
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert files.load(spark, str(tmp_path / "a.json")).count() == 2
    assert files.load(spark, str(tmp_path / "b.json")).count() == 3


def test_manifest_of_a_single_file_and_of_partitions(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("a\n1\n")
    manifest.manifest_create(spark, str(path))
    assert manifest.manifest_verify(spark, str(path)).first()["passed"]
    path.write_text("a\n1\n2\n")
    row = manifest.manifest_verify(spark, str(path)).first()
    assert not row["passed"] and row["changed"] == 1
    parts = str(tmp_path / "p.parquet")
    spark.range(8).selectExpr("id", "id % 2 AS k").coalesce(1).write.partitionBy("k").parquet(parts)
    manifest.manifest_create(spark, parts)
    row = manifest.manifest_verify(spark, parts).first()
    assert row["passed"] and row["ok"] == 2
    (tmp_path / "none.parquet").mkdir()
    with pytest.raises(manifest.ManifestError):
        manifest.manifest_create(spark, str(tmp_path / "none.parquet"), "parquet", df=spark.range(0))


def test_fingerprint_of_map_columns(spark):
    from tablewright.operators.aggregates import table_fingerprint
    a = spark.sql("SELECT map('x', 1, 'y', 2) AS m, array(map(1, 'a')) AS n UNION ALL SELECT NULL, NULL")
    b = spark.sql("SELECT NULL AS m, NULL AS n UNION ALL SELECT map('y', 2, 'x', 1), array(map(1, 'a'))").select(
        *[F.col(f.name).cast(f.dataType) for f in a.schema])
    assert table_fingerprint(a).first() == table_fingerprint(b).first()
    assert table_fingerprint(a).first() != table_fingerprint(a.limit(1)).first()


def test_scratch_needs_a_shared_folder_off_a_local_master(spark, monkeypatch):
    from tablewright import session
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(spark)


def test_sql_leaves_views_of_the_caller(spark):
    spark.range(3).createOrReplaceTempView("data")
    assert sql.sql_query(spark.range(5), "SELECT count(*) AS n FROM data").first()[0] == 5
    assert spark.table("data").count() == 3
    spark.catalog.dropTempView("data")


def test_runtime_errors_are_not_skipped(spark):
    broken = spark.range(3).selectExpr("CASE WHEN id = 2 THEN raise_error('broken') ELSE CAST(id AS DOUBLE) END AS v")
    with pytest.raises(Exception, match="broken"):
        DOC.apply_steps(broken, [{"op": "impute", "strategy": "mean", "columns": ["v"]}])


def test_json_document_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    assert files.load(spark, str(tmp_path / "a.json")).count() == 2
    df = files.load(spark, str(tmp_path / "a.json"))
    out = files.sink_json(df, str(tmp_path / "b.jsonl"))
    assert files.load(spark, out).orderBy("a").collect() == df.select("a", "b").orderBy("a").collect()


def test_unknown_suffix_and_guard(spark, tmp_path):
    with pytest.raises(files.UnsupportedFormatError):
        files.load(spark, "x.xlsx")
    df = spark.range(2)
    target = str(tmp_path / "t_{date}.parquet")
    path = files.save(df, target, date="2024-05-06")
    assert path.endswith("t_2024-05-06.parquet")
    with pytest.raises(Exception, match="(?i)exist"):
        files.save(df, target, date="2024-05-06", overwrite=False)
    with pytest.raises(files.DuplicateColumnError):
        files.save(df.select("id", "id"), target)


def test_jdbc_options(spark):
    df = spark.createDataFrame([], "i int, d double, b boolean, day date, t timestamp, s string, a array<int>")
    assert jdbc.create_table_columns(df.schema) == (
        "`i` BIGINT, `d` DOUBLE PRECISION, `b` BOOLEAN, `day` DATE, `t` TIMESTAMPTZ, `s` TEXT, `a` TEXT")
    assert jdbc.writable(df).schema["a"].dataType.simpleString() == "string"
    assert jdbc.table_name("main", None, "/in/orders.csv") == '"main"."orders"'
    assert jdbc.writer_options("jdbc:x", "t", partitions=4)["numPartitions"] == "4"
    o = jdbc.reader_options("jdbc:x", table="t", partition_column="id", bounds=(0, 9), partitions=3)
    assert o["partitionColumn"] == "id" and o["upperBound"] == "9"
    with pytest.raises(ValueError):
        jdbc.reader_options("jdbc:x")


# ---------------------------------------------------------------- documents

def test_document_reports_every_problem(people):
    document = DOC.Document.from_dict({"name": "x", "steps": [
        {"op": "drop_columns", "columns": ["nope"]},
        {"op": "rename_columns", "mapping": {"age": "years"}},
        {"op": "impute", "strategy": "guess", "columns": ["years"]},
        {"op": "trim_whitespace", "columns": ["age"]},
        {"op": "cast_types", "columns": {"years": "i9"}},
        {"op": "clip_outliers", "columns": ["salary"], "lower_quantile": 0.9, "upper_quantile": 0.1},
        {"op": "regex_replace", "columns": ["name"], "pattern": "(", "replacement": ""}]})
    problems = DOC.validate_document(people.columns, document)
    assert [p.split(" (")[0] for p in problems] == ["step 1", "step 3", "step 4", "step 5", "step 6", "step 7"]
    with pytest.raises(StepError):
        DOC.Document.from_dict({"name": "x", "steps": [{"op": "explode"}]})


def test_strict_contract(people):
    contract = DOC.Contract("strict", ["id", "name", "age", "city"])
    assert DOC.contract_problems(people.columns, contract) == [
        "required column 'city' is missing", "column 'salary' is not allowed in strict mode"]


def test_run_document(spark, people, tmp_path):
    document = DOC.Document.from_json(json.dumps({
        "version": "0.1", "name": "people", "input": {"format": "csv"}, "schema": {"required_columns": ["id"]},
        "steps": [{"op": "trim_whitespace", "columns": ["name"]},
                  {"op": "normalize_columns", "method": "min_max", "columns": ["salary"]},
                  {"op": "one_hot_encode", "columns": ["age"], "drop_original": True}],
        "output": {"format": "parquet", "path_template": str(tmp_path / "out_{date}.parquet")}}))
    report = DOC.run_document(spark, document, people, date="2024-01-01")
    assert (report.rows_before, report.rows_after, report.steps_applied) == (5, 5, 2)
    assert len(report.warnings) == 1 and report.warnings[0].startswith("step 3")
    got = spark.read.parquet(report.path).orderBy("id").collect()
    assert [r["name"] for r in got] == ["Ann", "Bob", "Cid", "Dee", "Eve"] and got[1]["salary"] == 0.25
    with pytest.raises(ValueError):
        DOC.run_document(spark, document, people, target=str(tmp_path / "o2.parquet"), on_error="fail")


@pytest.mark.parametrize("suffix", ["csv", "jsonl", "parquet"])
def test_run_from_text_to_each_format(spark, people, tmp_path, suffix):
    source = files.sink_csv(people, str(tmp_path / "in.csv"))
    document = DOC.Document.from_dict({"name": "x", "steps": [
        {"op": "impute", "strategy": "mean", "columns": ["salary"]}]})
    report = DOC.run_document(spark, document, source, target=str(tmp_path / f"out.{suffix}"))
    assert (report.rows_before, report.rows_after, report.columns_after) == (5, 5, 4)


def test_document_from_settings_renames_last(people):
    from tablewright.operators.clean import CleanSetting
    document = DOC.document_from_settings("x", {
        "name": CleanSetting(new_name="label", trim_whitespace=True), "age": CleanSetting(active=False),
        "salary": CleanSetting(new_name="pay", ml_preprocessing=True, impute_mode="mean", target_dtype="Numeric")})
    assert [s["op"] for s in document.steps] == ["drop_columns", "trim_whitespace", "cast_types", "impute", "rename_columns"]
    assert DOC.validate_document(people.columns, document) == []
    df, applied, _ = DOC.apply_steps(people, document.steps, on_error="fail")
    assert df.columns == ["id", "label", "pay"] and applied == 5


def test_templates_are_valid_documents(people):
    steps = templates.data_cleaning(["name"], ["age"], ["salary"])
    assert DOC.validate_document(people.columns, DOC.Document("t", steps=steps)) == []
    with pytest.raises(StepError):
        apply_transforms(people, [{"transform_type": "join", "parameters": {}}])


def test_sql(spark, people, tmp_path):
    assert sql.sql_query(people, "SELECT count(*) AS n FROM data;").first()["n"] == 5
    assert not spark.catalog.tableExists("data")
    joined = sql.sql_tables({"a": people, "b": people.limit(2)}, "WITH j AS (SELECT a.id FROM a JOIN b ON a.id = b.id) SELECT * FROM j")
    assert joined.count() == 2
    with pytest.raises(files.DuplicateColumnError):
        sql.sql_export(people, "SELECT 1 AS a, 2 AS a", str(tmp_path / "x.parquet"))


# ---------------------------------------------------------------- rules

def test_rules(people):
    checks = [R.value_range("name", 0, 1), R.column_exists("city"), R.max_null_percent("city", 1), R.no_duplicates("id")]
    got = [r["passed"] for r in R.validate_table(people, checks).orderBy("position").collect()]
    assert got == [False, False, False, True]
    with pytest.raises(R.ValidationFailed, match="city.*city"):
        R.validation_gate(people, checks[1:])
    assert R.validation_gate(people, checks[3:]) is people
    with pytest.raises(ValueError):
        R.check_from_json({"kind": "sorted"})


# ---------------------------------------------------------------- differences

def test_diff_by_key_against_brute_force(spark):
    old = spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(60)] + [(7, 9, "again"), (None, 1, "n")], "k int, a int, t string")
    new = spark.createDataFrame([(i, i % 3 + (i % 10 == 0), f"t{i}") for i in range(20, 80)] + [(None, 1, "n")], "k int, a int, t string")
    got = {r["change"]: (r["keys"], r["old_rows"], r["new_rows"]) for r in D.diff_rows_by_key(old, new, ["k"]).collect()}

    def group(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["k"], []).append((r["a"], r["t"]))
        return {k: sorted(v) for k, v in out.items()}
    a, b, want = group(old), group(new), {}
    for k in a.keys() | b.keys():
        change = "added" if k not in a else "removed" if k not in b else "unchanged" if a[k] == b[k] else "modified"
        x = want.setdefault(change, [0, 0, 0])
        x[0] += 1
        x[1] += len(a.get(k, []))
        x[2] += len(b.get(k, []))
    assert got == {c: tuple(v) for c, v in want.items()}


def test_multisets_of_one_key(spark):
    old = spark.createDataFrame([(1, "x"), (1, "x"), (2, "a"), (2, "b")], "k int, t string")
    new = spark.createDataFrame([(1, "y"), (1, "y"), (2, "b"), (2, "a")], "k int, t string")
    got = {r["k"]: r["change"] for r in D.key_states(old, new, ["k"]).collect()}
    assert got == {1: "modified", 2: "unchanged"}


def test_sample_changes(spark):
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "k int, t string, n int")
    new = spark.createDataFrame([(1, "z", 1), (3, "w", None)], "k int, t string, n int")
    got = {r["k"]: (r["change"], [tuple(c) for c in r["changes"]]) for r in D.sample_changes(old, new, ["k"]).collect()}
    assert got[1] == ("modified", [("t", "x", "z")])
    assert got[2] == ("removed", [("t", "y", None), ("n", "2", None)])
    assert got[3] == ("added", [("t", None, "w")])


def test_quarantine_refuses_rules_on_the_whole_table(spark):
    from tablewright.operators import rules as R
    df = spark.range(5)
    good, bad = R.quarantine(df, [R.custom_condition("id > 2")])
    assert (good.count(), bad.count()) == (2, 3)
    with pytest.raises(ValueError, match="no single row"):
        R.quarantine(df, [R.custom_condition("id > 2"), R.no_duplicates("id")])


def test_changes_of_a_key_with_several_rows(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "b", 2), (None, "x", 1)], "k int, t string, n int")
    new = spark.createDataFrame([(1, "a", 1), (1, "c", 1), (2, "a", 2), (2, "b", 1), (None, "y", 1)], "k int, t string, n int")
    got = {r["k"]: (r["change"], [tuple(c) for c in r["changes"]]) for r in D.sample_changes(old, new, ["k"]).collect()}
    assert got == {1: ("modified", [("t", "b", "c")]), None: ("modified", [("t", "x", "y")]),
                   2: ("modified", [(None, '{"t":"a","n":1}', '{"t":"a","n":2}')])}


def test_types_stay_with_a_version(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("id,code,day\n1,1.10,2024-01-02\n")
    store = VersionStore(spark, str(tmp_path / "store"))
    store.version_create_raw("x", str(path))
    kinds = ["bigint", "decimal(3,2)", "timestamp"]
    assert [f.dataType.simpleString() for f in store.version_read("x").schema] == kinds
    path.write_text("id,code,day\n2,2.20,2024-02-03\n")
    store.version_apply("x", [{"transform_type": "select_columns", "parameters": {"columns": ["id", "code"]}}], "Profiled")
    assert [f.dataType.simpleString() for f in store.version_read("x").schema] == kinds[:2]
    path.write_text("id,code,day\nlate,2.20,2024-02-03\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        store.version_read("x").collect()


def test_diff_of_equal_tables_is_empty(spark, people):
    same = diff_tables(people, people.orderBy(F.desc("id")), ["id"])
    assert not same.has_changes()


def test_schema_pair(spark):
    a = spark.createDataFrame([], "col1 long, col2 string")
    b = spark.createDataFrame([], "col1 double, col3 string")
    got = {r["name"]: r["change"] for r in D.schema_diff(a, b).collect()}
    assert got == {"col1": "type_changed", "col2": "removed", "col3": "added"}


def test_ambiguous_rename_is_no_rename(spark):
    old = spark.createDataFrame([(1, 5), (2, 6)], "k int, a int")
    two = old.select("k", F.col("a").alias("b"), F.col("a").alias("c"))
    assert D.schema_rename_detect(old, two).count() == 0
    one = old.select("k", F.col("a").alias("b"))
    assert [tuple(r) for r in D.schema_rename_detect(old, one).collect()] == [("a", "b", "int")]


# ---------------------------------------------------------------- versions, catalog, manifests

def test_versions(spark, people, tmp_path):
    source = files.sink_parquet(people, str(tmp_path / "people.parquet"))
    store = VersionStore(spark, str(tmp_path / "store"))
    raw = store.version_create_raw("people", source)
    cleaned = store.version_apply("people", [{"transform_type": "filter_rows", "parameters": {"condition": "age < 35"}}], "Cleaned")
    narrow = store.version_apply("people", [{"transform_type": "select_columns", "parameters": {"columns": ["id"]}}], "Advanced")
    assert store.version_read("people").columns == ["id"] and store.version_read("people").count() == 3
    assert store.get("people", narrow).location == store.get("people", cleaned).location
    with pytest.raises(VersionError):
        store.version_apply("people", [], "Raw")
    with pytest.raises(VersionError):
        store.get("people", "stage:Published")
    store.set_active("people", raw)
    assert store.get("people").version_id == raw
    assert [r["version_id"] for r in store.version_children("people", raw).collect()] == [cleaned]
    store.set_active("people", narrow)
    assert store.version_cleanup("people", [raw, narrow]) == []          # the data of `cleaned` is still in use
    assert store.version_read("people").count() == 3
    assert store.version_list("people").count() == 2
    with pytest.raises(VersionError):
        store.version_cleanup("people", [raw])
    assert can_follow("Raw", "Published") and not can_follow("Cleaned", "Raw")


def test_manifest_finds_changes(spark, people, tmp_path):
    path = files.sink_parquet(people.repartition(3), str(tmp_path / "p.parquet"))
    recorded = manifest.manifest_create(spark, path)
    for f in pathlib.Path(path).glob("part-*"):
        want = hashlib.sha256(f.read_bytes()).hexdigest()
        assert recorded.where(F.col("file") == f.name).first()["sha256"] == want
    assert manifest.manifest_verify(spark, path).first()["passed"]
    victim = sorted(pathlib.Path(path).glob("part-*"))[0]
    victim.write_bytes(victim.read_bytes() + b"x")
    for crc in pathlib.Path(path).glob(".*.crc"):
        crc.unlink()
    row = manifest.manifest_verify(spark, path).first()
    assert not row["passed"] and row["changed"] == 1
    for f in pathlib.Path(path).glob("part-*"):
        f.unlink()
    assert manifest.manifest_verify(spark, path).first()["missing"] == recorded.where("level = 'file'").count()


def test_catalog(spark, people, tmp_path):
    import uuid
    snap = catalog.catalog_snapshot(people, "people")
    row = snap.where("column_name = 'age'").first()
    assert row["column_id"] == str(uuid.UUID(bytes=hashlib.sha256(b"age").digest()[:16]))
    noted = catalog.catalog_annotate(snap, {"age": {"business_definition": "years"}}, {"description": "staff"})
    assert catalog.catalog_completeness(noted).first()["filled"] == 2
    assert {r["column_name"] for r in catalog.catalog_undocumented(noted).collect()} == {"id", "name", "salary"}
    with pytest.raises(ValueError):
        catalog.catalog_annotate(snap, {"age": {"colour": "red"}})


def test_export_cleans_once(spark, people, tmp_path):
    out = jobs.job_export(people, str(tmp_path / "e.csv"), settings="trim",
                          script=lambda df: df.where("id < 3"), catalog_root=str(tmp_path / "catalog"))
    assert sorted(r["name"] for r in files.load(spark, out.path).collect()) == ["Ann", "Bob"]
    assert manifest.manifest_verify(spark, out.path).first()["passed"]
    assert catalog.catalog_list(spark.read.parquet(str(tmp_path / "catalog"))).first()["row_count"] == 2
