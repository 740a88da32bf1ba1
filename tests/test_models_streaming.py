import threading
import time

import pytest
from pyspark.sql import functions as F

from tablewright.operators import models as M
from tablewright.plans.versions import VersionStore
from tablewright.streaming import ingest


def test_linear_model(spark):
    df = spark.range(1, 41).select(F.col("id").cast("double").alias("x"), (2.0 * F.col("id") + 1).alias("y"))
    got = M.train_model(df, "linear_regression", "y", ["x"])
    assert got.coefficients["x"] == pytest.approx(2) and got.intercept == pytest.approx(1)
    assert got.r2 > 0.99 and got.mse < 1e-9
    codes = [r["code"] for r in M.ml_interpretation(M.result_table(df, got)).collect()]
    assert codes == ["strong", "driver"]


@pytest.mark.parametrize("kind", ["logistic_regression", "decision_tree"])
def test_classifiers(spark, kind):
    df = spark.range(200).select("id", (F.col("id") * 37 % 200).cast("double").alias("x")).withColumn(
        "y", F.when(F.col("x") > 100, "high").otherwise("low"))
    assert M.train_model(df, kind, "y", ["id"], exclude=["id"]).accuracy > 0.9


def test_classes_are_bounded_and_gaps_are_told(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 6 != 1, F.col("id") % 3).cast("double").alias("x"),
                                (F.col("id") % 3).cast("string").alias("y"))
    with pytest.raises(M.ModelError, match="3 classes"):
        M.train_model(df, "decision_tree", "y", ["id"], exclude=["id"], most_classes=2)
    got = M.result_table(df, M.train_model(df, "decision_tree", "y", ["id"], exclude=["id"])).first()
    assert got["rows_with_gaps"] == 10 and got["accuracy"] == 1.0


def test_class_check_and_features(spark):
    df = spark.createDataFrame([(1.0, 0, "a"), (2.0, None, "b")], "x double, y int, t string")
    with pytest.raises(M.ModelError):
        M.ml_class_check(df, "y")
    with pytest.raises(M.ModelError):
        M.train_model(df.select("t", F.col("t").alias("u")), "decision_tree", "t")
    with pytest.raises(M.ModelError):
        M.train_model(df, "forest", "y")


def test_split_by_order_and_by_hash(spark):
    df = spark.range(100)
    train, test = M.ml_split(df, ["id"])
    assert (train.count(), test.count()) == (80, 20) and train.agg(F.max("id")).first()[0] == 79
    two = df.withColumn("g", F.col("id") % 3)
    train, test = M.ml_split(two, ["g", "id"])
    assert (train.count(), test.count()) == (80, 20)
    train, test = M.ml_split(df)
    assert train.count() + test.count() == 100 and train.intersect(test).count() == 0


def _drop(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_ingest_is_once_per_file_and_survives_a_broken_one(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "root")
    _drop(folder, "a.csv", "id,v\n1,2.5\n2,3.5\n")
    _drop(folder, "notes.txt", "not data")
    (folder / "sub").mkdir()
    _drop(folder / "sub", "c.csv", "id,v\n9,9\n")
    log = ingest.stream_ingest_now(spark, str(folder), "csv", root)
    done = {r["dataset"]: r for r in log.where("state = 'succeeded'").collect()}
    assert set(done) == {"a"} and (done["a"]["row_count"], done["a"]["column_count"]) == (2, 2)
    _drop(folder, "b.csv", "id,v\n1,1\n")
    log = ingest.stream_ingest_now(spark, str(folder), "csv", root)
    assert sorted(r["dataset"] for r in log.where("state = 'succeeded'").collect()) == ["a", "b"]
    store = VersionStore(spark, root)
    assert [r["stage"] for r in store.version_list("b").orderBy("created_at").collect()] == ["Raw", "Profiled"]


def test_replayed_batch_registers_nothing_twice(spark, tmp_path):
    folder = tmp_path / "in"
    _drop(folder, "a.csv", "id\n1\n")
    store, log = VersionStore(spark, str(tmp_path / "s")), ingest.IngestLog(spark, str(tmp_path / "log"))
    batch = spark.createDataFrame([(1, f"{folder}/a.csv")], "id int, __file string")
    for _ in range(2):
        ingest.ingest_batch(batch, 0, store, log, "csv")
    assert store.version_list("a").count() == 2
    assert log.read().where("state = 'succeeded'").count() == 1


def test_failed_file_is_logged(spark, tmp_path):
    store, log = VersionStore(spark, str(tmp_path / "s")), ingest.IngestLog(spark, str(tmp_path / "log"))
    batch = spark.createDataFrame([(1, str(tmp_path / "gone.csv"))], "id int, __file string")
    ingest.ingest_batch(batch, 3, store, log, "csv")
    row = log.read().where("state = 'failed'").first()
    assert row["batch_id"] == 3 and row["message"]


def test_a_file_is_ready_when_its_writer_has_stopped(spark, tmp_path):
    folder = tmp_path / "in"
    _drop(folder, "a.csv", "id\n")
    listed = ingest.stream_file_ready(spark, str(folder), "*.csv")

    def write(seconds):
        end = time.monotonic() + seconds
        while time.monotonic() < end:
            with open(folder / "a.csv", "a") as out:
                out.write("1\n")
            time.sleep(0.2)

    writer = threading.Thread(target=write, args=(3,))
    writer.start()
    got = ingest.await_files_ready(spark, str(folder), "*.csv").collect()
    assert not writer.is_alive()
    assert [(r["size"], r["ready"]) for r in got] == [((folder / "a.csv").stat().st_size, True)]
    assert [r["ready"] for r in listed.collect()] == [False]  # as it was when listed

    writer = threading.Thread(target=write, args=(4,))
    writer.start()
    late = ingest.await_files_ready(spark, str(folder), "*.csv", limit_seconds=1)
    writer.join()
    time.sleep(1.6)
    assert [r["ready"] for r in late.collect()] == [False]
    assert ingest.await_files_ready(spark, str(folder), "none*").count() == 0


def test_the_query_waits_for_quiet_files(spark, sf, monkeypatch):
    from tablewright.registry import load_all
    quiet, check = [], ingest.stream_file_ready
    monkeypatch.setattr(ingest, "stream_file_ready", lambda spark, folder, glob, quiet_seconds=1.5: (
        quiet.append(quiet_seconds), check(spark, folder, glob, quiet_seconds))[1])
    got = load_all()[0]["stream_file_ready"](spark, sf).collect()
    assert [tuple(r) for r in got] == [(True, 4)]
    assert len(quiet) > 1 and set(quiet) == {1.5}


def test_detect_only(spark, tmp_path):
    store, log = VersionStore(spark, str(tmp_path / "s")), ingest.IngestLog(spark, str(tmp_path / "log"))
    batch = spark.createDataFrame([(1, "x.csv")], "id int, __file string")
    ingest.ingest_batch(batch, 0, store, log, "csv", auto_ingest=False)
    assert [r["state"] for r in log.read().collect()] == ["detected"]


def test_files_without_rows_and_with_blanks(spark, tmp_path):
    folder, root, archive = tmp_path / "in", str(tmp_path / "root"), tmp_path / "done"
    _drop(folder, "no byte.csv", "")
    _drop(folder, "header only.csv", "id,v\n")
    _drop(folder, "two rows%20.csv", "id,code\n1,007\n2,1.10\n")
    for _ in range(2):
        log = ingest.stream_ingest_now(spark, str(folder), "csv", root, archive_dir=str(archive))
        done = {r["dataset"]: (r["row_count"], r["column_count"]) for r in log.where("state = 'succeeded'").collect()}
        assert done == {"no byte": (0, 0), "header only": (0, 2), "two rows%20": (2, 2)}
        assert log.where("state = 'failed'").isEmpty() and log.where("state = 'succeeded'").count() == 3
    assert not list(folder.iterdir()) and len([p for p in archive.iterdir() if p.suffix == ".csv"]) == 3
    store = VersionStore(spark, root)
    assert {r["code"] for r in store.version_read("two rows%20").collect()} == {"007", "1.10"}


def test_archive_keeps_files_of_one_name(spark, tmp_path):
    for text in ("id\n5\n", "id\n6\n"):
        _drop(tmp_path / "in", "a b.csv", text)
        ingest.archive_file(spark, str(tmp_path / "in" / "a b.csv"), str(tmp_path / "done"))
    kept = [p for p in (tmp_path / "done").iterdir() if p.suffix == ".csv"]
    assert sorted(p.read_text() for p in kept) == ["id\n5\n", "id\n6\n"]
    again = ingest.archive_file(spark, str(tmp_path / "in" / "a b.csv"), str(tmp_path / "done"))  # replayed
    assert again.endswith("/done/a b.csv")


def test_event_log_of_a_thousand_events(spark, tmp_path, monkeypatch):
    from tablewright.plans import eventlog
    schema = spark.createDataFrame([], "name string, at timestamp, n bigint").schema
    log = eventlog.EventLog(spark, str(tmp_path / "log"), schema)
    assert log.read().count() == 0 and log.files() == []
    monkeypatch.setattr(eventlog, "SNAPSHOT_EVERY", 25)
    for i in range(100):
        events = [{"name": f"e{10 * i + k}", "at": "2024-01-02T03:04:05.123456+00:00", "n": k} for k in range(10)]
        assert log.append(events) == i
    assert len(log.files()) <= 5 and len(list((tmp_path / "log").glob("*.json"))) <= 50
    late = eventlog.EventLog(spark, str(tmp_path / "log"), schema)
    late._next = 3  # a number that has been compacted away
    assert late.append([]) == 100 and log.append([]) == 101
    log.append([{"name": "x", "n": -1}, {"name": "y", "n": -2}])
    rows = log.read().orderBy("commit", "seq").collect()
    assert [r["name"] for r in rows] == [f"e{i}" for i in range(1000)] + ["x", "y"]
    assert rows[0]["at"].microsecond == 123456 and (rows[-1]["commit"], rows[-1]["seq"]) == (102, 1)


def test_two_writers_never_take_one_number(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from tablewright.plans.eventlog import EventLog
    schema = spark.createDataFrame([], "writer int, n int").schema
    logs = [EventLog(spark, str(tmp_path / "log"), schema) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: [logs[k].append([{"writer": k, "n": i}]) for i in range(15)], range(4)))
    taken = [n for own in numbers for n in own]
    assert sorted(taken) == list(range(60))
    assert {(r["writer"], r["n"]) for r in logs[0].read().collect()} == {(k, i) for k in range(4) for i in range(15)}
