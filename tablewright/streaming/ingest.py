"""Ingest of arriving files with Structured Streaming.

Files are handed over by renaming them into the watched folder.  The stream has a row per file (its listing), not
per record, so files without rows and files of any name arrive too.  The file source keeps track
of what it has seen in its checkpoint, so a file is ingested once; the log is keyed by batch,
so a batch that is replayed after a failure does not register its files twice.  A file is moved to the archive
before its version is registered, so the version names the place where it stays.
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.aggregates import run_jobs
from tablewright.operators.profile import PROFILE_SCHEMA, profile_rows
from tablewright.plans.versions import VersionStore
from tablewright.sources import files

ROW_COUNT = PROFILE_SCHEMA.fieldNames().index("row_count")

LOG_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("file", T.StringType()),
    T.StructField("state", T.StringType()),     # detected, ready, started, succeeded, failed
    T.StructField("dataset", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("at", T.TimestampType()),
])

LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def stream_folder_source(spark: SparkSession, folder: str, fmt: str, schema: T.StructType,
                         max_files_per_trigger: int = 100, archive_dir: str | None = None,
                         glob: str | None = None) -> DataFrame:
    """New files directly below a folder, with the path of each row's file.

    ``archive_dir`` moves finished files away (below a folder tree of its own).
    """
    reader = (spark.readStream.schema(schema).option("pathGlobFilter", glob or f"*.{fmt}")
              .option("recursiveFileLookup", False).option("maxFilesPerTrigger", max_files_per_trigger))
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    elif fmt == "json":
        reader = reader.option("multiLine", True)
    return reader.format(fmt).load(folder).select("*", F.col("_metadata.file_path").alias("__file"))


def stream_files(spark: SparkSession, folder: str, glob: str = "*", max_files_per_trigger: int = 100) -> DataFrame:
    """A stream of the new files directly below a folder: path, size and time of change.  Contents are not read.  Spark's
    scans pass over files without a byte; ``empty_files`` has those."""
    return (spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", glob).option("recursiveFileLookup", False)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(folder)
            .select(F.col("path").alias("__file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")))


def empty_files(spark: SparkSession, folder: str, glob: str = "*") -> list[str]:
    """The files directly below a folder that have no byte."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{glob}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return [s.getPath().toString() for s in found if s.isFile() and s.getLen() == 0
            and not s.getPath().getName().startswith((".", "_"))]


def stream_file_ready(spark: SparkSession, folder: str, glob: str, quiet_seconds: float = 1.5) -> DataFrame:
    """(path, size, ready): a file is ready when it had not changed for a while as the folder was listed."""
    now = time.time()
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
              .option("recursiveFileLookup", False).load(folder)
              .select("path", F.col("length").alias("size"), "modificationTime"))
    age = F.lit(int(now * 1e6)) - F.unix_micros("modificationTime")
    return listed.select("path", "size", (age >= F.lit(int(quiet_seconds * 1e6))).alias("ready"))


def await_files_ready(spark: SparkSession, folder: str, glob: str, quiet_seconds: float = 1.5, limit_seconds: float = 30.0,
                      interval_seconds: float = 0.5) -> DataFrame:
    """``stream_file_ready`` once all files are ready, looked at twice a second; after ``limit_seconds`` as they are, so
    files that still change are not ready."""
    end = time.monotonic() + limit_seconds
    while True:
        found = stream_file_ready(spark, folder, glob, quiet_seconds)
        if found.where(~F.col("ready")).isEmpty() or time.monotonic() >= end:
            return found
        time.sleep(interval_seconds)


class IngestLog:
    """Append-only table of file events."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)

    def append(self, rows: Sequence[tuple]) -> None:
        if rows:
            now = datetime.datetime.now(datetime.timezone.utc)
            self.spark.createDataFrame([(*r, now) for r in rows], LOG_SCHEMA).coalesce(1).write.mode(
                "append").parquet(self.path)

    def settled(self, batch_id: int) -> set[str]:
        return self._ended(self.read().where(F.col("batch_id") == batch_id))

    def ended(self, paths: Sequence[str]) -> set[str]:
        """Those of ``paths`` that some batch has dealt with."""
        return self._ended(self.read().where(F.col("file").isin(list(paths)))) if paths else set()

    @staticmethod
    def _ended(rows: DataFrame) -> set[str]:
        return {r["file"] for r in rows.where(F.col("state").isin("succeeded", "failed")).select("file").distinct().collect()}


def dataset_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def profile_file(store: VersionStore, path: str, fmt: str) -> tuple[int, int, T.StructType]:
    """Profile one file and keep the profile; returns its numbers of rows and columns, and its types."""
    table = files.load_columnar(store.spark, path, fmt)
    rows = profile_rows(table) if table.columns else []
    profile = store.spark.createDataFrame(rows, PROFILE_SCHEMA)
    profile.coalesce(1).write.mode("overwrite").parquet(f"{store.root}/profiles/{dataset_name(path)}")
    return rows[0][ROW_COUNT] if rows else 0, len(table.columns), table.schema


def register_file(store: VersionStore, path: str, fmt: str, shape: tuple[int, int], schema: T.StructType | None = None) -> None:
    """A Raw and a Profiled version, unless a replayed batch had already come this far."""
    name = dataset_name(path)
    known = store.version_list(name).where((F.col("location") == path) & (F.col("stage") == "Profiled"))
    if not known.take(1):
        store.register(name, path, fmt, shape, schema)


def archive_file(spark: SparkSession, path: str, archive_dir: str) -> str:
    """Move a file below ``archive_dir`` and return its new path; one that has been moved stays where it is."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    source = paths(path)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    target = paths(f"{archive_dir.rstrip('/')}/{source.getName()}")
    if not system.exists(source):
        if system.exists(target):
            return target.toString()
        raise FileNotFoundError(path)
    if system.exists(target):  # another file of that name had come before
        stem, dot, suffix = source.getName().rpartition(".")
        changed = system.getFileStatus(source).getModificationTime()
        target = paths(f"{archive_dir.rstrip('/')}/{stem or suffix}-{changed}{dot if stem else ''}{suffix if stem else ''}")
    system.mkdirs(target.getParent())
    if not system.rename(source, target):
        raise OSError(f"{path} could not be moved to {target.toString()}")
    return target.toString()


def ingest_batch(batch: DataFrame, batch_id: int, store: VersionStore, log: IngestLog, fmt: str,
                 auto_ingest: bool = True, archive_dir: str | None = None) -> None:
    """The work on one micro-batch: its files (a bounded number) are profiled side by side, then archived and
    registered one after the other.
    """
    done = log.settled(batch_id)
    paths = sorted(r["__file"] for r in batch.select("__file").distinct().collect() if r["__file"] not in done)
    _ingest(paths, batch_id, store, log, fmt, auto_ingest, archive_dir)


def sweep_empty(folder: str, glob: str, batch_id: int, store: VersionStore, log: IngestLog, fmt: str,
                auto_ingest: bool = True, archive_dir: str | None = None) -> None:
    """Ingest the files without a byte that no batch has dealt with."""
    paths = empty_files(store.spark, folder, glob)
    done = log.ended(paths)
    _ingest(sorted(p for p in paths if p not in done), batch_id, store, log, fmt, auto_ingest, archive_dir)


def _ingest(paths: Sequence[str], batch_id: int, store: VersionStore, log: IngestLog, fmt: str, auto_ingest: bool,
            archive_dir: str | None) -> None:
    states = ["detected", "ready", "started"] if auto_ingest else ["detected"]
    log.append([(batch_id, p, state, None, None, None, None) for p in paths for state in states])
    if not auto_ingest or not paths:
        return

    def attempt(path: str) -> tuple[str, int, int, T.StructType] | str:
        try:
            kept = path
            if archive_dir:  # a replayed batch finds its file moved
                kept = archive_file(store.spark, path, archive_dir)
            return kept, *profile_file(store, kept, fmt)
        except Exception as err:  # a broken file must not stop the stream
            return (str(err).splitlines() or [type(err).__name__])[0]

    outcomes = run_jobs(store.spark, [partial(attempt, p) for p in paths])
    rows = []
    for path, outcome in zip(paths, outcomes):
        if isinstance(outcome, str):
            rows.append((batch_id, path, "failed", None, None, None, outcome))
        else:
            kept, count, width, schema = outcome
            register_file(store, kept, fmt, (count, width), schema)
            rows.append((batch_id, path, "succeeded", dataset_name(kept), count, width, None))
    log.append(rows)


def stream_ingest(stream: DataFrame, store: VersionStore, log: IngestLog, fmt: str, checkpoint: str,
                  auto_ingest: bool = True, available_now: bool = False,
                  interval: str = "5 seconds", archive_dir: str | None = None, folder: str | None = None,
                  glob: str = "*") -> StreamingQuery:
    """Start the stream of files; ``available_now`` processes what is there and stops.  With ``folder``, every batch
    also takes the files without a byte."""
    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, store, log, fmt, auto_ingest, archive_dir)
        if folder:
            sweep_empty(folder, glob, batch_id, store, log, fmt, auto_ingest, archive_dir)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def stream_ingest_now(spark: SparkSession, folder: str, fmt: str, root: str,
                      archive_dir: str | None = None, glob: str | None = None) -> DataFrame:
    """Ingest all files present now and return the log."""
    log = IngestLog(spark, f"{root}/ingest_log")
    pattern, store = glob or f"*.{fmt}", VersionStore(spark, root)
    query = stream_ingest(stream_files(spark, folder, pattern), store, log, fmt, f"{root}/checkpoint", available_now=True,
                          archive_dir=archive_dir)
    query.awaitTermination()
    sweep_empty(folder, pattern, -1, store, log, fmt, archive_dir=archive_dir)
    return log.read()
