"""SHA-256 manifests of written data: one row per part file, per range of a large one, and one for the dataset.

A file of up to ``CHUNK`` bytes has its plain SHA-256.  A larger one is cut into ranges of that size, which tasks read
and hash side by side in small buffers, and has the root of a hash tree over them: a node is the SHA-256 of the hexadecimal
hashes of up to ``FAN_OUT`` nodes below it, in order.  So no file is ever one value, and a change is found in its range.
Spark's scans pass over files without a byte; they are in no manifest.
"""

from __future__ import annotations

import datetime
import hashlib
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import durable, ship
from tablewright.sources import files

MANIFEST_VERSION = "2"
PRODUCER = "tablewright"
CHUNK = 64 << 20
FAN_OUT = 1024
BUFFER = 1 << 20


class ManifestError(ValueError):
    """There is nothing to describe."""


def file_listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, size) of data files; the content column is never read."""
    return _binary(spark, path, glob).select("file", "size")


def _binary(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """All files below a path, or the one file; hidden and metadata files (names with . or _ in front) are left out.
    A file is named by its path inside the dataset."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    inside = F.when(F.startswith("path", F.lit(root + "/")), F.substr("path", F.lit(len(root) + 2)))
    return reader.load(path).select(
        F.coalesce(inside, F.element_at(F.split(F.col("path"), "/"), -1)).alias("file"), F.col("path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def _opened(path: str):
    """A file of any store that Arrow reads; ``path`` is written as Hadoop does."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + (rest if colon else path).lstrip("/"))
    system, inner = pyarrow.fs.FileSystem.from_uri(f"{scheme}:{urllib.parse.quote(rest)}")
    return system.open_input_file(inner)


def _hash_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path, offset, length in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4))):
            digest = hashlib.sha256()
            with _opened(path) as source:
                source.seek(offset)
                left = length
                while left and (data := source.read(min(left, BUFFER))):
                    digest.update(data)
                    left -= len(data)
            if left:
                raise EOFError(f"{path} ends {left} bytes before its listed size")
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "sha256"])


def range_hashes(spark: SparkSession, path: str, glob: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(file, path, size, offset, length, sha256) of all ranges of the files that are larger than ``chunk``."""
    ship(spark)
    large = _binary(spark, path, glob).where(F.col("size") > chunk).select("file", "path", "size")
    offset = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(chunk).cast("bigint"))).alias("offset")
    ranges = large.select("file", "path", "size", offset).withColumn("length", F.least(F.lit(chunk), F.col("size") - F.col("offset")))
    return ranges.repartition("file", "offset").mapInArrow(
        _hash_ranges, "file string, path string, size bigint, offset bigint, length bigint, sha256 string")


def tree_hashes(ranges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(file, size, sha256): the root over the ranges of each file."""
    nodes = ranges.select("file", "size", F.floor(F.col("offset") / chunk).cast("bigint").alias("place"), "sha256")
    most = -(-(nodes.agg(F.max("size")).first()[0] or 1) // chunk)
    width = F.ceil(F.col("size") / chunk)  # nodes of the level of a file
    below = 1
    while True:
        joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sha256"))), lambda x: x["sha256"]), ""), 256)
        # A root stays as it is while longer files go on.
        own = joined if below == 1 else F.when(F.ceil(F.first(width) / below) <= 1, F.first("sha256")).otherwise(joined)
        nodes = nodes.groupBy("file", "size", F.floor(F.col("place") / FAN_OUT).cast("bigint").alias("place")).agg(own.alias("sha256"))
        below *= FAN_OUT
        if most <= below:
            return nodes.select("file", "size", "sha256")


def file_hash(spark: SparkSession, path: str, glob: str | None = None, chunk: int = CHUNK,
              ranges: DataFrame | None = None) -> DataFrame:
    """(file, size, sha256): of files up to ``chunk`` bytes their hash, of larger ones the root of their tree."""
    own = _binary(spark, path, glob)
    small = own.where(F.col("size") <= chunk).select("file", "size", F.sha2("content", 256).alias("sha256"))
    most = own.agg(F.max("size")).first()[0] or 0
    if most <= chunk:
        return small
    found = range_hashes(spark, path, glob, chunk) if ranges is None else ranges
    return small.unionByName(tree_hashes(found, chunk))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, total = hashlib.sha256(), 0
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with _opened(path) as source:
                left = size
                while left and (data := source.read(min(left, BUFFER))):
                    digest.update(data)
                    left -= len(data)
            if left:
                raise EOFError(f"{path} ends {left} bytes before its listed size")
            total += size
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([digest.hexdigest()])], ["size", "sha256"])


def joined_hash(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row (size, sha256): the plain SHA-256 of the bytes of all files, one after the other by name (nulls without
    any byte).

    Each step of a SHA-256 needs the one before, so one task reads the files, in small buffers; what it holds does not grow
    with them.  ``file_hash`` hashes side by side.
    """
    ship(spark)
    in_order = _binary(spark, path, glob).select("path", "size").coalesce(1).sortWithinPartitions("path")
    return in_order.mapInArrow(_joined, "size bigint, sha256 string").agg(
        F.max("size").alias("size"), F.max("sha256").alias("sha256"))


def manifest_path(data_path: str) -> str:
    return data_path.rstrip("/") + ".manifest"


def manifest_create(spark: SparkSession, data_path: str, fmt: str | None = None,
                    df: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Hash what was written and store the manifest beside the data."""
    fmt = fmt or files.format_of(data_path)
    written = df if df is not None else files.load(spark, data_path, fmt)
    rows = written.count()
    described = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in written.schema)
    name = data_path.rstrip("/").rsplit("/", 1)[-1]
    now = datetime.datetime.now(datetime.timezone.utc)
    ranges = durable(range_hashes(spark, data_path, chunk=chunk))
    parts = file_hash(spark, data_path, chunk=chunk, ranges=ranges).select(F.lit("file").alias("level"), "file", "size", "sha256")
    cut = ranges.select(F.lit("range").alias("level"), "file", F.col("length").alias("size"), "sha256", "offset")
    manifest = (parts.unionByName(dataset_digest(parts, name)).unionByName(cut, allowMissingColumns=True)
                .withColumn("version", F.lit(MANIFEST_VERSION)).withColumn("producer", F.lit(PRODUCER))
                .withColumn("created_at", F.lit(now)).withColumn("format", F.lit(fmt))
                .withColumn("row_count", F.lit(rows).cast("bigint"))
                .withColumn("column_count", F.lit(len(written.columns)).cast("bigint"))
                .withColumn("schema", F.lit(described)).withColumn("chunk", F.lit(chunk).cast("bigint")))
    target = manifest_path(data_path)
    manifest.write.mode("overwrite").parquet(target)
    stored = spark.read.parquet(target)
    if stored.where("level = 'file'").isEmpty():
        raise ManifestError(f"no data files at {data_path}")
    return stored


def dataset_digest(parts: DataFrame, name: str) -> DataFrame:
    """One row for the dataset.  The hashes of names and contents are added up in four columns and hashed again: the
    order of the files does not matter, and no list of them is gathered."""
    own = F.sha2(F.concat_ws(":", "file", "sha256"), 256)
    words = [F.sum(F.conv(F.substring(own, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    return parts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
                     F.sha2(F.concat_ws(":", *[w.cast("string") for w in words]), 256).alias("sha256")
                     ).select(F.lit("dataset").alias("level"), F.lit(name).alias("file"), "size", "sha256")


def manifest_compare(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """(file, status) with status ok, changed, missing or new."""
    a = recorded.select("file", F.col("sha256").alias("recorded"))
    b = present.select("file", F.col("sha256").alias("found"))
    status = (F.when(F.col("found").isNull(), "missing").when(F.col("recorded").isNull(), "new")
              .when(F.col("found") == F.col("recorded"), "ok").otherwise("changed"))
    return a.join(b, "file", "full_outer").select("file", status.alias("status"), "recorded", "found")


def _recorded(spark: SparkSession, data_path: str) -> tuple[DataFrame, int]:
    recorded = spark.read.parquet(manifest_path(data_path))
    first = recorded.select("chunk").first()
    return recorded, first["chunk"] if first else CHUNK


def manifest_verify(spark: SparkSession, data_path: str) -> DataFrame:
    """One row: passed, the numbers of files by status and a message."""
    recorded, chunk = _recorded(spark, data_path)
    present = present_hashes(spark, data_path, chunk)
    counts = manifest_compare(recorded.where("level = 'file'"), present).agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("ok", "changed", "missing", "new")])
    passed = (F.col("changed") == 0) & (F.col("missing") == 0) & (F.col("new") == 0)
    return counts.select(passed.alias("passed"), "ok", "changed", "missing", "new", F.when(
        passed, F.lit("all files match")).otherwise(F.format_string(
            "%d changed, %d missing, %d new files", "changed", "missing", "new")).alias("message"))


def changed_ranges(spark: SparkSession, data_path: str) -> DataFrame:
    """(file, offset, length, status) of the ranges of large files that are changed, missing or new."""
    recorded, chunk = _recorded(spark, data_path)
    a = recorded.where("level = 'range'").select("file", "offset", F.col("size").alias("a"), F.col("sha256").alias("recorded"))
    found = range_hashes(spark, data_path, chunk=chunk) if _exists(spark, data_path) else recorded.where("false").select(
        "file", "offset", F.col("size").alias("length"), "sha256")
    b = found.select("file", "offset", F.col("length").alias("b"), F.col("sha256").alias("found"))
    status = (F.when(F.col("found").isNull(), "missing").when(F.col("recorded").isNull(), "new")
              .when(F.col("found") != F.col("recorded"), "changed"))
    return (a.join(b, ["file", "offset"], "full_outer").select("file", "offset", F.coalesce("b", "a").alias("length"), status.alias("status"))
            .where("status IS NOT NULL"))


def _exists(spark: SparkSession, data_path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(data_path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def present_hashes(spark: SparkSession, data_path: str, chunk: int = CHUNK) -> DataFrame:
    if not _exists(spark, data_path):
        return spark.createDataFrame([], "file string, size bigint, sha256 string")
    return file_hash(spark, data_path, chunk=chunk)
