"""Helpers shared by the corpus operators: Arrow text batches, stored intermediate tables, tokenizer files."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import scratch_path, ship  # noqa: F401

# White space that separates words: space and the codes 9 to 13, as in ``bytes.split``.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared scratch folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column ``text`` holds about ``most`` bytes (one row at least), rows never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
        group = np.cumsum(sizes) // most
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offsets of its rows (null: empty)."""
    column = column.fill_null("").cast(pa.large_binary()) if pa.types.is_string(column.type) or \
        pa.types.is_large_string(column.type) else column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=4)
def _parsed(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def rank_file(path: str) -> bytes:
    """A rank file as it is; vocabularies are of fixed size (about a megabyte), so tasks may carry them."""
    with open(path, "rb") as source:
        return source.read()


def ranks_of(content: bytes) -> dict[bytes, int]:
    """Token bytes to ids; parsed once per Python process."""
    return _parsed(content)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


TEXTS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Pass texts and sets of shingles to Python workers by the thousand; ten thousand of them, Spark's default, may be
    hundreds of megabytes at either end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXTS_PER_BATCH:
        spark.conf.set(key, str(TEXTS_PER_BATCH))
