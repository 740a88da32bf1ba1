"""Sharding by size: longest-processing-time scheduling of groups that must stay together.

Rows of equal text form a group.  Groups are hashed into cells of bounded size; inside a cell, groups go from the largest
to the smallest to the least loaded of as many bins as there are shards, through a heap.  The bins of all cells are groups
again, and are scheduled in the same way, cell by cell and level by level, until one heap holds them.  So no task sees
more than a cell, and every level starts from loads that differ by less than the smallest groups.

A group larger than an even share cannot be split; its shard then exceeds the others.  The law is ``bytes``: sizes near
equal, whatever the number of rows.  Inside a shard, rows get slots from 0 without gaps: rows are hashed into buckets,
counts per bucket and shard give each bucket its offset, and rows are numbered inside their bucket.

Edge cases: a null text has no bytes and is in one group with empty texts (size 1, CRC 0).  Repeated rows are rows of
their own.  A null id sorts first.  Empty tables give empty tables; columns other than id and text are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm import common

CELL = 50_000        # groups that one heap takes in
BUCKET = 100_000     # rows that are numbered together


def longest_first(sizes: list[int], names: list, bins: int) -> list[int]:
    """The bin of every group: largest first (ties by name), to the least loaded bin (ties to the lowest)."""
    heap = [(0, b) for b in range(bins)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], names[i])):
        load, b = heap[0]
        heapq.heapreplace(heap, (load + sizes[i], b))
        out[i] = b
    return out


def _schedule(shards: int):
    def each(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(bin=longest_first(part["size"].tolist(), part["name"].tolist(), shards))[["name", "cell", "bin"]]
    return each


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(name, shard) for groups of (name string, size long); names are unique."""
    levels: list[DataFrame] = []
    current = common.stored(groups, "groups")
    while True:
        count = current.count()
        cells = max(1, -(-count // max(CELL, 4 * shards)))  # each level has a quarter of the groups at most
        cell = F.pmod(F.xxhash64("name"), F.lit(cells)).cast("int")
        placed = common.stored(current.withColumn("cell", cell).groupBy("cell").applyInPandas(
            _schedule(shards), "name string, cell int, bin int"), "bins")
        levels.append(placed)
        if cells == 1:
            break
        # The bins of each cell are the groups of the next level.
        current = common.stored(placed.join(current, "name").groupBy("cell", "bin").agg(F.sum("size").alias("size"))
                                .select(F.format_string("%d:%d", "cell", "bin").alias("name"), "size"), "groups")
    shard = levels.pop().select("name", F.col("bin").alias("shard"))
    while levels:
        lower = levels.pop()
        above = shard.withColumnRenamed("name", "upper")
        shard = (lower.withColumn("upper", F.format_string("%d:%d", "cell", "bin")).join(above, "upper")
                 .select("name", "shard"))
    return shard


def shard(df: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` for every row of ``df``."""
    text = F.coalesce(df[text_column].cast("string"), F.lit(""))
    rows = common.stored(df.select(
        df[id_column].alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc"),
        F.substring(F.sha2(text, 256), 1, 32).alias("name")), "rows")
    groups = rows.groupBy("name").agg(F.sum("size").alias("size"))
    placed = rows.join(assign_groups(groups, shards), "name")

    buckets = max(1, -(-rows.count() // BUCKET))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "name"), F.lit(buckets)).cast("int"))
    placed = common.stored(placed.select("id", "size", "crc", "shard", "bucket"), "placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
               .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("shard", "bucket").orderBy("id")
    numbered = placed.withColumn("place", F.row_number().over(inside)).join(offsets, ["shard", "bucket"])
    return numbered.select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"),
                           F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).alias("slot"))


def write_shards(df: DataFrame, placed: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write the rows of ``df`` into one folder per shard (``shard=0`` and so on), several files each where a shard is
    large; ids have to be unique."""
    (df.join(placed.select(id_column, "shard", "slot"), id_column)
     .write.partitionBy("shard").option("maxRecordsPerFile", 1_000_000).parquet(path))


def shard_files(paths: Iterator[str]) -> dict[int, list[str]]:
    """Files by shard, for readers that take a shard each."""
    out: dict[int, list[str]] = {}
    for path in sorted(paths):
        if "shard=" in path:
            out.setdefault(int(path.split("shard=")[1].split("/")[0]), []).append(path)
    return out
