"""SimHash near-duplicates: every pair of fingerprints that differ in at most four bits, and their components.

Distinct fingerprints are compared, so copies cost nothing.  The 64 bits are cut into parts; fingerprints that differ in
four bits or fewer agree on all but four parts, so each choice of the parts that agree is a table of buckets, and every
close pair shares a bucket in one of them.  With more fingerprints more parts are used (5, 6 or 7: buckets of about 13, 21
or 27 bits), which changes the work and never the result.  Buckets above a size are cut into blocks, and every pair of
blocks becomes a bucket of its own.

Inside a bucket the comparison is bit-sliced.  Bit b of all fingerprints of a batch is one long integer, the plane b;
``plane ^ (plane >> k)`` are the differences of all fingerprints to the one k places on.  Carry-save adders count the
differences of four planes at a time in vertical counters, and a batch is given up as soon as no lane is within the radius.
Close pairs are joined at once inside their batch, so a group of n near copies leaves n links and not n squared.

Edge cases: a null text has no words; texts without words have fingerprint zero and are linked like any other.  A row
without id has a fingerprint and no component.  Each row has the component of its fingerprint, repeated ids too.  Empty
tables give empty tables; columns other than id and text are ignored.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common
from tablewright.llm.components import components

SEED = 42
RADIUS = 4
BATCH = 1 << 16   # rows that are compared together
BLOCK = 4096      # larger buckets are cut


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: bytes, width: int) -> list[int]:
    """The hashes of all word shingles of a text; the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, stops[min(width, len(words)) - 1:])]


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i:i + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes, width: int = 4) -> int:
    hashes = np.array(shingle_hashes(text, width), np.uint64)
    bits = 2 * majority(hashes) > len(hashes)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, 1):
            found = [fingerprint((t or "").encode(), width) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])
    return each


def fingerprints(df: DataFrame, width: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) for every row; fp is a 64-bit integer, signed as Spark has it."""
    return df.select(df[id_column].cast("bigint").alias("id"), df[text_column].cast("string").alias("text")).mapInArrow(
        _fingerprints(width), "id bigint, fp bigint")


# ---------------------------------------------------------------- comparison

def _add(a: int, b: int, c: int) -> tuple[int, int]:
    """Carry-save addition of three bits in every lane: sum and carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def close_lanes(planes: list[int], apart: int, alive: int, radius: int = RADIUS) -> int:
    """The lanes of ``alive`` that differ from the lane ``apart`` places on in at most ``radius`` (up to 7) bits."""
    ones = twos = fours = over = 0
    for i in range(0, 64, 4):
        a, b, c, d = (plane ^ (plane >> apart) for plane in planes[i:i + 4])
        ones, first = _add(ones, a, b)
        ones, second = _add(ones, c, d)
        twos, carry = _add(twos, first, second)
        over |= fours & carry
        fours ^= carry
        if i >= 16:
            if not alive & ~over & ~(fours & (ones | twos) if radius == 4 else 0):
                return 0
    beyond = over
    for value in range(radius + 1, 8):
        match = (ones if value & 1 else ~ones) & (twos if value & 2 else ~twos) & (fours if value & 4 else ~fours)
        beyond |= match
    return alive & ~beyond


def _lanes(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _places(lanes: int, n: int) -> np.ndarray:
    raw = np.frombuffer(lanes.to_bytes(-(-n // 8), "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def linked_roots(fps: np.ndarray, runs: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows that are sorted by run: the first row each is connected with, through close pairs of its run."""
    root = np.arange(len(fps))
    size = np.bincount(runs)[runs]
    # Runs of similar length go together, so that few lanes idle while the longest is compared.
    for low in (1 << np.arange(1, max(2, int(size.max()).bit_length() + 1))).tolist():
        rows = np.flatnonzero((size >= low) & (size < 2 * low))
        if not len(rows):
            continue
        own, n = runs[rows], len(rows)
        words = fps[rows]
        planes = [_lanes((words >> np.uint64(b)) & np.uint64(1) == 1) for b in range(64)]
        label = np.arange(n)
        for apart in range(1, int(size[rows].max())):
            same = np.zeros(n, bool)
            same[:-apart] = own[apart:] == own[:-apart]
            hit = close_lanes(planes, apart, _lanes(same), radius)
            if not hit:
                continue
            at = _places(hit, n)
            at = at[label[at] != label[at + apart]]
            for i, j in zip(at.tolist(), (at + apart).tolist()):
                while label[i] != i:
                    i = label[i]
                while label[j] != j:
                    j = label[j]
                label[max(i, j)] = min(i, j)
            while len(at) and (label[label] != label).any():
                label = label[label]
        root[rows] = rows[label]
    return root


def _links(radius: int):
    def settle(group: np.ndarray, fps: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        runs = np.cumsum(np.r_[False, group[1:] != group[:-1]])
        root = linked_roots(fps.view(np.uint64), runs, radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["u", "v"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= BATCH:
                group, fps, ids = map(np.concatenate, zip(*held))
                last = int(np.searchsorted(group, group[-1]))  # the last run may go on
                if last:
                    yield settle(group[:last], fps[:last], ids[:last])
                held, rows = [[group[last:], fps[last:], ids[last:]]], len(group) - last
        if rows:
            yield settle(*map(np.concatenate, zip(*held)))
    return each


def _tables(count: int, radius: int) -> list[int]:
    """Masks of the bits that have to agree: one per table.  The number of parts follows the number of fingerprints."""
    parts = radius + (1 if count < 1 << 22 else 2 if count < 1 << 30 else 3)
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, parts - radius)]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): ids of fingerprints that are connected, for a stored table (fp, id) of distinct fingerprints."""
    masks = _tables(distinct.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    key = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]))
    rows = distinct.select(key.alias("key"), "fp", "id")
    large = common.stored(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
                          .select(F.col("key").alias("large"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large")
    rows = rows.join(large, F.col("key") == F.col("large"), "left")
    own = F.pmod(F.xxhash64(F.lit("block"), "fp"), F.col("blocks"))
    tile = F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other)))))
    tiles = rows.select(tile.alias("group"), "fp", "id")
    return tiles.repartition("group").sortWithinPartitions("group").mapInArrow(_links(radius), "u bigint, v bigint")


def near_duplicates(df: DataFrame, width: int = 4, radius: int = RADIUS, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``id_column``, ``fp`` and ``component_id`` (the smallest id that links reach) for every row."""
    rows = common.stored(fingerprints(df, width, id_column, text_column), "fingerprints")
    distinct = common.stored(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    reached = components(links(distinct, radius))
    known = distinct.join(reached, F.col("id") == F.col("node"), "left").select(
        F.col("fp").alias("known"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(known, F.col("fp") == F.col("known"), "left")
    return out.select(F.col("id").alias(id_column), "fp",
                      F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, width: int = 4, radius: int = RADIUS, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component, and those without id.  Ids name documents: rows
    of equal id stay or go together."""
    found = near_duplicates(df, width, radius, id_column, text_column)
    gone = (found.where(F.col(id_column) != F.col("component_id")).select(F.col(id_column).cast("bigint").alias("__gone"))
            .distinct())
    gone = common.stored(gone, "gone")  # its true size decides how it is joined
    return df.join(gone, df[id_column] == gone["__gone"], "left_anti")
