"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets random signs (on which side of random planes it lies), and the vectors of a label are
sorted by them.  Close vectors agree in most signs, so they end up near each other in at least one pass.  The sorted
order is cut into blocks; each block is compared with itself and with the next one, by cosine in double precision.  Vectors
that agree in all leading signs that are looked at (a run) are compared in full, in blocks dealt by a hash of the id if they
fill several, so dense groups are not cut off at the window and no task gathers them.  A pair that several passes compare
counts in the first of them; every task knows its vectors' blocks in all passes and can tell.  So tasks give counts and a
spanning tree per tile, never pairs.

A pass finds a pair for certain if it agrees in so many leading signs that what else agrees in them fits a block, or if it
shares its run.  How many signs that takes is measured: vectors of a label that lie in a cone are told apart by few of the
planes.  The number of passes follows from it, so that a pair at the threshold is found with a probability of ``recall``.  Equal
vectors (by a 128-bit digest) are one vector with a number of copies.  Every link that is reported is verified.

Edge cases: vectors that are null, empty, all zero, or hold a null or non-finite component, and rows without label, link
with nothing and are their own component.  Vectors of different dimension do not link.  Zeros of either sign are equal, and
components of any finite size are compared without overflow.  Repeated rows are vectors of
their own.  Rows without id have no component.  Empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm import common
from tablewright.llm.components import components

BITS = 64
BLOCK = 1024
RUN_BITS = 16  # signs that are looked at, at least
PILOT = 4      # passes that are measured


@lru_cache(maxsize=8)
def _planes(seed: int, dimension: int, passes: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, BITS * passes))


def passes_for(signs: int, threshold: float, recall: float) -> int:
    """Passes until a pair at the threshold agrees in the ``signs`` leading signs of one with probability ``recall``."""
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    once = agree ** max(1, signs)
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - once)) if once < 1 else 1)


def _signatures(seed: int, passes: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                vectors = batch.column(2).to_pylist()
                sizes = np.array([len(v) for v in vectors])
                signs = np.zeros((len(vectors), passes), np.uint64)
                for dimension in np.unique(sizes):
                    own = np.flatnonzero(sizes == dimension)
                    chosen = np.array([vectors[i] for i in own], np.float64)
                    chosen /= np.abs(chosen).max(1)[:, None]
                    side = chosen @ _planes(seed, int(dimension), passes) > 0
                    signs[own] = np.packbits(side, axis=1).view(">u8").astype(np.uint64)
                signed = (signs ^ np.uint64(1 << 63)).view(np.int64)  # the order of the bits as signed integers
                n = len(vectors)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(n), passes))),
                     batch.column(1).take(pa.array(np.repeat(np.arange(n), passes))),
                     pa.array(np.tile(np.arange(passes, dtype=np.int32), n)), pa.array(signed.ravel())],
                    ["id", "part", "pass", "sign"])
    return each


def _compare(threshold: float):
    def each(table: pa.Table) -> pa.Table:
        turn = table.column("pass")[0].as_py()
        next_door = table.column("y")[0].as_py() == table.column("x")[0].as_py() + 1
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        vectors = np.array(table.column("vector").to_pylist(), np.float64)
        vectors /= np.abs(vectors).max(1)[:, None]
        vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
        places = np.array(table.column("blocks").to_pylist(), np.int64)
        runs = np.array(table.column("runs").to_pylist(), np.int64)
        right = table.column("right").to_numpy(zero_copy_only=False).astype(bool)
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        left = np.flatnonzero(~right)
        others = np.flatnonzero(right)
        for low in range(0, len(left), 512):
            own = left[low:low + 512]
            # With the next block, and inside the own one (each pair once); far blocks of a run only with each other.
            for partner in ([left[low:], others] if next_door else [others]):
                if not len(partner):
                    continue
                near = vectors[own] @ vectors[partner].T >= threshold
                if partner is not others:
                    near &= partner[None, :] > own[:, None]
                a, b = np.nonzero(near)
                a, b = own[a], partner[b]
                use = np.ones(len(a), bool) if next_door else runs[a, turn] == runs[b, turn]
                for earlier in range(turn):
                    use &= ~((np.abs(places[a, earlier] - places[b, earlier]) <= 1) | (runs[a, earlier] == runs[b, earlier]))
                a, b = a[use], b[use]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                while len(a):
                    ra, rb = root[a], root[b]
                    open_ = ra != rb
                    if not open_.any():
                        break
                    np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
                    while (root[root] != root).any():
                        root = root[root]
        told = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"id": pa.array(ids[told]), "links": pa.array(links[told]), "root": pa.array(ids[root[told]])})
    return each


def _signs(distinct: DataFrame, seed: int, passes: int, run_bits: int) -> DataFrame:
    """(id, part, pass, run): the leading signs of each vector in each pass, as one number."""
    return distinct.select("id", "part", "vector").mapInArrow(
        _signatures(seed, passes), "id bigint, part string, pass int, sign bigint").select(
        "id", "part", "pass", F.shiftright("sign", BITS - run_bits).alias("run"))


def signs_to_a_block(distinct: DataFrame, seed: int, run_bits: int) -> int:
    """How many leading signs it takes until no more than a block of vectors agree in them, in any part; all that are
    looked at, if dense groups never fit a block."""
    runs = _signs(distinct, seed, PILOT, run_bits).groupBy("part", "pass", "run").agg(F.count("*").alias("n"))
    cells = common.stored(runs, "pilot").select("part", "pass", "n", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.lit(run_bits)), lambda k: F.floor(
            F.col("run") / F.pow(F.lit(2.0), F.lit(run_bits) - k)).cast("bigint"))).alias("depth", "cell"))
    largest = cells.groupBy("part", "pass", "depth", "cell").agg(F.sum("n").alias("n")).groupBy("depth").agg(F.max("n").alias("n"))
    fits = [row.depth + 1 for row in largest.where(F.col("n") <= BLOCK).collect()]
    return min(fits, default=run_bits)


def near_duplicates(df: DataFrame, threshold: float = 0.98, recall: float = 0.999, seed: int = 7, id_column: str = "vec_id",
                    vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``id_column``, ``n_links``, ``component_id`` and ``kept`` for every row; ids are integers."""
    rows = df.select(df[id_column].cast("bigint").alias("id"), df[label_column].cast("string").alias("label"),
                     df[vector_column].alias("vector"))
    if rows.schema["vector"].dataType.elementType.simpleString() != "float":
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    fine = (F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
            & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull())
    rows = rows.select("id", F.when(fine, F.concat_ws(":", F.size("vector"), "label")).alias("part"), "vector",
                       F.xxhash64("vector").alias("d"), F.xxhash64(F.lit("second"), "vector").alias("e"))
    distinct = common.stored(rows.where("part is not null").groupBy("part", "d", "e").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "vectors")
    largest = distinct.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    run_bits = min(BITS, max(RUN_BITS, math.ceil(math.log2(max(largest, 1) / BLOCK + 1)) + 4))
    passes = passes_for(signs_to_a_block(distinct, seed, run_bits), threshold, recall)

    # The place of each vector in each pass: runs are counted, and numbered by the vectors before them.
    signs = common.stored(_signs(distinct, seed, passes, run_bits), "signs")
    cell = F.shiftright("run", run_bits - RUN_BITS)
    runs = common.stored(signs.groupBy("part", "pass", "run").agg(F.count("*").alias("n")).withColumn("cell", cell), "runs")
    before = Window.partitionBy("part", "pass").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.groupBy("part", "pass", "cell").agg(F.sum("n").alias("m")).select(
        "part", "pass", "cell", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part", "pass", "cell").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = F.floor((F.col("offset") + F.col("inside")) / BLOCK)
    numbered = (runs.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
                .join(offsets, ["part", "pass", "cell"])
                .select("part", "pass", "run", first.alias("first"), F.ceil(F.col("n") / BLOCK).alias("parts")))
    numbered = common.stored(numbered, "numbered")
    spans = signs.join(numbered, ["part", "pass", "run"]).select(
        "id", "pass", "run", (F.col("first") + F.pmod(F.xxhash64(F.lit("block"), "id"), "parts")).alias("block"), "first",
        (F.col("first") + F.col("parts") - 1).alias("last"))
    turns = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pass", "block", "run", "first", "last"))).alias("turns"))

    full = distinct.join(turns, "id").select(
        "id", "part", "vector", "copies", F.col("turns.block").alias("blocks"), F.col("turns.run").alias("runs"),
        F.explode("turns").alias("turn"))
    block = F.col("turn.block")
    later = F.sequence(block + 1, F.greatest(block + 1, F.col("turn.last")))
    prior = F.sequence(F.least(block - 1, F.col("turn.first")), block - 1)
    tile = F.explode(F.concat(
        F.transform(later, lambda y: F.struct(block.alias("x"), y.alias("y"), F.lit(False).alias("right"))),
        F.transform(prior, lambda x: F.struct(x.alias("x"), block.alias("y"), F.lit(True).alias("right")))))
    tiles = full.select("id", "part", "vector", "copies", "blocks", "runs", F.col("turn.pass").alias("pass"),
                        tile.alias("tile")).select("id", "part", "vector", "copies", "blocks", "runs", "pass", "tile.*")
    told = common.stored(tiles.groupBy("part", "pass", "x", "y").applyInArrow(
        _compare(threshold), "id bigint, links bigint, root bigint"), "links")

    counts = told.groupBy(F.col("id").alias("c")).agg(F.sum("links").alias("links"))
    reached = components(told.select(F.col("id").alias("u"), F.col("root").alias("v")))
    known = (distinct.join(counts, F.col("id") == F.col("c"), "left").join(reached, F.col("id") == F.col("node"), "left")
             .select(F.col("part").alias("p"), F.col("d").alias("kd"), F.col("e").alias("ke"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "id").alias("found")))
    out = rows.join(known, (F.col("part") == F.col("p")) & (F.col("d") == F.col("kd")) & (F.col("e") == F.col("ke")), "left")
    component = F.coalesce("found", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))
