"""Mixing sources to target weights: temperature, and permutations in blocks under a token budget.

Weights are token shares raised to an exponent and normalised.  Exponent 1 keeps the natural shares, 0 makes all
sources equal.  The exponent is bisected (in steps of a fixed grid) to the smallest one at which no source is repeated
more than ``max_repeats`` times, or to the one whose weights have ``target_entropy``, whichever is nearer to 1.  Each
source then gets its weight times the budget in tokens: whole passes over the source, each in an order of its own, and a
last pass that stops at the budget.  Sources are cut into 4096 blocks of documents by hash; blocks are permuted per pass
and documents are permuted inside their block.  Running sums over the blocks of a source, and over the documents of the
one block at which it stops, say where the last pass ends.  So one row per source decides about all documents, and no
window holds more than a source's blocks or one block's documents.

Edge cases: a null source is a source of its own; a null or empty text has no words and counts as one token, so that
it can be placed.  Rows of equal id and text are interchangeable.  An empty table gives an empty mixture.  Other columns are
carried along; columns of the names that are added are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablewright.llm import common

GRID = 32
ROUNDS = 6
BLOCKS = 4096


def block_order(seed: int, epoch: Column, block: Column) -> Column:
    """The place of a block in a pass: blocks are permuted by this hash."""
    return F.xxhash64(F.lit(seed), F.lit("block"), epoch, block)


def tokens_of(text: Column) -> Column:
    """Tokens as words, one at least."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)), F.lit(1)).cast("bigint")


def exponent(sources: DataFrame, budget: float, max_repeats: float | None, target_entropy: float | None) -> float:
    """The exponent for ``sources`` (tokens per source).  Both measures fall or rise steadily between 0 and 1, so a
    grid over the open interval, narrowed ``ROUNDS`` times, finds the exponent to one part in 32**6.  Each round is one
    aggregation over one row per source."""
    if max_repeats is None and target_entropy is None:
        return 1.0
    low, high = 0.0, 1.0
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    for _ in range(ROUNDS):
        steps = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        lifted = sources.select((F.col("tokens") / F.lit(float(total))).alias("share"),
                                F.explode(F.array(*map(F.lit, steps))).alias("a"))
        power = F.pow("share", "a")
        rows = (lifted.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("l"),
                                        F.max(power / F.col("share")).alias("top")).orderBy("a").collect())
        fits = []
        for row in rows:
            entropy = math.log(row["z"]) - row["a"] * row["l"] / row["z"]
            repeats = row["top"] / row["z"] * budget / total
            fits.append((max_repeats is None or repeats <= max_repeats + 1e-9)
                        and (target_entropy is None or entropy <= target_entropy + 1e-9))
        first = next((i for i, fit in enumerate(fits) if fit), GRID)
        if first == 0:
            return steps[0]
        low, high = steps[first - 1], steps[first]
    return high


def mix(df: DataFrame, budget: float | None = None, max_repeats: float | None = 4.0,
        target_entropy: float | None = None, seed: int = 0, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source") -> DataFrame:
    """The rows of the mixture: those of ``df``, repeated or left out as the weights demand, with ``epoch`` (0 for the
    first pass over the source), ``block``, and the order of the pass: by ``block_order``, then by ``within``.

    ``budget`` is the number of tokens of the mixture; by default as many as ``df`` has.  A document that begins before
    the budget of its source ends is taken whole, so a source exceeds its budget by less than a document.
    """
    df = df.drop(*{"epoch", "block", "block_order", "within"}.difference({id_column, text_column, source_column}))
    text = df[text_column].cast("string")
    keyed = df.select(*df.columns, F.xxhash64(F.lit(seed), F.col(id_column), text).alias("__key"))
    keyed = keyed.withColumn("__block", F.pmod("__key", F.lit(BLOCKS)).cast("int"))
    # The only pass that counts tokens: per source and block, combined on the map side.
    blocks = common.stored(keyed.groupBy(F.col(source_column).alias("source"), F.col("__block").alias("block"))
                           .agg(F.sum(tokens_of(text)).alias("size")), "blocks")
    sources = common.stored(blocks.groupBy("source").agg(F.sum("size").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = float(total if budget is None else budget)
    a = exponent(sources, budget, max_repeats, target_entropy)
    power = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    quota = sources.select("source", "tokens", (power / F.lit(z) * F.lit(budget)).alias("quota"))
    quota = quota.select("source", "quota", F.floor(F.col("quota") / F.col("tokens")).cast("int").alias("whole"), "tokens")
    quota = quota.select(F.col("source").alias("own"), "whole", (F.col("quota") - F.col("whole") * F.col("tokens")).alias("rest"))

    # Where the last pass of each source stops: the block, and the tokens before it.
    order = Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    last = (blocks.join(quota, F.col("source").eqNullSafe(F.col("own"))).select(
        "source", "block", "size", "whole", "rest", block_order(seed, F.col("whole"), F.col("block")).alias("order"))
        .withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))))
    stop = last.groupBy("source", "whole", "rest").agg(
        F.max(F.when(F.col("before") < F.col("rest"), F.struct("order", "block", "before"))).alias("stop"))
    plan = common.stored(stop, "plan").select(F.col("source").alias("__source"), F.col("whole").alias("__whole"),
                                              F.col("rest").alias("__rest"), F.col("stop").alias("__stop"))

    rows = keyed.join(plan, F.col(source_column).eqNullSafe(F.col("__source"))).select(
        *keyed.columns, "__source", "__whole", "__rest", "__stop",
        F.explode(F.sequence(F.lit(0), F.col("__whole"))).alias("epoch"))
    rows = rows.withColumn("block_order", block_order(seed, F.col("epoch"), F.col("__block")))
    rows = rows.withColumn("within", F.xxhash64("epoch", "__key"))
    here, there = F.struct("block_order", "__block"), F.struct(F.col("__stop.order"), F.col("__stop.block"))
    final = F.col("epoch") == F.col("__whole")
    out = [*df.columns, "epoch", F.col("__block").alias("block"), "block_order", "within"]
    taken = rows.where(~final | F.coalesce(here < there, F.lit(False))).select(out)
    inside = Window.partitionBy("__source").orderBy("within", "__key", id_column).rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where(final & (here == there)).withColumn(
        "__before", F.col("__stop.before") + F.coalesce(F.sum(tokens_of(F.col(text_column).cast("string"))).over(inside), F.lit(0)))
    return taken.unionByName(cut.where(F.col("__before") < F.col("__rest")).select(out))
