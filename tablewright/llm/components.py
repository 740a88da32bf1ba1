"""Connected components of a link table by alternating star contraction.

Each round joins every node's larger neighbours, then its smaller ones, to the smallest node it knows.  Both steps are
aggregations and equi-joins over links; nothing is collected.  Minima are combined on the map side, and the joins are salted,
so the links of one hub are spread over several tasks.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common

MOST_ROUNDS = 60
SALTS = 8


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _with_smallest(links: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, m): each link with the smallest node that u knows."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = links.withColumn("salt", F.pmod(F.xxhash64("u", "v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.select(F.col("u").alias("w"), "m", salts.alias("s")),
                       (F.col("u") == F.col("w")) & (F.col("salt") == F.col("s"))).select("u", "v", "m")


def _larger_star(links: DataFrame) -> DataFrame:
    rising = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    both = rising.union(rising.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_smallest(rising, _smallest(both)).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smaller_star(links: DataFrame) -> DataFrame:
    falling = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(falling)
    return (_with_smallest(falling, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (u long, v long): the smallest node that can be reached.  Nodes without links to
    others are left out."""
    current = common.stored(links.select("u", "v").where("u <> v").distinct(), "links")
    if current.isEmpty():
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    for _ in range(MOST_ROUNDS):
        current = common.stored(_smaller_star(_larger_star(current)).where("u <> v").distinct(), "links")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
    raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
