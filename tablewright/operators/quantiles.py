"""Exact quantiles, order statistics and trimmed means without sorting the table.

Columns with at most ``STATE_LIMIT`` distinct values are reduced to (value, count) pairs, which
are sorted and summed up per column.  The ranks of all other columns are selected jointly: the
values of all columns are stacked and counted by ordered buckets, (column, bucket) at a time,
and every rank goes on in the bucket that holds it.  The first buckets are sixteenths of powers
of two, the next ones cut the range of values that a bucket really has into ``PARTS``; so after
one round and three or four more, whatever the values, every bucket is a single value.  A round
is one scan for all ranks of all columns, with map-side combine; no row is shuffled and nothing
is dropped, sampled or estimated.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.aggregates import as_double, batches, collect_measures, field, stacked

STATE_LIMIT = 1_000_000
PARTS = 65_536
# approx_count_distinct has a relative error of 5 % (one standard deviation).
DISTINCT_MARGIN = 1.25


def value_column(df: DataFrame, name: str) -> Column:
    return as_double(field(name), df.schema[name].dataType)


def column_sizes(df: DataFrame, columns: Sequence[str],
                 state_limit: int = STATE_LIMIT) -> dict[str, tuple[int, int]]:
    """(non-null rows, upper estimate of distinct values) per column, from one scan.

    The row count bounds the distinct values of a small table; only beyond the limit does the
    sketch say anything.
    """
    if not columns:
        return {}
    rows = (stacked(df, [value_column(df, name) for name in columns]).groupBy("i")
            .agg(F.count("v").alias("n"), F.approx_count_distinct("v").alias("d")).collect())
    found = {columns[r["i"]]: (r["n"], r["d"] if r["n"] > state_limit else r["n"]) for r in rows}
    return {name: found.get(name, (0, 0)) for name in columns}


def _long_array(values: Iterable[int]) -> str:
    return "array(" + ", ".join(f"{v}L" for v in values) + ")"


@dataclass
class Ranked:
    """What one pass over the sorted (value, count) pairs of a column yields."""

    distinct: int
    at: dict[int, float]
    kept_sum: float | None


def rank_values(df: DataFrame, ranks: dict[str, Sequence[int]],
                keep: dict[str, tuple[int, int]] | None = None) -> dict[str, Ranked]:
    """Values at 0-based ranks, and the sum over a range of ranks, for several columns.

    One scan reduces all columns to distinct values before the shuffle, so the sort per column
    sees distinct values only; callers guarantee that these are few (``STATE_LIMIT``).
    """
    keep = keep or {}
    names = list(ranks)
    result: dict[str, Ranked] = {}
    for group in batches(names, 40):
        pairs = (stacked(df, [value_column(df, name) for name in group]).where("v IS NOT NULL")
                 .groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
        wanted = [sorted(set(ranks[name])) for name in group]
        width = max(1, max(map(len, wanted)))
        bounds = [keep.get(name, (0, -1)) for name in group]
        placed = pairs.select(
            "i", "v", "n", F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(
                Window.unboundedPreceding, 0)).alias("upto")
        ).selectExpr("i", "v", "upto", "upto - n AS start")
        first, last = (f"{_long_array(b[k] for b in bounds)}[i]" for k in (0, 1))
        overlap = f"greatest(0L, least(upto, {last} + 1) - greatest(start, {first}))"
        hit = []
        for j in range(width):
            rank = f"{_long_array(w[j] if j < len(w) else -1 for w in wanted)}[i]"
            hit.append(F.expr(f"max(CASE WHEN start <= {rank} AND {rank} < upto THEN v END)").alias(f"r{j}"))
        rows = placed.groupBy("i").agg(F.count(F.lit(1)).alias("distinct"),
                                       F.expr(f"sum(v * {overlap})").alias("kept"), *hit).collect()
        for row in rows:
            i = row["i"]
            result[group[i]] = Ranked(row["distinct"],
                                      {r: row[f"r{j}"] for j, r in enumerate(wanted[i])}, row["kept"])
    return result


def _first_bucket(v: Column) -> Column:
    """Sixteenths of powers of two, in the order of the values: a monotone function."""
    size = F.floor((F.log2(F.abs(v)) + 1100) * 16).cast("bigint")
    ends = F.when(v == float("inf"), 1 << 20).when(v == float("-inf"), -(1 << 20))
    return ends.when(v > 0, size).when(v < 0, -size).otherwise(0).cast("bigint")


def select_ranks(df: DataFrame, wanted: dict[str, Sequence[int]], parts: int = PARTS) -> dict[str, dict[int, float]]:
    """Value at each 0-based rank (below the number of non-null rows) of all columns at once; a scan per round."""
    names = [n for n, ranks in wanted.items() if ranks]
    done: dict[str, dict[int, float]] = {n: {} for n in wanted}
    spark = df.sparkSession
    values = stacked(df, [value_column(df, n) for n in names]).where("v IS NOT NULL") if names else None
    # (column, interval, place of the rank inside, rank), and per interval its least and largest value.
    open_ = [(i, 0, r, r) for i, n in enumerate(names) for r in sorted(set(wanted[n]))]
    bounds: list[tuple] | None = None
    while open_:
        if bounds is None:
            cut = values.select("i", F.lit(0).alias("k"), _first_bucket(F.col("v")).alias("b"), "v")
        else:  # as many rows as there are open ranks
            ends = spark.createDataFrame(bounds, "j int, k int, low double, high double")
            share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
            cut = values.join(F.broadcast(ends), (F.col("i") == F.col("j")) & (F.col("v") >= F.col("low"))
                              & (F.col("v") <= F.col("high"))).select(
                "i", "k", F.floor(share * parts).cast("bigint").alias("b"), "v")
        buckets = cut.groupBy("i", "k", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("i", "k").orderBy("b"))
        placed = buckets.select("i", "k", "b", "low", "high", (upto - F.col("n")).alias("start"), upto.alias("end"))
        ranks = spark.createDataFrame(open_, "i int, k int, place bigint, rank bigint")
        found = placed.join(F.broadcast(ranks), ["i", "k"]).where("start <= place AND place < end").select(
            "i", "rank", "low", "high", (F.col("place") - F.col("start")).alias("place")).collect()
        open_, numbers = [], {}
        for row in found:
            if row["low"] == row["high"]:
                done[names[row["i"]]][row["rank"]] = row["low"]
            else:
                key = (row["i"], row["low"], row["high"])
                open_.append((row["i"], numbers.setdefault(key, len(numbers)), row["place"], row["rank"]))
        bounds = [(i, k, low, high) for (i, low, high), k in numbers.items()]
    return done


def few_values(size: tuple[int, int], state_limit: int = STATE_LIMIT) -> bool:
    """Whether a column of (rows, distinct values) may be sorted by its distinct values."""
    return min(size[0], size[1] * DISTINCT_MARGIN) <= state_limit


def order_statistics(df: DataFrame, wanted: dict[str, Sequence[int]],
                     sizes: dict[str, tuple[int, int]] | None = None,
                     state_limit: int = STATE_LIMIT,
                     accuracy: int = PARTS) -> dict[str, dict[int, float]]:
    """Value at each 0-based rank of each column's sorted non-null values; ``accuracy`` is the number of parts into
    which a round of selection cuts a bucket."""
    sizes = sizes or column_sizes(df, list(wanted), state_limit)
    inside = {name: [r for r in ranks if 0 <= r < sizes[name][0]] for name, ranks in wanted.items()}
    done: dict[str, dict[int, float]] = {name: {} for name in wanted}
    direct = {n: r for n, r in inside.items() if r and few_values(sizes[n], state_limit)}
    if direct:
        done.update({name: found.at for name, found in rank_values(df, direct).items()})
    done.update(select_ranks(df, {n: r for n, r in inside.items() if r and n not in direct}, accuracy))
    return done


def exact_quantiles(df: DataFrame, requests: dict[str, Sequence[float]],
                    sizes: dict[str, tuple[int, int]] | None = None,
                    state_limit: int = STATE_LIMIT,
                    accuracy: int = PARTS) -> dict[str, dict[float, float | None]]:
    """Linearly interpolated quantiles per column."""
    if not requests:
        return {}
    sizes = sizes or column_sizes(df, list(requests), state_limit)
    ranks = {name: [r for p in ps for r in neighbours(p, sizes[name][0])] if sizes[name][0] else []
             for name, ps in requests.items()}
    stats = order_statistics(df, ranks, {n: sizes[n] for n in requests}, state_limit, accuracy)
    return {name: {p: interpolated(stats[name], p, sizes[name][0]) for p in ps}
            for name, ps in requests.items()}


def interpolated(at: dict[int, float], p: float, n: int) -> float | None:
    if not n:
        return None
    low, high = neighbours(p, n)
    return at[low] + (at[high] - at[low]) * (p * (n - 1) - low)


def neighbours(p: float, n: int) -> tuple[int, int]:
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def trim_ranks(n: int, share: float) -> tuple[int, int] | None:
    """First and last rank kept, or None if nothing is cut (or everything would be)."""
    k = int(n * share) if share > 0 else 0
    return (k, n - k - 1) if 0 < k and 2 * k < n else None


def trimmed_means(df: DataFrame, columns: Sequence[str], share: float,
                  sizes: dict[str, tuple[int, int]] | None = None,
                  state_limit: int = STATE_LIMIT,
                  accuracy: int = PARTS) -> dict[str, float | None]:
    """Mean after cutting ``int(n * share)`` values from each end.

    Beyond the state limit two order statistics mark the cuts; ties at a cut value are kept in
    part, as many as fall inside the kept ranks.
    """
    sizes = sizes or column_sizes(df, columns, state_limit)
    ends = {name: trim_ranks(sizes[name][0], share) for name in columns}
    result: dict[str, float | None] = {}
    plain = [name for name in columns if ends[name] is None]
    if plain:
        means = collect_measures(df, {n: {"m": F.avg(value_column(df, n))} for n in plain})
        result.update({n: means[n]["m"] for n in plain})
    direct = [n for n in columns if ends[n] and
              min(sizes[n][0], sizes[n][1] * DISTINCT_MARGIN) <= state_limit]
    if direct:
        for name, found in rank_values(df, {n: [] for n in direct}, {n: ends[n] for n in direct}).items():
            result[name] = found.kept_sum / (ends[name][1] - ends[name][0] + 1)
    large = [n for n in columns if ends[n] and n not in direct]
    if large:
        stats = order_statistics(df, {n: ends[n] for n in large}, {n: sizes[n] for n in large}, state_limit, accuracy)
        result.update(means_between(df, {n: ends[n] for n in large}, stats, sizes))
    return result


def means_between(df: DataFrame, ends: dict[str, tuple[int, int]], stats: dict[str, dict[int, float]],
                  sizes: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Mean of the values from the first to the last rank of each column, whose values are known; one scan for all."""
    names = list(ends)
    if not names:
        return {}
    cuts = {n: tuple(stats[n][r] for r in ends[n]) for n in names}
    limits = df.sparkSession.createDataFrame([(i, *cuts[n]) for i, n in enumerate(names)], "j int, low double, high double")
    v, low, high = F.col("v"), F.col("low"), F.col("high")
    rows = (stacked(df, [value_column(df, n) for n in names]).join(F.broadcast(limits), F.col("i") == F.col("j")).groupBy("i")
            .agg(F.count_if(v <= low).alias("up_to_low"), F.count_if(v < high).alias("below_high"),
                 F.coalesce(F.sum(F.when((v > low) & (v < high), v)), F.lit(0.0)).alias("between")).collect())
    result = {}
    for row in rows:
        name = names[row["i"]]
        (first, last), (low, high) = ends[name], cuts[name]
        total = row["between"] + low * (row["up_to_low"] - first) + high * (last + 1 - row["below_high"])
        result[name] = low if low == high else total / (last - first + 1)
    return result
