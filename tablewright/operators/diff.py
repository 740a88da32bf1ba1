"""Differences between two tables: schema, row counts, rows by key, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import casts
from tablewright.operators import aggregates as A
from tablewright.operators import quantiles as Q


def schema_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)],
        "position int, name string, type string")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change, old_type, new_type) with change added, removed, type_changed or unchanged."""
    a = schema_table(old).select("name", F.col("type").alias("old_type"))
    b = schema_table(new).select("name", F.col("type").alias("new_type"))
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
              .when(F.col("old_type") != F.col("new_type"), "type_changed").otherwise("unchanged"))
    return a.join(b, "name", "full_outer").select("name", change.alias("change"), "old_type", "new_type")


def _column_digests(df: DataFrame, names: Sequence[str]) -> DataFrame:
    parts = []
    for batch in A.batches(list(names), A.AGGREGATES_PER_PASS // 3):
        aggs = [agg for i, c in enumerate(batch) for agg in A.fingerprint_columns(f"c{i}", F.struct(A.field(c).alias("v")))]
        rows = F.array(*[
            F.struct(F.lit(c).alias("name"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                     F.concat_ws("|", F.col(f"c{i}_xor").cast("string"), F.col(f"c{i}_sum").cast("string"),
                                 F.col(f"c{i}_n").cast("string")).alias("digest"))
            for i, c in enumerate(batch)])
        parts.append(df.agg(*aggs).select(F.inline(rows)))
    return A.union_all(parts)


def schema_rename_detect(old: DataFrame, new: DataFrame) -> DataFrame:
    """Removed and added columns of the same type with the same multiset of values.

    A digest shared by several columns on one side is ambiguous and gives no rename.
    """
    removed = [c for c in old.columns if c not in new.columns]
    added = [c for c in new.columns if c not in old.columns]
    if not removed or not added:
        return old.sparkSession.createDataFrame([], "old_name string, new_name string, type string")

    def unique(df: DataFrame, names: Sequence[str], label: str) -> DataFrame:
        return (_column_digests(df, names).groupBy("type", "digest")
                .agg(F.min("name").alias(label), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n"))

    return (unique(old, removed, "old_name").join(unique(new, added, "new_name"), ["type", "digest"])
            .select("old_name", "new_name", "type"))


def diff_row_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    one = F.count(F.lit(1))
    both = (old.agg(one.alias("n")).select(F.lit("old").alias("side"), "n")
            .union(new.agg(one.alias("n")).select(F.lit("new").alias("side"), "n")))
    n = {side: F.max(F.when(F.col("side") == side, F.col("n"))) for side in ("old", "new")}
    return both.agg(n["old"].alias("rows_old"), n["new"].alias("rows_new")).select(
        "rows_old", "rows_new",
        F.greatest(F.col("rows_new") - F.col("rows_old"), F.lit(0)).alias("net_added"),
        F.greatest(F.col("rows_old") - F.col("rows_new"), F.lit(0)).alias("net_removed"))


# ---------------------------------------------------------------- rows by key

def key_states(old: DataFrame, new: DataFrame, keys: Sequence[str],
               columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key with the change and the number of rows on both sides.

    Both tables are stacked and reduced to counts and digests per key before the one shuffle,
    so a key that fills a third of the rows costs one record per task, and no pair of rows is
    ever formed.  Rows of one key compare as multisets.
    """
    if columns is None:
        columns = [c for c in old.columns if c in new.columns and c not in keys]
    names = list(columns)

    def side(df: DataFrame, sign: int) -> DataFrame:
        digest = F.xxhash64(F.struct(*[A.field(c) for c in names])) if names else F.lit(0).cast("bigint")
        return df.select(*[A.field(k) for k in keys], F.lit(sign).alias("__side"), digest.alias("__digest"))

    stacked = side(old, -1).unionByName(side(new, 1))
    is_old, is_new, d = F.col("__side") == -1, F.col("__side") == 1, F.col("__digest")
    wide = d.cast("decimal(20,0)")
    states = stacked.groupBy(*[A.field(k) for k in keys]).agg(
        F.count_if(is_old).alias("old_rows"), F.count_if(is_new).alias("new_rows"),
        F.bit_xor(d).alias("__xor"),
        F.sum(F.when(is_new, wide).otherwise(-wide)).alias("__sum"))
    same = (F.col("old_rows") == F.col("new_rows")) & (F.col("__xor") == 0) & (F.col("__sum") == 0)
    change = (F.when(F.col("old_rows") == 0, "added").when(F.col("new_rows") == 0, "removed")
              .when(same, "unchanged").otherwise("modified"))
    return states.withColumn("change", change).drop("__xor", "__sum")


def diff_rows_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str],
                     columns: Sequence[str] | None = None) -> DataFrame:
    """(change, keys, old_rows, new_rows) for added, removed, modified and unchanged keys."""
    return (key_states(old, new, keys, columns).groupBy("change")
            .agg(F.count(F.lit(1)).alias("keys"), F.sum("old_rows").alias("old_rows"),
                 F.sum("new_rows").alias("new_rows")))


def sample_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], per_change: int = 10,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """Up to ``per_change`` keys of each change with the columns that differ, before and after.

    The sampled keys are few by construction, so they are broadcast to both tables.  A key with several rows has a multiset
    of values per column: what one side has more of is shown, the smallest of it on each.  Where no column differs and rows do, a row
    that went and one that came are shown whole, under the column name null.
    """
    names = list(columns or [c for c in old.columns if c in new.columns and c not in keys])
    states = key_states(old, new, keys, names)
    order = Window.partitionBy("change").orderBy(*[A.field(k) for k in keys])
    picked = (states.where(F.col("change") != "unchanged").withColumn("__rank", F.row_number().over(order))
              .where(F.col("__rank") <= per_change).drop("__rank"))
    chosen = old.sparkSession.createDataFrame(picked.collect(), picked.schema)

    def side(df: DataFrame, more: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), A.field(c).cast("string").alias("value")) for i, c in enumerate(names)],
                        F.struct(F.lit(len(names)).alias("i"), F.to_json(F.struct(*[A.field(c) for c in names])).alias("value")))
        hit = df.select(*[A.field(k).alias(f"k{j}") for j, k in enumerate(keys)], F.explode(cells).alias("cell"))
        few = chosen.select(*[A.field(k).alias(f"c{j}") for j, k in enumerate(keys)])
        same = reduce(and_, [F.col(f"k{j}").eqNullSafe(F.col(f"c{j}")) for j in range(len(keys))])
        return hit.join(F.broadcast(few), same, "left_semi").withColumn("more", F.lit(more))

    own = [f"k{j}" for j in range(len(keys))]
    surplus = (side(old, 1).unionByName(side(new, -1)).groupBy(*own, "cell").agg(F.sum("more").alias("more")).where("more <> 0")
               .groupBy(*own, "cell.i").agg(F.min(F.when(F.col("more") > 0, F.col("cell.value"))).alias("before"),
                                            F.min(F.when(F.col("more") < 0, F.col("cell.value"))).alias("after")))
    name = F.array(*[F.lit(c) for c in names], F.lit(None).cast("string"))
    listed = surplus.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("i", "before", "after"))).alias("cells"))
    shown = F.filter("cells", lambda x: (x["i"] < len(names)) & ~x["before"].eqNullSafe(x["after"]))
    rows = F.filter("cells", lambda x: x["i"] == len(names))
    listed = listed.select(*own, F.transform(F.when(F.size(shown) > 0, shown).otherwise(rows), lambda x: F.struct(
        name[x["i"]].alias("column"), x["before"].alias("before"), x["after"].alias("after"))).alias("changes"))
    same = reduce(and_, [A.field(k).eqNullSafe(F.col(f"k{j}")) for j, k in enumerate(keys)])
    none = F.array().cast("array<struct<column:string,before:string,after:string>>")
    return chosen.join(listed, same, "left").select(*[A.field(k) for k in keys], "change", F.coalesce("changes", none).alias("changes"))


# ---------------------------------------------------------------- statistics

def mean_shift(old: DataFrame, new: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, median and deviation of the common numeric columns before and after."""
    if columns is None:
        both = set(new.columns)
        columns = [c for c in A.numeric_columns(old)
                   if c in both and casts.is_numeric(new.schema[c].dataType)]
    rows = []
    before, after = A.run_jobs(old.sparkSession, [lambda: _shift_stats(old, columns), lambda: _shift_stats(new, columns)])
    for c in columns:
        a, b = before[c], after[c]
        change = None
        if a["mean"] not in (None, 0.0) and b["mean"] is not None:
            change = (b["mean"] - a["mean"]) / a["mean"] * 100.0
        rows.append((c, a["mean"], b["mean"], change, a["median"], b["median"], a["sd"], b["sd"]))
    return old.sparkSession.createDataFrame(
        rows, "column string, mean_old double, mean_new double, change_pct double, "
              "median_old double, median_new double, stddev_old double, stddev_new double")


def _shift_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    stats = A.collect_measures(df, {
        c: {"mean": F.avg(Q.value_column(df, c)), "sd": F.stddev_samp(Q.value_column(df, c)),
            "n": F.count(Q.value_column(df, c))}
        for c in columns})
    sizes = {c: (stats[c]["n"], stats[c]["n"]) for c in columns}
    if any(n > Q.STATE_LIMIT for n, _ in sizes.values()):
        sizes = Q.column_sizes(df, columns)
    medians = Q.exact_quantiles(df, {c: [0.5] for c in columns}, sizes)
    for c in columns:
        stats[c]["median"] = medians[c][0.5]
    return stats
