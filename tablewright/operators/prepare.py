"""Column steps that need statistics of the table: imputation, scaling, clipping, encoding.

The statistics of one step are gathered in one aggregation and enter the plan as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import casts
from tablewright.functions.names import indicator_label, numbered
from tablewright.operators import aggregates as A
from tablewright.operators import quantiles as Q
from tablewright.operators.columns import replace_columns, require

IMPUTE_STRATEGIES = ("zero", "mean", "median", "mode")
SCALE_METHODS = ("minmax", "zscore")
ONE_HOT_LIMIT = 200
BROADCAST_VALUES = 1000


class TooManyValuesError(ValueError):
    """A column has more distinct values than one-hot encoding allows."""


def _zero(dtype: T.DataType) -> Column | None:
    if casts.is_numeric(dtype):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    return F.lit("0") if isinstance(dtype, T.StringType) else None


def impute(df: DataFrame, strategy: str, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with zero, the mean, the median or the most frequent value."""
    if strategy not in IMPUTE_STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(IMPUTE_STRATEGIES)}")
    require(df, columns)
    return impute_each(df, {c: strategy for c in columns})


def impute_each(df: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """One strategy per column; each kind of statistic is gathered once for all its columns."""
    types = {c: df.schema[c].dataType for c in strategies}
    chosen = {s: [c for c, t in strategies.items() if t == s] for s in IMPUTE_STRATEGIES}
    numbers = {s: [c for c in chosen[s] if casts.is_numeric(types[c])] for s in ("mean", "median")}
    fills: dict[str, Column] = {c: _zero(types[c]) for c in chosen["zero"] if _zero(types[c]) is not None}
    if numbers["mean"]:
        means = A.collect_measures(df, {c: {"m": F.avg(Q.value_column(df, c))} for c in numbers["mean"]})
        fills |= {c: F.lit(means[c]["m"]).cast("double") for c in numbers["mean"]}
    if numbers["median"]:
        medians = Q.exact_quantiles(df, {c: [0.5] for c in numbers["median"]})
        fills |= {c: F.lit(medians[c][0.5]).cast("double") for c in numbers["median"]}
    for c in chosen["mode"]:
        fills[c] = F.lit(A.mode_value(df, c)).cast(types[c])
    return replace_columns(df, {c: F.coalesce(A.field(c), fill) for c, fill in fills.items()}) if fills else df


def normalise(df: DataFrame, method: str, columns: Sequence[str], zero_if_constant: bool = True) -> DataFrame:
    """Scale to [0, 1] or to mean 0 and deviation 1.

    A constant column becomes 0 everywhere, null rows too; with ``zero_if_constant=False`` it
    becomes null, which is what a cleaning setting (as opposed to a step) asks for.
    """
    if method not in SCALE_METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(SCALE_METHODS)}")
    require(df, columns)
    return normalise_each(df, {c: method for c in columns}, zero_if_constant)


def normalise_each(df: DataFrame, methods: dict[str, str], zero_if_constant: bool) -> DataFrame:
    values = {c: Q.value_column(df, c) for c in methods}
    stats = A.collect_measures(df, {
        c: {"shift": F.min(v), "top": F.max(v)} if methods[c] == "minmax"
        else {"shift": F.avg(v), "scale": F.stddev_samp(v)}
        for c, v in values.items()})
    scaled = {}
    for c, m in stats.items():
        scale = m["scale"] if "scale" in m else (None if m["top"] is None else m["top"] - m["shift"])
        v = values[c]
        if scale == 0:
            scaled[c] = F.lit(0.0) if zero_if_constant else F.lit(None).cast("double")
        elif scale is None or m["shift"] is None:
            scaled[c] = F.lit(None).cast("double")
        else:
            scaled[c] = (v - F.lit(m["shift"])) / F.lit(scale)
    return replace_columns(df, scaled)


def clip_outliers(df: DataFrame, columns: Sequence[str], lower: float, upper: float) -> DataFrame:
    """Pull values outside two linear quantiles back to them."""
    if not 0.0 <= lower < upper <= 1.0:
        raise ValueError(f"quantiles have to fulfil 0 <= lower < upper <= 1, got {lower} and {upper}")
    require(df, columns)
    bounds = Q.exact_quantiles(df, {c: [lower, upper] for c in columns})
    clipped = {}
    for c in columns:
        low, high = bounds[c][lower], bounds[c][upper]
        if low is None:
            continue
        v = Q.value_column(df, c)
        clipped[c] = F.when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v)
    return replace_columns(df, clipped) if clipped else df


# ---------------------------------------------------------------- categories

def category_values(df: DataFrame, column: str, limit: int = ONE_HOT_LIMIT) -> list[str]:
    """Sorted distinct values; the limit is checked before anything larger reaches the driver."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise ValueError(f"one-hot encoding needs a string column, {column!r} is "
                         f"{df.schema[column].dataType.simpleString()}")
    rows = (df.select(A.field(column).alias("v")).where("v IS NOT NULL").distinct()
            .limit(limit + 1).collect())
    if len(rows) > limit:
        raise TooManyValuesError(
            f"column {column!r} has more than {limit} distinct values; group rare values first")
    return sorted(r["v"] for r in rows)


def one_hot_encode(df: DataFrame, columns: Sequence[str], drop_original: bool = True,
                   limit: int = ONE_HOT_LIMIT, clean_labels: bool = True) -> DataFrame:
    """One 0/1 column per value; null rows are 0 in all of them.  All columns in one projection."""
    require(df, columns)
    taken = set(df.columns)
    indicators = []
    for column in columns:
        for value in category_values(df, column, limit):
            label = indicator_label(value) if clean_labels else value
            name = numbered(f"{column}_{label}", taken)
            hit = F.when(A.field(column) == F.lit(value), 1).otherwise(0).cast("int")
            indicators.append(hit.alias(name))
    gone = set(columns) if drop_original else set()
    return df.select(*[A.field(c) for c in df.columns if c not in gone], *indicators)


def cap_rare_values(df: DataFrame, column: str, threshold: int, other: str = "Other",
                    broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """Replace values that occur fewer than ``threshold`` times.

    Values are counted with map-side combine.  If few values stay, they are broadcast.  If many
    stay, those above a share of all rows are still few and are broadcast, while the rest, none
    of which can be hot, is looked up by a shuffle join.
    """
    require(df, [column])
    c = A.field(column)
    counts = df.where(c.isNotNull()).groupBy(c.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    kept = counts.where(F.col("__n") >= threshold)
    size = kept.agg(F.count(F.lit(1)), F.sum("__n")).first()
    if size[0] <= broadcast_values:
        frequent = [r["__v"] for r in kept.select("__v").collect()]
        capped = F.when(c.isNull() | c.isin(frequent), c).otherwise(F.lit(other)) if frequent else (
            F.when(c.isNotNull(), F.lit(other)))
        return replace_columns(df, {column: capped})
    hot_above = size[1] // broadcast_values      # at most ``broadcast_values`` values exceed this
    hot = [r["__v"] for r in kept.where(F.col("__n") > hot_above).select("__v").collect()]
    settled = c.isNull() | c.isin(hot) if hot else c.isNull()
    # Settled rows get a spread of negative keys, so that no join task receives a hot value.
    looked_up = df.withColumn("__key", F.when(settled, F.lit(None)).otherwise(c))
    spread = F.when(settled, F.concat(F.lit("\u0000"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
                                      .cast("string"))).otherwise(F.col("__key"))
    joined = looked_up.withColumn("__key", spread).join(
        kept.select(F.col("__v").alias("__key"), F.lit(True).alias("__kept")), "__key", "left")
    result = F.when(settled | F.col("__kept"), c).otherwise(F.lit(other))
    return joined.select(*[result.alias(column) if n == column else A.field(n) for n in df.columns])
