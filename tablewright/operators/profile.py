"""Column profiles: one row per column from a handful of aggregations over the whole table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import casts
from tablewright.functions.names import standard_names
from tablewright.operators import aggregates as A
from tablewright.operators import quantiles as Q
from tablewright.session import durable, ship

# Thresholds and sizes of the profile.
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
TRIM_SHARE = 0.05
MIN_BINS, MAX_BINS = 5, 50
CONSTANT_BINS, CONSTANT_BIN = 20, 10
TIMELINE_BINS = 20
CATEGORY_DISTINCT, CATEGORY_RATIO = 100, 0.05
FREQUENCY_LIMIT = 1000
SAMPLE_ROWS, SAMPLE_VALUES = 100, 10

_BIN = T.StructType([T.StructField("bin_start", T.DoubleType()),
                     T.StructField("count", T.LongType())])

_NUMERIC = T.StructType([
    *[T.StructField(n, T.DoubleType()) for n in (
        "min", "max", "mean", "sum", "median", "stddev", "p05", "q1", "q3", "p95",
        "trimmed_mean", "skew")],
    T.StructField("zero_count", T.LongType()),
    T.StructField("negative_count", T.LongType()),
    T.StructField("is_integer", T.BooleanType()),
    T.StructField("bin_width", T.DoubleType()),
    T.StructField("histogram", T.ArrayType(_BIN)),
])

_TEXT = T.StructType([
    T.StructField("min_length", T.LongType()),
    T.StructField("max_length", T.LongType()),
    T.StructField("avg_length", T.DoubleType()),
    T.StructField("top_value", T.StringType()),
    T.StructField("top_count", T.LongType()),
    T.StructField("min_frequency", T.LongType()),
    T.StructField("max_frequency", T.LongType()),
])

_TEMPORAL = T.StructType([
    T.StructField("min", T.TimestampType()),
    T.StructField("max", T.TimestampType()),
    T.StructField("p05", T.DoubleType()),
    T.StructField("p95", T.DoubleType()),
    T.StructField("bin_width", T.DoubleType()),
    T.StructField("timeline", T.ArrayType(_BIN)),
])

_BOOLEAN = T.StructType([T.StructField("true_count", T.LongType()),
                         T.StructField("false_count", T.LongType())])

PROFILE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("standard_name", T.StringType()),
    T.StructField("spark_type", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("nan_count", T.LongType()),
    T.StructField("null_pct", T.DoubleType()),
    T.StructField("distinct_count", T.LongType()),
    T.StructField("uniqueness_ratio", T.DoubleType()),
    T.StructField("has_special", T.BooleanType()),
    T.StructField("has_control", T.BooleanType()),
    T.StructField("is_sorted", T.BooleanType()),
    T.StructField("is_sorted_desc", T.BooleanType()),
    T.StructField("numeric", _NUMERIC),
    T.StructField("text", _TEXT),
    T.StructField("temporal", _TEMPORAL),
    T.StructField("boolean", _BOOLEAN),
    T.StructField("frequency", T.MapType(T.StringType(), T.LongType())),
    T.StructField("frequency_truncated", T.BooleanType()),
    T.StructField("samples", T.ArrayType(T.StringType())),
])


# ---------------------------------------------------------------- shape of a distribution

def skew_estimate(mean, median, q1, q3, stddev) -> float | None:
    """Mean of Pearson's and Bowley's skew; Pearson's alone where the quartiles coincide."""
    if mean is None or median is None or not stddev or not stddev > 0:
        return None
    pearson = 3.0 * (mean - median) / stddev
    if q1 is None or q3 is None or not q3 - q1 > 0:
        return pearson
    return (pearson + (q3 + q1 - 2.0 * median) / (q3 - q1)) / 2.0


@dataclass(frozen=True)
class Bins:
    start: float
    width: float
    count: int
    fixed: int | None = None    # all rows fall into this bin

    def starts(self) -> list[float]:
        return [self.start + i * self.width for i in range(self.count)]


def histogram_bins(low, high, q1, q3, n: int) -> Bins | None:
    """Freedman-Diaconis bins between 5 and 50; a constant column gets 20 bins around it."""
    if low is None or high is None:
        return None
    span = high - low
    if abs(span) < 2.220446049250313e-16:
        return Bins(low - CONSTANT_BIN, 1.0, CONSTANT_BINS, CONSTANT_BIN)
    iqr = (q3 if q3 is not None else high) - (q1 if q1 is not None else low)
    step = 2.0 * iqr / math.cbrt(n) if iqr > 0 else span / math.sqrt(n)
    wanted = math.ceil(span / step) if span / step < MAX_BINS else MAX_BINS
    count = max(MIN_BINS, min(MAX_BINS, wanted))
    return Bins(low, span / count, count)


def timeline_bins(low, high) -> Bins | None:
    if low is None or high is None or not high > low:
        return None
    return Bins(low, (high - low) / TIMELINE_BINS, TIMELINE_BINS)


def bin_counts(df: DataFrame, bins: dict[str, Bins]) -> DataFrame:
    """(column, bin, n) for the non-empty bins of several columns, in one scan.

    At most 50 bins per column exist, so every task sends that many rows.
    """
    parts = []
    for names in A.batches(list(bins), 60):
        places = []
        for name in names:
            b, v = bins[name], Q.value_column(df, name)
            place = F.lit(b.fixed) if b.fixed is not None else F.least(
                F.floor((v - b.start) / b.width), F.lit(b.count - 1))
            places.append(F.when(v.isNotNull(), place.cast("int")))
        label = F.array(*[F.lit(n) for n in names])
        parts.append(A.stacked(df, places).where("v IS NOT NULL").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
                     .select(label[F.col("i")].alias("column"), F.col("v").alias("bin"), "n"))
    return A.union_all(parts)


def collect_histograms(df: DataFrame, bins: dict[str, Bins]) -> dict[str, list[tuple[float, int]]]:
    if not bins:
        return {}
    counted = {(r["column"], r["bin"]): r["n"] for r in bin_counts(df, bins).collect()}
    return {name: [(start, counted.get((name, i), 0)) for i, start in enumerate(b.starts())]
            for name, b in bins.items()}


def numeric_bins(df: DataFrame, columns: Sequence[str]) -> dict[str, Bins]:
    ends = A.collect_measures(df, {
        n: {"min": F.min(Q.value_column(df, n)), "max": F.max(Q.value_column(df, n))}
        for n in columns})
    sizes = Q.column_sizes(df, columns)
    qs = Q.exact_quantiles(df, {n: [0.25, 0.75] for n in columns if sizes[n][0]}, sizes)
    bins = {n: histogram_bins(ends[n]["min"], ends[n]["max"], qs[n][0.25], qs[n][0.75], sizes[n][0])
            for n in qs}
    return {n: b for n, b in bins.items() if b is not None}


def _bin_rows(df: DataFrame, bins: dict[str, Bins]) -> DataFrame:
    """All bins, empty ones included, as (column, bin, bin_start, n)."""
    spark = df.sparkSession
    frame = spark.createDataFrame(
        [(name, i, start) for name, b in bins.items() for i, start in enumerate(b.starts())],
        "column string, bin int, bin_start double")
    counts = bin_counts(df, bins)
    return (frame.join(counts, ["column", "bin"], "left")
            .select("column", "bin", "bin_start", F.coalesce("n", F.lit(0)).alias("n")))


def histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _bin_rows(df, numeric_bins(df, columns))


def timeline(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    ends = A.collect_measures(df, {n: {"min": F.min(Q.value_column(df, n)),
                                       "max": F.max(Q.value_column(df, n))} for n in columns})
    bins = {n: timeline_bins(m["min"], m["max"]) for n, m in ends.items()}
    return _bin_rows(df, {n: b for n, b in bins.items() if b is not None})


# ---------------------------------------------------------------- the profile

_TABLE = "\0table"      # key of the measures of the table as a whole


def _first_pass(df: DataFrame, kinds: dict[str, str]) -> tuple[int, dict[str, dict]]:
    """Number of rows and the plain measures of every column."""
    wanted: dict[str, dict] = {_TABLE: {"rows": F.count(F.lit(1))}}
    for name, kind in kinds.items():
        c = A.field(name)
        exprs = {"nulls": F.count_if(c.isNull())}
        if kind in ("Numeric", "Temporal"):
            v = Q.value_column(df, name)
            exprs |= {"n": F.count(v), "min": F.min(v), "max": F.max(v)}
        if kind == "Numeric":
            v = Q.value_column(df, name)
            exprs |= {"mean": F.avg(v), "sum": F.sum(v), "stddev": F.stddev_samp(v),
                      "zero": F.count_if(v == 0), "negative": F.count_if(v < 0),
                      "integer": F.coalesce(F.bool_and(v == F.floor(v)), F.lit(True))}
            if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
                exprs["nan"] = F.count_if(F.isnan(c))
        if kind == "Temporal":
            exprs |= {"first": F.min(c.cast("timestamp")), "last": F.max(c.cast("timestamp"))}
        if kind == "Boolean":
            exprs |= {"true": F.count_if(c), "false": F.count_if(~c)}
        if kind == "Text":
            exprs |= {m: A.MEASURES[m](c) for m in
                      ("min_length", "max_length", "avg_length", "has_special", "has_control")}
        wanted[name] = exprs
    found = A.collect_measures(df, wanted)
    return found.pop(_TABLE)["rows"], found


def _wanted_shares(numeric: Sequence[str], temporal: Sequence[str]) -> dict[str, tuple]:
    return {n: QUANTILES for n in numeric} | {n: (0.05, 0.95) for n in temporal}


def _kept_ranks(n: int) -> tuple[int, int]:
    return Q.trim_ranks(n, TRIM_SHARE) or (0, n - 1)


def _ranked_job(df: DataFrame, numeric: Sequence[str], temporal: Sequence[str],
                rows: dict[str, int]) -> dict[str, Q.Ranked]:
    wanted = _wanted_shares(numeric, temporal)
    ranks = {n: [r for p in wanted[n] for r in Q.neighbours(p, rows[n])] for n in wanted}
    return Q.rank_values(df, ranks, {n: _kept_ranks(rows[n]) for n in wanted}) if wanted else {}


def _ranked_part(df: DataFrame, numeric: Sequence[str], temporal: Sequence[str],
                 sizes: dict[str, tuple[int, int]], ranked: dict[str, Q.Ranked]) -> tuple[dict, dict]:
    """Quantiles and trimmed means; one shared job for all columns of bounded cardinality."""
    wanted = _wanted_shares(numeric, temporal)
    small = [n for n in wanted if n not in ranked and sizes[n][1] <= Q.STATE_LIMIT]
    large = [n for n in wanted if n not in ranked and n not in small]
    ranked = ranked | _ranked_job(df, [n for n in numeric if n in small],
                                  [n for n in temporal if n in small], {n: sizes[n][0] for n in small})
    quantiles: dict[str, dict] = {}
    trimmed: dict[str, float | None] = {}
    for name in wanted:
        if name in ranked:
            found, n = ranked[name], sizes[name][0]
            first, last = _kept_ranks(n)
            quantiles[name] = {p: Q.interpolated(found.at, p, n) for p in wanted[name]}
            trimmed[name] = found.kept_sum / (last - first + 1)
    if large:  # the ranks of quantiles and of trimmed ends are selected together
        ends = {n: _kept_ranks(sizes[n][0]) for n in large if n in numeric}
        ranks = {n: [r for p in wanted[n] for r in Q.neighbours(p, sizes[n][0])] + list(ends.get(n, ())) for n in large}
        stats = Q.select_ranks(df, ranks)
        quantiles |= {n: {p: Q.interpolated(stats[n], p, sizes[n][0]) for p in wanted[n]} for n in large}
        trimmed |= Q.means_between(df, ends, stats, sizes)
    return quantiles, trimmed


def _samples(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] | None) -> dict[str, list[str]]:
    head = df.orderBy(*[A.field(k) for k in order_by]) if order_by else df
    rows = head.limit(SAMPLE_ROWS).select(
        *[(F.to_json(A.field(c)) if casts.base_kind(df.schema[c].dataType) == "Nested"
           else A.field(c).cast("string")).alias(f"s{i}") for i, c in enumerate(columns)]).collect()
    return {c: [r[i] for r in rows if r[i] is not None][:SAMPLE_VALUES] for i, c in enumerate(columns)}


def profile_rows(df: DataFrame, order_by: Sequence[str] | None = None) -> list[tuple]:
    """The profile as plain rows, one per column; see ``PROFILE_SCHEMA``."""
    columns = df.columns
    kinds = {f.name: casts.base_kind(f.dataType) for f in df.schema}
    rows_total, first = _first_pass(df, kinds)

    plain = [n for n in columns if kinds[n] in ("Numeric", "Temporal")]
    flat = [n for n in plain if first[n]["n"]]
    # A table of few rows has few distinct values: its ranks can be taken at once, and the
    # number of distinct values falls out of the same job.
    ranked: dict[str, Q.Ranked] = {}
    distinct: dict[str, int] = {}
    if rows_total <= Q.STATE_LIMIT:
        ranked = _ranked_job(df, [n for n in flat if kinds[n] == "Numeric"],
                             [n for n in flat if kinds[n] == "Temporal"],
                             {n: first[n]["n"] for n in flat})
        distinct = {n: (ranked[n].distinct if n in ranked else 0)
                    + int(first[n]["nulls"] > 0) + int(first[n].get("nan", 0) > 0) for n in plain}
        # Ranks are taken on doubles; values with more digits than those hold are counted as they are.
        types = {f.name: f.dataType for f in df.schema}
        exact = [n for n in flat if isinstance(types[n], T.DecimalType)
                 or isinstance(types[n], T.LongType) and max(abs(first[n]["min"]), abs(first[n]["max"])) >= 2 ** 53]
        for names in A.batches(exact, 50):
            distinct |= {r["column"]: r["distinct_count"] for r in A.distinct_counts(df, names).collect()}
    else:
        for names in A.batches(plain, 50):
            distinct |= {r["column"]: r["distinct_count"] for r in A.distinct_counts(df, names).collect()}
    texts = [n for n in columns if kinds[n] == "Text"]
    summary: dict[str, dict] = {}
    short = [n for n in texts if (first[n]["max_length"] or 0) <= A.LONG_TEXT]
    for names in A.batches(short, 50):
        for r in A.frequency_summary(A.value_counts(df, names)).collect():
            summary[r["column"]] = r.asDict()
    for name in texts:
        if name not in short:
            summary[name] = A.long_text_summary(df, name)

    # Numbers that hold nothing but 0, 1 and null are booleans.
    for name in columns:
        m = first[name]
        if (kinds[name] == "Numeric" and 0 < distinct[name] <= 3
                and (m["min"] or 0.0) >= 0.0 and (m["max"] or 0.0) <= 1.0):
            kinds[name] = "Boolean"
            m["true"] = int(m["sum"] or 0)
            m["false"] = max(0, m["n"] - m["true"])
    for name in texts:
        n = summary.get(name, {}).get("distinct_count", 0)
        if n < CATEGORY_DISTINCT or (rows_total and n / rows_total < CATEGORY_RATIO):
            kinds[name] = "Categorical"

    numeric = [n for n in columns if kinds[n] == "Numeric" and first[n]["n"]]
    temporal = [n for n in columns if kinds[n] == "Temporal" and first[n]["n"]]
    sizes = {n: (first[n]["n"], distinct[n]) for n in numeric + temporal}
    quantiles, trimmed = _ranked_part(df, numeric, temporal, sizes, ranked)

    bins: dict[str, Bins] = {}
    for name in numeric:
        q = quantiles[name]
        bins[name] = histogram_bins(first[name]["min"], first[name]["max"], q[0.25], q[0.75], sizes[name][0])
    for name in temporal:
        b = timeline_bins(first[name]["min"], first[name]["max"])
        if b:
            bins[name] = b
    histograms = collect_histograms(df, bins)

    categories = [n for n in texts if kinds[n] == "Categorical" and summary.get(n, {}).get("value_count")]
    frequencies: dict[str, dict[str, int]] = {n: {} for n in categories}
    for names in A.batches(categories, 50):
        for r in A.value_frequency(df, names, FREQUENCY_LIMIT).orderBy("column", "rank").collect():
            frequencies[r["column"]][r["value"]] = r["n"]

    order = {}
    if order_by:
        from tablewright.operators.ordering import sortedness
        flat = [n for n in columns if kinds[n] in ("Numeric", "Temporal")]
        if flat:
            order = {r["column"]: (r["ascending"], r["descending"])
                     for r in sortedness(df, flat, order_by).collect()}
    samples = _samples(df, columns, order_by)

    result = []
    for position, (name, standard) in enumerate(zip(columns, standard_names(columns))):
        m, kind = first[name], kinds[name]
        n_distinct = None
        if kind in ("Numeric", "Temporal"):
            n_distinct = distinct[name]
        elif kind == "Boolean":
            n_distinct = int(m["true"] > 0) + int(m["false"] > 0)
        elif kind == "Text":
            n_distinct = summary[name]["distinct_count"]
        elif kind == "Categorical":
            n_distinct = summary.get(name, {}).get("value_count", 0)
        numeric_part = temporal_part = text_part = boolean_part = frequency = truncated = None
        if kind == "Numeric":
            q = quantiles.get(name, {})
            skew = skew_estimate(m["mean"], q.get(0.5), q.get(0.25), q.get(0.75), m["stddev"])
            b = bins.get(name)
            numeric_part = (m["min"], m["max"], m["mean"], m["sum"], q.get(0.5), m["stddev"],
                            q.get(0.05), q.get(0.25), q.get(0.75), q.get(0.95), trimmed.get(name),
                            skew, m["zero"], m["negative"], m["integer"],
                            b.width if b else 0.0, histograms.get(name, []))
        elif kind == "Temporal":
            q, b = quantiles.get(name, {}), bins.get(name)
            temporal_part = (m["first"], m["last"], q.get(0.05), q.get(0.95),
                             b.width if b else 0.0, histograms.get(name, []))
        elif kind == "Boolean":
            boolean_part = (m["true"], m["false"])
        elif kind in ("Text", "Categorical"):
            s = summary.get(name, {})
            text_part = (m["min_length"], m["max_length"], m["avg_length"], s.get("top_value"),
                         s.get("top_count"), s.get("min_n"), s.get("max_n"))
            if kind == "Categorical":
                frequency = frequencies.get(name, {})
                truncated = (n_distinct or 0) > FREQUENCY_LIMIT
        ascending, descending = order.get(name, (None, None))
        result.append((
            position, name, standard, df.schema[name].dataType.simpleString(), kind, rows_total,
            m["nulls"], m.get("nan", 0), 100.0 * m["nulls"] / rows_total if rows_total else 0.0,
            n_distinct, n_distinct / rows_total if rows_total and n_distinct is not None else 0.0,
            bool(m.get("has_special", False)), bool(m.get("has_control", False)), ascending, descending,
            numeric_part, text_part, temporal_part, boolean_part, frequency, truncated, samples[name]))
    return result


def profile_table(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per column.  ``order_by`` names the row order for sortedness and samples."""
    return df.sparkSession.createDataFrame(profile_rows(df, order_by), PROFILE_SCHEMA)


def flat_profile(profile: DataFrame) -> DataFrame:
    """The scalar part of a profile in one flat row per column."""
    numeric = ["min", "max", "mean", "sum", "median", "stddev", "p05", "q1", "q3", "p95",
               "trimmed_mean", "skew"]
    return profile.select(
        "name", "standard_name", "kind", "row_count", "null_count", "null_pct", "distinct_count",
        "uniqueness_ratio",
        *[F.round(f"numeric.{n}", 4).alias(f"num_{n}") for n in numeric],
        "numeric.zero_count", "numeric.negative_count", "numeric.is_integer",
        F.round("numeric.bin_width", 4).alias("bin_width"),
        F.size("numeric.histogram").alias("bins"),
        "text.min_length", "text.max_length", F.round("text.avg_length", 4).alias("avg_length"),
        "text.top_value", "text.top_count",
        F.col("temporal.min").alias("first_time"), F.col("temporal.max").alias("last_time"),
        "boolean.true_count", "boolean.false_count", "has_special")


# ---------------------------------------------------------------- correlation

def _comoments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a task and each pair of columns, where both have a value: their number, the mean of either, the
    sum of products of deviations, and the sums of squares.  Batches merge pair by pair, so nothing cancels out."""
    state = None
    for batch in batches:
        for start in range(0, batch.num_rows, 1 << 14):
            part = batch.slice(start, 1 << 14)
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns])
            there = ~np.isnan(x)
            shift = np.where(there, x, 0).sum(0) / np.maximum(there.sum(0), 1)
            x = np.where(there, x - shift, 0)
            there = there.astype(np.float64)
            n = there.T @ there
            some = np.maximum(n, 1)
            left, squares = x.T @ there, (x * x).T @ there  # sums of column i over rows where column j has a value
            mean = left / some
            new = [n, mean + shift[:, None], x.T @ x - left * mean.T, squares - left * mean]
            state = new if state is None else _merged(state, new)
    if state is not None:
        i, j = np.triu_indices(len(state[0]), 1)
        n, mean, both, square = state
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in (i.astype(np.int32), j.astype(np.int32), n[i, j], mean[i, j], mean[j, i], both[i, j],
                                   square[i, j], square[j, i])], ["i", "j", "n", "mi", "mj", "c", "si", "sj"])


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    gap = b[1] - a[1]  # of the mean of i where j has a value; transposed, of j where i has one
    weight = a[0] * b[0] / some
    return [n, (a[0] * a[1] + b[0] * b[1]) / some, a[2] + b[2] + weight * gap * gap.T, a[3] + b[3] + weight * gap * gap]


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None,
                       max_columns: int | None = None) -> DataFrame:
    """Pearson's r for all pairs as (col_i, col_j, r); diagonal 1, undefined 0.

    The whole table and all numeric columns take part; ``max_columns`` is a choice of the
    caller.  Rows count for a pair where both values are present.  One scan, whatever the number of columns: tasks
    add up co-moments, which merge.
    """
    names = list(columns or A.numeric_columns(df))[:max_columns]
    spark = df.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "col_i string, col_j string, r double")
    ship(spark)
    values = df.select(*[Q.value_column(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    parts = durable(values.mapInArrow(_comoments, "i int, j int, n double, mi double, mj double, c double, si double, sj double"))
    # A row per pair and task; the deviations of the tasks' means join what the tasks have summed up.
    total = parts.groupBy(F.col("i").alias("ti"), F.col("j").alias("tj")).agg(
        *[F.try_divide(F.sum(F.col("n") * F.col(m)), F.sum("n")).alias(f"all_{m}") for m in ("mi", "mj")])
    di, dj = F.col("mi") - F.col("all_mi"), F.col("mj") - F.col("all_mj")
    sums = (parts.where("n > 0").join(total, (F.col("i") == F.col("ti")) & (F.col("j") == F.col("tj"))).groupBy("i", "j")
            .agg(F.sum(F.col("c") + F.col("n") * di * dj).alias("c"), F.sum(F.col("si") + F.col("n") * di * di).alias("si"),
                 F.sum(F.col("sj") + F.col("n") * dj * dj).alias("sj")))
    r = F.coalesce(F.try_divide(F.col("c"), F.sqrt("si") * F.sqrt("sj")), F.lit(0.0))
    name = F.array(*[F.lit(n) for n in names])
    found = sums.select("i", "j", F.when(~F.isnan(r), r).otherwise(0.0).alias("r"))
    every = spark.createDataFrame([(i, j) for i in range(len(names)) for j in range(i + 1, len(names))], "i int, j int")
    both = every.join(found, ["i", "j"], "left").select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"),
                                                        F.coalesce("r", F.lit(0.0)).alias("r"))
    pair = lambda x, y: F.struct(F.col(x).alias("col_i"), F.col(y).alias("col_j"), F.col("r").alias("r"))
    diagonal = spark.createDataFrame([(n, n, 1.0) for n in names], "col_i string, col_j string, r double")
    return both.select(F.inline(F.array(pair("a", "b"), pair("b", "a")))).union(diagonal)


# ---------------------------------------------------------------- verdicts over the profile

def health_score(profile: DataFrame) -> DataFrame:
    """One row: score between 0 and 1 and the list of risks."""
    gap = F.abs(F.col("numeric.mean") - F.col("numeric.median")) / F.nullif(
        F.col("numeric.max") - F.col("numeric.min"), F.lit(0.0))
    skewed = F.coalesce(gap > 0.1, F.lit(False))
    penalty = (F.when(F.col("null_pct") > 15, 10).when(F.col("null_pct") > 5, 5).otherwise(0)
               + F.when(F.col("has_special"), 5).otherwise(0)
               + F.when(skewed, 5).otherwise(0))
    risks = F.array_compact(F.array(
        F.when(F.col("null_pct") > 15,
               F.format_string("%s: %.1f%% of the values are missing", "name", "null_pct")),
        F.when(F.col("has_special"), F.format_string("%s: hidden control characters", "name")),
        F.when(skewed, F.format_string("%s: mean and median are far apart", "name"))))
    return (profile.select("position", penalty.alias("penalty"), risks.alias("risks"))
            .agg(F.coalesce(F.sum("penalty"), F.lit(0)).alias("lost"),
                 F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "risks"))),
                                       lambda x: x["risks"])).alias("risks"))
            .select((F.greatest(F.lit(0.0), 100.0 - F.col("lost")) / 100.0).alias("score"), "risks"))


def quality_summary(profile: DataFrame) -> DataFrame:
    totals = profile.agg(
        F.coalesce(F.avg("null_pct"), F.lit(0.0)).alias("avg_null_pct"),
        F.count_if(F.col("null_pct") >= 100).alias("empty_columns"),
        F.count_if(F.col("distinct_count") <= 1).alias("constant_columns"))
    return totals.crossJoin(health_score(profile).select((F.col("score") * 100).alias("score")))
