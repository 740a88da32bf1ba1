"""Operators that depend on row order: positions, slices, strides, sortedness, sorting, samples.

Order is always given by key columns.  Positions come from a range partitioning on the keys, so
no task ever sees more than its share: a tie-breaker that is unique per row lets the range
boundaries run through the middle of equal keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators import aggregates as A
from tablewright.session import durable, ship

BLOCK_ROWS = 100_000  # rows of a range that the sortedness check looks at, about
FOLD = 1_000          # summaries that are merged at a time

_ID_BITS = 33   # monotonically_increasing_id keeps the position within a partition here


def sort_columns(by: Sequence[str], descending: Sequence[bool] | bool = False) -> list[Column]:
    """Sort keys with nulls first in both directions."""
    flags = [descending] * len(by) if isinstance(descending, bool) else list(descending)
    flags += [False] * (len(by) - len(flags))
    return [F.desc_nulls_first(A.field(c)) if d else F.asc_nulls_first(A.field(c))
            for c, d in zip(by, flags)]


def sort_rows(df: DataFrame, by: Sequence[str], descending: Sequence[bool] | bool = False) -> DataFrame:
    return df.orderBy(*sort_columns(by, descending))


def row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index",
              descending: Sequence[bool] | bool = False) -> DataFrame:
    """Add the 0-based position of each row in the order of the key columns."""
    keys = sort_columns(order_by, descending)
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    placed = durable(tied.repartitionByRange(*keys, F.col("__tie"))
                     .sortWithinPartitions(*keys, F.col("__tie")).drop("__tie"))
    numbered = placed.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("__id", _ID_BITS)
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, total = [], 0
    for row in sorted(sizes, key=lambda r: r["__part"]):
        offsets.append((row["__part"], total))
        total += row["n"]
    # One row per partition of the sorted table, never per data row.
    table = df.sparkSession.createDataFrame(offsets, "__part bigint, __offset bigint")
    inside = F.col("__id").bitwiseAND(F.lit((1 << _ID_BITS) - 1))
    return (numbered.withColumn("__part", part)
            .join(F.broadcast(table), "__part")
            .withColumn(name, F.col("__offset") + inside)
            .drop("__part", "__offset", "__id"))


def row_slice(df: DataFrame, order_by: Sequence[str], offset: int, length: int) -> DataFrame:
    """Rows ``offset`` to ``offset + length`` in the order of the keys."""
    position = F.col("__position")
    return (row_index(df, order_by, "__position")
            .where((position >= offset) & (position < offset + length)).drop("__position"))


_TESTS = {
    "ascending": lambda a, b: a <= b,
    "descending": lambda a, b: a >= b,
    "strictly_ascending": lambda a, b: a < b,
    "strictly_descending": lambda a, b: a > b,
}


def _summaries(count: int, floats: frozenset[int]):
    """Of each task, whose rows come in order: per column the first and last value and whether each test holds."""
    def kept(column: pa.Array, k: int) -> pa.Array:
        column = column.drop_null()
        return column.cast(pa.int8()) if pa.types.is_boolean(column.type) else column

    def smaller(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
        """a < b; NaN is the largest number and equals itself."""
        if k in floats:
            a, b = (x.to_numpy(zero_copy_only=False) for x in (a, b))
            return (a < b) | (~np.isnan(a) & np.isnan(b))
        return pc.less(a, b).to_numpy(zero_copy_only=False)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list = [None] * count
        last: list = [None] * count
        never = [[False, False, False, False] for _ in range(count)]  # seen: a > b, a < b, a >= b, a <= b
        at, types = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0)[0] if at is None else at
            types = [c.type for c in batch.columns[1:]]
            for k in range(count):
                own = kept(batch.column(k + 1), k)
                if not len(own):
                    continue
                if last[k] is not None:
                    own = pa.concat_arrays([last[k], own])
                else:
                    first[k] = own.slice(0, 1)
                last[k] = own.slice(len(own) - 1)
                rise, fall = smaller(own[:-1], own[1:], k), smaller(own[1:], own[:-1], k)
                for slot, seen in enumerate((fall, rise, ~rise, ~fall)):
                    never[k][slot] |= bool(seen.any())
        if at is None:
            return
        columns, names = [pa.array([at.as_py()], pa.int64())], ["place"]
        for k in range(count):
            for label, value in (("first", first[k]), ("last", last[k])):
                columns.append((value if value is not None else pa.nulls(1, types[k])).cast(types[k]))
                names.append(f"{label}{k}")
            columns += [pa.array([not seen]) for seen in never[k]]
            names += [f"{label}{k}" for label in _TESTS]
        yield pa.RecordBatch.from_arrays(columns, names)
    return each


def sortedness(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Per column: non-decreasing and non-increasing in row order, and the strict versions.

    Rows are dealt into ranges of the key, which is the one shuffle of the table; each task reduces its range to
    (first, last, holds) per column.  Such summaries merge associatively: they are folded ``FOLD`` at a time until one
    is left.  Nulls are passed over; rows of one key are compared in the order they come in.
    """
    ship(df.sparkSession)
    keys = sort_columns(order_by)
    values = [A.field(c).alias(f"v{i}") for i, c in enumerate(columns)]
    tied = df.select(*[A.field(c) for c in dict.fromkeys(order_by)],
                     F.struct(*values).alias("__values"), F.monotonically_increasing_id().alias("__tie"))
    ranges = max(1, -(-df.count() // BLOCK_ROWS))
    placed = tied.repartitionByRange(ranges, *keys, F.col("__tie")).sortWithinPartitions(*keys, F.col("__tie"))
    rows = placed.select(F.spark_partition_id().cast("bigint").alias("place"), "__values.*")
    types = {f.name: f.dataType for f in rows.schema}
    floats = frozenset(i for i in range(len(columns)) if types[f"v{i}"].simpleString() in ("float", "double"))
    schema = "place bigint, " + ", ".join(
        f"first{i} {types[f'v{i}'].simpleString()}, last{i} {types[f'v{i}'].simpleString()}, "
        + ", ".join(f"{label}{i} boolean" for label in _TESTS) for i in range(len(columns)))
    summary = durable(rows.mapInArrow(_summaries(len(columns), floats), schema))
    while ranges > 1:
        summary = _folded(summary, len(columns))
        ranges = -(-ranges // FOLD)
    verdict = summary.agg(*[F.coalesce(F.bool_and(f"{label}{i}"), F.lit(True)).alias(f"{label}{i}")
                            for i, _ in enumerate(columns) for label in _TESTS])
    found = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{label}{i}").alias(label) for label in _TESTS])
                      for i, c in enumerate(columns)])
    return verdict.select(F.inline(found))


def _folded(summary: DataFrame, count: int) -> DataFrame:
    """Neighbouring summaries merged, ``FOLD`` to one."""
    group = F.floor(F.col("place") / FOLD).cast("bigint")
    before = Window.partitionBy("group").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    bordered = summary.withColumn("group", group).select("*", *[
        F.last(f"last{i}", ignorenulls=True).over(before).alias(f"prev{i}") for i in range(count)])
    return bordered.groupBy("group").agg(*[
        agg for i in range(count) for agg in (
            F.min_by(f"first{i}", F.when(F.col(f"first{i}").isNotNull(), F.col("place"))).alias(f"first{i}"),
            F.max_by(f"last{i}", F.when(F.col(f"last{i}").isNotNull(), F.col("place"))).alias(f"last{i}"),
            *[F.bool_and(F.col(f"{label}{i}") & F.coalesce(test(F.col(f"prev{i}"), F.col(f"first{i}")), F.lit(True)))
              .alias(f"{label}{i}") for label, test in _TESTS.items()])]).withColumnRenamed("group", "place")


# ---------------------------------------------------------------- samples

def sample_stride(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """Every (rows/n)-th row in key order, at most ``n``."""
    stride = max(1, df.count() // n)
    position = F.col("__position")
    return (row_index(df, order_by, "__position")
            .where((position % stride == 0) & (position < n * stride)).drop("__position"))


def sample_head_random(df: DataFrame, n: int, seed: int = 42,
                       order_by: Sequence[str] | None = None) -> DataFrame:
    """``n`` random rows out of the first ``2n``."""
    head = (sort_rows(df, order_by) if order_by else df).limit(2 * n)
    return head.orderBy(F.rand(seed)).limit(n)


def sample_reservoir(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, chosen by a hash of the key: uniform, repeatable, no full sort."""
    digest = F.xxhash64(F.lit(seed), *[A.field(k) for k in key])
    return df.orderBy(digest, *[A.field(k) for k in key]).limit(n)


# The sample size policy.
SMALL_TABLE = 10_000
SAMPLE_BOUNDS = (1_000, 500_000)
SAMPLED_ABOVE_BYTES = 20 * 1024 * 1024
SAMPLED_ABOVE_COLUMNS = 50
CELLS_OF_A_WIDE_SAMPLE = 5_000_000


def sample_size(rows: int, columns: int, wanted: int, size_bytes: int) -> int | None:
    """Rows to sample under the policy, or None where the whole table is used."""
    if rows < SMALL_TABLE or not (size_bytes > SAMPLED_ABOVE_BYTES or columns > SAMPLED_ABOVE_COLUMNS):
        return None
    low, high = SAMPLE_BOUNDS
    if columns > 100:
        target = max(min(high, CELLS_OF_A_WIDE_SAMPLE // columns), wanted // 2)
    elif columns > 50:
        target = min(high, wanted * 3 // 4)
    else:
        target = wanted
    return min(rows, max(low, min(high, target)))


def sampled(df: DataFrame, wanted: int, size_bytes: int, method: str = "head_random",
            order_by: Sequence[str] | None = None) -> tuple[DataFrame, str | None]:
    """A sample under the size policy with a note on how it was taken; None means all rows."""
    rows = df.count()
    n = sample_size(rows, len(df.columns), wanted, size_bytes)
    if n is None or n >= rows:
        return df, None
    if method == "stride":
        if not order_by:
            raise ValueError("a stride sample needs order_by")
        picked = sample_stride(df, order_by, n)
    elif method == "reservoir":
        picked = sample_reservoir(df, order_by or df.columns, n)
    else:
        picked = sample_head_random(df, n, order_by=order_by)
    return picked, f"statistics of {n} of {rows} rows ({method} sample)"
