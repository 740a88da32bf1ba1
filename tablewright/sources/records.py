"""Records of large CSV files, found by many tasks.

A line break ends a record unless it lies inside quotes, so where records end depends on all quotes before.  Each byte
range of a file is read by a task of its own, which does not know whether it starts inside quotes.  But what a
range does to that state is a function of two values, and such functions compose associatively: in a first pass each
task composes the functions of its lines, a window over the few ranges of a file scans them, and a second pass
cuts the lines of each range into records.  What of a record lies in other ranges is put together by one
aggregation.

A quote opens a value only where the value begins, a doubled quote inside stands for one, and after a closing quote the value
goes on to the next delimiter: the rules of Spark's own reader, to which the records go.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.session import ship

INSIDE = re.compile('[^"]*(?:""[^"]*)*"(?!")')  # the rest of a quoted value
MOST_RANGES = 1_000_000  # that begin inside quotes, as the driver passes them on


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether the end of a line lies inside quotes, given whether its begin does."""
    at = 0
    while True:
        if inside:
            if (closed := INSIDE.match(line, at)) is None:
                return True
            at = closed.end()
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        if line.find('"', at) < 0 or (at := line.find(delimiter, at)) < 0:
            return False
        at, inside = at + len(delimiter), False


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, start, lines) of every batch, cut where a range ends."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        at = 0
        while at < batch.num_rows:
            stop = at
            while stop < batch.num_rows and starts[stop] == starts[at] and files[stop] == files[at]:
                stop += 1
            yield files[at], starts[at], batch.column(0).slice(at, stop - at)
            at = stop


def _functions(delimiter: str):
    """(file, start, f0, f1, starts1) of every range: the state at its end for either state at its begin, and whether a
    record starts in it even if it begins inside quotes."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f0, f1, starts1 = None, False, True, False

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]]), pa.array([f0]), pa.array([f1]), pa.array([starts1])],
                ["file", "start", "f0", "f1", "starts1"])

        for file, start, lines in _ranges(batches):
            if key != (file, start):
                if key is not None:
                    yield row()
                key, f0, f1, starts1 = (file, start), False, True, False
            quoted = pc.match_substring(lines, '"').to_pylist()
            texts = lines.to_pylist()
            for text, some in zip(texts, quoted):
                starts1 |= not f1
                if some:  # a line without quotes changes nothing
                    both = [ends_inside(text, state, delimiter) for state in (False, True)]
                    f0, f1 = both[f0], both[f1]
        if key is not None:
            yield row()
    return each


def scanned(functions: DataFrame) -> DataFrame:
    """(file, start, inside, owner): the state at the begin of every range, and the range where the record that reaches
    into it began.  A function is constant, or it keeps the state, or it swaps it; so the state is that of the last
    constant, swapped as often as was swapped since."""
    by_start = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.col("f0") & ~F.col("f1")
    upto = F.sum(F.when(swaps, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start"))
    rows = functions.withColumn("swaps", upto)
    last = F.last(F.when(F.col("f0") == F.col("f1"), F.struct("f0", "swaps")), ignorenulls=True).over(by_start)
    before = F.coalesce(F.last("swaps").over(by_start), F.lit(0))
    rows = rows.withColumn("last", last).withColumn("before", before)
    odd = F.pmod(F.col("before") - F.coalesce("last.swaps", F.lit(0)), F.lit(2)) == 1
    rows = rows.withColumn("inside", F.coalesce("last.f0", F.lit(False)) != odd)
    begins = F.when(~F.col("inside") | F.col("starts1"), F.col("start"))
    return rows.withColumn("owner", F.last(begins, ignorenulls=True).over(by_start)).select("file", "start", "inside", "owner")


def _cut(inside: dict, delimiter: str):
    """(file, owner, place, first, whole, text): records of a range, and the parts of those that cross its ends."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, owner, head, held, begun = None, False, None, False, [], False
        out: list[tuple] = []

        def close(whole: bool):
            nonlocal head, held, begun
            if held:
                first = key[1] == 0 and not begun and not head
                out.append((key[0], owner if head else key[1], key[1], first, whole and not head, "\n".join(held)))
                begun = True
            held, head = [], False

        def batch_of(rows):
            names = ["file", "owner", "place", "first", "whole", "text"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for file, start, lines in _ranges(batches):
            if key != (file, start):
                close(whole=not state)
                key, begun = (file, start), False
                owner = inside.get(file, {}).get(start)
                state = head = owner is not None
            quoted = pc.match_substring(lines, '"').to_pylist()
            for text, some in zip(lines.to_pylist(), quoted):
                held.append(text)
                if some:
                    state = ends_inside(text, state, delimiter)
                if not state:
                    close(whole=True)
            if out:
                yield batch_of(out)
                out.clear()
        close(whole=not state)
        if out:
            yield batch_of(out)
    return each


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("start"))


def split_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(record, first): every record of the CSV files at ``path`` as text, line breaks inside quotes included, and
    whether it is the first of its file.  Empty lines between records are left out."""
    ship(spark)
    lines = lines_of(spark, path)
    functions = lines.mapInArrow(_functions(delimiter), "file string, start bigint, f0 boolean, f1 boolean, starts1 boolean")
    inside: dict[str, dict[int, int]] = {}
    rows = scanned(functions).where("inside").limit(MOST_RANGES + 1).collect()
    if len(rows) > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges begin inside quotes: read larger ranges")
    for row in rows:
        inside.setdefault(row.file, {})[row.start] = row.owner
    parts = lines.mapInArrow(_cut(inside, delimiter),
                             "file string, owner bigint, place bigint, first boolean, whole boolean, text string")
    whole = parts.where("whole").select("text", "first")
    if inside:
        put = parts.where("not whole").groupBy("file", "owner").agg(
            F.sort_array(F.collect_list(F.struct("place", "text"))).alias("parts"), F.max("first").alias("first"))
        whole = whole.union(put.select(F.array_join("parts.text", "\n"), "first"))
    text = F.when(F.col("first"), F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text"))
    return (whole.select(F.regexp_replace(text, "\r$", "").alias("record"), "first").where("record <> ''"))


def first_record(spark: SparkSession, path: str, delimiter: str = ",", most_lines: int = 10_000) -> list[str]:
    """The values of the first record of the first file."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return []
    held, state = [], False
    for row in spark.read.option("lineSep", "\n").text(files[0]).limit(most_lines).toLocalIterator():
        line = row[0] if held else row[0].removeprefix("﻿")
        if not held and not line.rstrip("\r"):
            continue
        held.append(line)
        state = ends_inside(line, state, delimiter)
        if not state:
            break
    return next(csv.reader(["\n".join(held).removesuffix("\r")], delimiter=delimiter), []) if held else []


def column_names(values: list[str], header: bool) -> list[str]:
    """The names Spark gives: numbers for columns without a name, and a number behind names that repeat."""
    if not header:
        return [f"_c{i}" for i in range(len(values))]
    lower = [v.lower() for v in values]
    return [f"_c{i}" if not v else f"{v}{i}" if lower.count(v.lower()) > 1 else v for i, v in enumerate(values)]
