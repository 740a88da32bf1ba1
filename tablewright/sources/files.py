"""File sources and sinks: CSV, JSON and Parquet, chosen by suffix."""

from __future__ import annotations

import datetime
import posixpath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.aggregates import field
from tablewright.operators.columns import promote_temporal_columns
from tablewright.session import scratch_path
from tablewright.sources import records

RECORDS_PER_FILE = 1_000_000  # of text sinks, so that files that are one task each stay small

# Stands for an empty text while a CSV file is read, where null and "" would otherwise be one.
EMPTY = "\ue000empty\ue000"

# Other names of the character sets Spark reads.
CHARSETS = {"latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf8": "UTF-8", "ascii": "US-ASCII", "utf16": "UTF-16"}

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet"}


class UnsupportedFormatError(ValueError):
    """The suffix names no known file format."""


def format_of(path: str, default: str | None = None) -> str:
    suffix = posixpath.splitext(path.rstrip("/"))[1].lower()
    if suffix in FORMATS:
        return FORMATS[suffix]
    if default:
        return default
    raise UnsupportedFormatError(f"unsupported file format {suffix!r} of {path}; known: {', '.join(FORMATS)}")


CORRUPT = "_corrupt_record"


def scan_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",",
             encoding: str = "utf-8", multi_line: bool = True, schema: T.StructType | None = None,
             promote_dates: bool = True, ragged: str = "fail", exact: bool = True,
             types: T.StructType | None = None) -> DataFrame:
    """CSV with types that fit all rows: a column that one value does not fit stays text.

    Line breaks inside quotes are part of a value; files larger than a split are read by many tasks all the same (module
    ``records``; UTF-8 only, other character sets take one task per file).  Without ``multi_line`` quoted breaks are not
    understood.  ``""`` is an empty text, nothing between delimiters is null.

    A record with more or fewer values than there are columns is an error; with ``ragged="keep"`` it goes, as written, to a
    column ``_corrupt_record``, beside what fits.  A column gets a type if every value, cast and written again, is what the
    file says; ``exact=False`` takes numbers for their value (``5`` beside ``2.50``, ``1e-05``, ``TRUE``).  Texts
    with a year, month and day become timestamps if all do, unless ``promote_dates`` is off.  ``types`` are those of an
    earlier read: nothing is inferred, and a value that does not fit is an error.
    """
    options = {"header": header, "sep": delimiter, "encoding": CHARSETS.get(encoding.lower(), encoding), "quote": '"',
               "escape": '"', "multiLine": multi_line, "emptyValue": EMPTY}
    if schema is not None:
        return _with_empty_texts(spark.read.options(**options).schema(schema).csv(path))
    if ragged not in ("fail", "keep"):
        raise ValueError(f"ragged is 'fail' or 'keep', not {ragged!r}")
    raw = _with_empty_texts(_raw_csv(spark, path, options, ragged == "keep", several_passes=types is None))
    known = [CORRUPT] if ragged == "keep" else []
    if types is not None:
        return raw.select(*[field(f.name).cast(f.dataType).alias(f.name) for f in types], *known)
    types = infer_types(raw.drop(*known), exact)
    df = raw.select(*[field(c) if t == "string" else field(c).cast(t).alias(c) for c, t in types.items()], *known)
    return promote_temporal_columns(df, skip=known) if promote_dates else df


def _raw_csv(spark: SparkSession, path: str, options: dict[str, Any], keep_ragged: bool, several_passes: bool) -> DataFrame:
    """All values as text.  Files that fit one split go to Spark's reader as they are, larger ones record by record; what
    is read in several passes is then cut and parsed once, into Parquet in the scratch folder."""
    mode = {"mode": "PERMISSIVE" if keep_ragged else "FAILFAST", "columnNameOfCorruptRecord": CORRUPT}
    split = options["multiLine"] and options["encoding"] in ("UTF-8", "utf-8", "US-ASCII") and not one_task_each(spark, path)
    if not split:
        names = spark.read.options(**options, inferSchema=False).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, *[CORRUPT] * keep_ragged]])
        return spark.read.options(**options, **mode, columnPruning=False).schema(schema).csv(path)
    names = records.column_names(records.first_record(spark, path, options["sep"]), options["header"])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, *[CORRUPT] * keep_ragged]])
    rows = records.split_records(spark, path, options["sep"])
    if options["header"]:
        rows = rows.where("not first")
    own = {k: str(v).lower() if isinstance(v, bool) else v for k, v in {**options, **mode}.items() if k not in ("header", "encoding")}
    parsed = rows.select(F.from_csv("record", _ddl(schema), own).alias("r"))
    # Numbered, as Parquet takes no two names that differ in case only.
    parsed = parsed.select(*[F.col("r")[c].alias(f"_c{i}") for i, c in enumerate(schema.names)])
    if several_passes:
        staged = scratch_path(spark, "records")
        parsed.write.parquet(staged)
        parsed = spark.read.schema(parsed.schema).parquet(staged)
    return parsed.toDF(*schema.names)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` STRING" for name in schema.names)


def one_task_each(spark: SparkSession, path: str) -> bool:
    """Whether every file at ``path`` is smaller than a split (or compressed, so that it cannot be split)."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    limit = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")))
    for name in spark.read.text(path).inputFiles():
        target = paths(name) if "%" not in name else paths(spark._jvm.java.net.URI(name))
        if not name.endswith((".gz", ".bz2", ".zst", ".snappy", ".lz4", ".deflate")):
            if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).getLen() > limit:
                return False
    return True


def _with_empty_texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(field(f.name) == EMPTY, "").otherwise(field(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else field(f.name) for f in df.schema])


# What a task knows of a column, merged over tasks by sums and extremes.  A number counts as an integer or a
# decimal only if it is written as it would be written back: without sign or zeros in front (007 is a code).
INTEGER = "^(0|-?[1-9][0-9]*)$"
DECIMAL = "^-?(0|[1-9][0-9]*)[.][0-9]+$"
EXPONENT = "^[-]?[0-9]([.][0-9]+)?[eE][-+]?[0-9]+$"
NUMBER = "^([-+.0-9eE]+|NaN|-?Infinity)$"  # whatever one of these, or a double written as text, can be
MOST_DIGITS = 38


def _type_state(c: Column, exact: bool) -> dict[str, Column]:
    number = F.when(c.rlike(NUMBER), c)  # null for all that is no number, so that long texts go no further
    integer, decimal = number.rlike(INTEGER), number.rlike(DECIMAL) & ~number.rlike("^-0[.]0*$")
    digits = F.length(F.regexp_replace(F.split_part(number, F.lit("."), F.lit(1)), "-", ""))
    scale = F.when(decimal, F.length(F.split_part(number, F.lit("."), F.lit(2))))
    double = number.try_cast("double")
    state = {
        "present": F.count(c),
        "integers": F.count_if(integer), "longs": F.count_if(integer & number.try_cast("bigint").isNotNull()),
        "decimals": F.count_if(decimal), "digits": F.max(F.when(integer | decimal, digits)),
        "least_scale": F.min(scale), "scale": F.max(scale),
        "doubles": F.count_if(double.cast("string") == number),
        "finite": F.count_if((double.cast("string") == number) & number.rlike("[0-9]")),
        "booleans": F.count_if(c.isin("true", "false")),
    }
    if not exact:
        short = F.length(F.regexp_replace(F.regexp_replace(number, "[eE].*$", ""), "^[-.0]+|[.]", "")) <= 15
        state["values"] = F.count_if((integer | number.rlike(DECIMAL) | number.rlike(EXPONENT)) & short & double.isNotNull())
        state["flags"] = F.count_if(F.lower(c).isin("true", "false"))
    return state


def type_of(state: dict[str, Any], exact: bool = True) -> str:
    """The narrowest type that keeps every value of a column, by its state: the types form a lattice, text at its top."""
    n = state["present"]
    digits, scale = state["digits"] or 0, state["scale"] or 0
    if not n:
        return "string"
    if state["longs"] == n:
        return "bigint"
    if state["integers"] == n:
        return f"decimal({digits},0)" if digits <= MOST_DIGITS else "string"
    if state["doubles"] == n and state["finite"]:
        return "double"
    if state["decimals"] == n and state["least_scale"] == scale and digits + scale <= MOST_DIGITS:
        return f"decimal({digits + scale},{scale})"
    if state["booleans"] == n:
        return "boolean"
    if not exact:
        if state["values"] == n:
            return "double"
        if state["decimals"] + state["integers"] == n and digits + scale <= MOST_DIGITS:
            return f"decimal({digits + scale},{scale})"
        if state["flags"] == n:
            return "boolean"
    return "string"


def infer_types(df: DataFrame, exact: bool = True) -> dict[str, str]:
    """The type of every text column, from the states of all rows in one pass."""
    if not df.columns:
        return {}
    states = {c: _type_state(field(c), exact) for c in df.columns}
    row = df.agg(*[m.alias(f"{name}{i}") for i, s in enumerate(states.values()) for name, m in s.items()]).first()
    return {c: type_of({name: row[f"{name}{i}"] for name in s}, exact) for i, (c, s) in enumerate(states.items())}


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_json(spark: SparkSession, path: str, lines: bool | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A document with an array of records, or (for scale) one record per line; the file tells which if ``lines`` does
    not."""
    reader = spark.read.option("multiLine", not (holds_lines(spark, path) if lines is None else lines))
    return (reader.schema(schema) if schema else reader).json(path)


def holds_lines(spark: SparkSession, path: str) -> bool:
    """A folder, as Spark writes it, has a record per line; a file has them unless it begins with a bracket."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target) or system.getFileStatus(target).isDirectory():
        return True
    stream = system.open(target)
    try:
        byte = stream.read()
        while byte in (9, 10, 13, 32, 0xEF, 0xBB, 0xBF):  # white space and a byte order mark
            byte = stream.read()
        return byte != ord("[")
    finally:
        stream.close()


def load(spark: SparkSession, path: str, fmt: str | None = None, **options: Any) -> DataFrame:
    fmt = fmt or format_of(path)
    if fmt == "csv":
        return scan_csv(spark, path, **options)
    if fmt == "parquet":
        return scan_parquet(spark, path)
    if fmt in ("json", "jsonl"):
        return scan_json(spark, path, lines=True if fmt == "jsonl" else options.get("lines"), schema=options.get("types"))
    raise UnsupportedFormatError(f"unsupported format {fmt!r}")


def load_columnar(spark: SparkSession, path: str, fmt: str | None = None, **options: Any) -> DataFrame:
    """Like ``load``; text formats are parsed once into Parquet in the scratch folder.

    Work that passes over a table several times would otherwise parse the text each time.
    """
    fmt = fmt or format_of(path)
    df = load(spark, path, fmt, **options)
    if fmt == "parquet" or not df.columns:
        return df
    staged = scratch_path(spark, "columnar")
    df.write.parquet(staged)
    return spark.read.parquet(staged)


# ---------------------------------------------------------------- sinks

class DuplicateColumnError(ValueError):
    """A result has two columns of one name and cannot be stored."""


def path_from_template(template: str, date: str | None = None) -> str:
    """Fill in ``{date}``: the given day or today, as YYYY-MM-DD."""
    return template.replace("{date}", date or datetime.date.today().isoformat())


def check_columns(df: DataFrame) -> None:
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if repeated:
        raise DuplicateColumnError(f"duplicate columns {repeated}: give each an alias of its own")


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def sink_parquet(df: DataFrame, path: str, overwrite: bool = True, row_group_bytes: int | None = None,
                 max_records_per_file: int | None = None) -> str:
    check_columns(df)
    writer = df.write.mode(_mode(overwrite))
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)
    return path


def sink_csv(df: DataFrame, path: str, overwrite: bool = True, max_records_per_file: int = RECORDS_PER_FILE) -> str:
    """Blanks, quotes, line breaks and empty texts are written so that ``scan_csv`` reads the same values back."""
    check_columns(df)
    (df.write.mode(_mode(overwrite)).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("maxRecordsPerFile", max_records_per_file).csv(path))
    return path


def sink_json(df: DataFrame, path: str, overwrite: bool = True, max_records_per_file: int = RECORDS_PER_FILE) -> str:
    """One record per line; null fields are kept so that every record has all columns."""
    check_columns(df)
    (df.write.mode(_mode(overwrite)).option("ignoreNullFields", False)
     .option("maxRecordsPerFile", max_records_per_file).json(path))
    return path


SINKS = {"parquet": sink_parquet, "csv": sink_csv, "json": sink_json, "jsonl": sink_json}


def save(df: DataFrame, path: str, fmt: str | None = None, overwrite: bool = True,
         date: str | None = None) -> str:
    """Write by the suffix of the target, else in the given format; returns the path."""
    target = path_from_template(path, date)
    return SINKS[format_of(target, default=fmt or "parquet")](df, target, overwrite=overwrite)


def load_written(spark: SparkSession, path: str, fmt: str | None, schema: T.StructType) -> DataFrame:
    """Read back what ``save`` wrote; the schema is known, so nothing is inferred."""
    kind = format_of(path, default=fmt or "parquet")
    if kind == "parquet":
        return spark.read.parquet(path)
    return scan_csv(spark, path, schema=schema) if kind == "csv" else spark.read.schema(schema).json(path)
