"""Row-wise steps: projections, filters, renames, text and type steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import casts, text
from tablewright.functions.names import standard_names
from tablewright.operators.aggregates import field, string_columns


class UnknownColumnError(ValueError):
    """A step names a column the table does not have."""


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise UnknownColumnError(f"unknown columns {missing}; the table has {df.columns}")


def replace_columns(df: DataFrame, expressions: Mapping[str, Column]) -> DataFrame:
    """One projection that replaces the given columns in place and keeps the order."""
    require(df, list(expressions))
    return df.select(*[expressions[c].alias(c) if c in expressions else field(c) for c in df.columns])


def map_columns(df: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return replace_columns(df, {c: fn(field(c)) for c in columns})


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, columns)
    return df.select(*[field(c) for c in df.columns if c not in set(columns)])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    require(df, list(mapping))
    return df.select(*[field(c).alias(mapping.get(c, c)) for c in df.columns])


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, columns)
    return df.select(*[field(c) for c in columns])


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    return df.filter(F.expr(condition))


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows where every listed column (default: all) is present; NaN counts as present."""
    names = list(columns) if columns else df.columns
    require(df, names)
    for name in names:
        df = df.filter(field(name).isNotNull())
    return df


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def preview_rows(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def standardise_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*standard_names(df.columns))


def trim_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return map_columns(df, columns, text.trim_whitespace)


def auto_clean_basic(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    return trim_columns(df, string_columns(df))


def cast_columns(df: DataFrame, types: Mapping[str, str], via_double: bool = False) -> DataFrame:
    require(df, list(types))
    return replace_columns(df, {c: casts.cast_step_type(field(c), t, via_double) for c, t in types.items()})


def parse_date_columns(df: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    require(df, list(formats))
    return replace_columns(df, {c: casts.parse_date(field(c), fmt) for c, fmt in formats.items()})


def extract_number_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return map_columns(df, columns, text.extract_numbers)


def regex_replace_columns(df: DataFrame, columns: Sequence[str], pattern: str, replacement: str) -> DataFrame:
    return map_columns(df, columns, lambda c: text.regex_replace(c, pattern, replacement))


def standardise_null_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return map_columns(df, columns, text.standardise_nulls)


# A text is a point in time only with a year, a month and a day; a time of day alone would take today's date.  One with an
# offset other than Z keeps it as text.
DATED = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9:.]+Z?)?\s*$"


def promote_temporal_columns(df: DataFrame, share: float = 1.0, skip: Sequence[str] = ()) -> DataFrame:
    """Turn string columns into timestamps where at least ``share`` of the present values parse and have a date.

    With less than 1 the values that do not parse become null; by default nothing is lost.
    """
    names = [c for c in string_columns(df) if c not in skip]
    if not names:
        return df
    dated = lambda c: F.when(c.rlike(DATED), c.try_cast("timestamp"))
    counts = df.agg(*[F.count(field(c)).alias(f"n{i}") for i, c in enumerate(names)],
                    *[F.count(dated(field(c))).alias(f"t{i}") for i, c in enumerate(names)]).first()
    dates = [c for i, c in enumerate(names) if counts[f"n{i}"] and counts[f"t{i}"] >= share * counts[f"n{i}"]]
    return map_columns(df, dates, dated) if dates else df


def type_compatibility(profile: DataFrame, target: str, df: DataFrame | None = None) -> DataFrame:
    """Can each profiled column become the target kind?  Categories are checked by content.

    The profile keeps the most frequent values only; where it left some out, all rows of the profiled table ``df`` are
    counted.  Without ``df`` such a column has no answer (null), unless a kept value fails already.
    """
    if target not in casts.KINDS:
        raise ValueError(f"unknown kind {target!r}")
    kind = F.col("kind")
    by_kind = (
        (kind == target) | F.lit(target in ("Text", "Categorical"))
        | ((kind == "Numeric") & F.lit(target in ("Boolean", "Temporal")))
        | (kind.isin("Boolean", "Temporal") & F.lit(target == "Numeric"))
        | (kind.isin("Text", "Categorical") & F.lit(target != "Nested")))
    tests: dict[str, Callable[[Column], Column]] = {
        "Numeric": lambda v: v.try_cast("double").isNotNull(),
        "Boolean": lambda v: F.lower(v).isin(text.TRUE_TOKENS + text.FALSE_TOKENS),
        "Temporal": lambda v: v.try_cast("double").isNotNull() | v.rlike("[-/:]"),
    }
    content = F.lit(True)
    if target in tests:
        values = F.coalesce(F.map_keys("frequency"), F.array().cast("array<string>"))
        kept = F.forall(values, tests[target])
        cut = [r["name"] for r in profile.where((kind == "Categorical") & F.col("frequency_truncated") & kept)
               .select("name").collect()]
        rest = F.lit(None).cast("boolean")
        if cut and df is not None:
            value = {c: field(c).cast("string") for c in cut}
            failing = df.agg(*[F.count_if(value[c].isNotNull() & ~F.coalesce(tests[target](value[c]), F.lit(False))).alias(f"f{i}")
                               for i, c in enumerate(cut)]).first()
            rest = F.col("name").isin([c for i, c in enumerate(cut) if not failing[f"f{i}"]])
        content = F.when(kind != "Categorical", F.lit(True)).when(
            F.coalesce("frequency_truncated", F.lit(False)) & kept, rest).otherwise(kept)
    return profile.select("name", "kind", F.lit(target).alias("target"),
                          (by_kind & content).alias("compatible"))


def user_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a function of the user; anything but a table in return is an error."""
    result = df.transform(fn)
    if not isinstance(result, DataFrame):
        raise TypeError("a user transform has to return a DataFrame")
    return result
