"""Type changes that yield null instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import FALSE_TOKENS, TRUE_TOKENS

# Type names of a cast step.
STEP_TYPES = {
    "i64": "bigint",
    "Numeric": "bigint",
    "f64": "double",
    "String": "string",
    "Text": "string",
    "Boolean": "boolean",
    "Categorical": "string",
    "Temporal": "timestamp",
}

# Semantic kinds of a column.
KINDS = ["Numeric", "Text", "Categorical", "Temporal", "Boolean", "Nested"]


def cast_step_type(c: Column, type_name: str, via_double: bool = False) -> Column:
    if type_name not in STEP_TYPES:
        raise ValueError(f"unknown type {type_name!r}; known: {', '.join(STEP_TYPES)}")
    target = STEP_TYPES[type_name]
    if target == "bigint" and via_double:
        return c.try_cast("double").try_cast("bigint")
    return c.try_cast(target)


def cast_boolean_tokens(c: Column) -> Column:
    token = F.lower(c.cast("string"))
    return F.when(token.isin(TRUE_TOKENS), True).when(token.isin(FALSE_TOKENS), False)


def cast_kind(c: Column, kind: str) -> Column:
    """Cast by semantic kind: numbers become double here, unlike in a cast step."""
    match kind:
        case "Numeric":
            return c.try_cast("double")
        case "Text" | "Categorical":
            return c.cast("string")
        case "Boolean":
            return cast_boolean_tokens(c)
        case "Temporal":
            return F.date_trunc("millisecond", c.try_cast("timestamp"))
        case "Nested":
            return c
    raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")


def parse_date(c: Column, fmt: str = "") -> Column:
    text = c.cast("string")
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else text.try_cast("timestamp")


def to_utc(c: Column, zone: str) -> Column:
    return F.to_utc_timestamp(c, zone)


def round_numeric(c: Column, decimals: int) -> Column:
    return F.round(c, decimals)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def base_kind(dtype: T.DataType) -> str:
    """Kind by declared type alone; text may still turn out to be categorical."""
    if is_numeric(dtype):
        return "Numeric"
    if is_temporal(dtype):
        return "Temporal"
    if isinstance(dtype, T.BooleanType):
        return "Boolean"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return "Nested"
    return "Text"
