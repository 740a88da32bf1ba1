"""String expressions: Column in, Column out, all inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode property White_Space.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Texts that stand for a missing value.
NULL_TOKENS = ["null", "NULL", "", "N/A", "nan", "NaN"]

# Texts read as booleans, whatever their case.
TRUE_TOKENS = ["true", "1", "yes"]
FALSE_TOKENS = ["false", "0", "no"]

# Character classes and the number pattern.
SPECIAL_CLASS = r"(?U)[^a-zA-Z0-9\s]"
NON_ASCII_CLASS = r"[^\x00-\x7F]"
NUMBER_PATTERN = r"(\d+\.?\d*)"
CONTROL_CLASS = r"[\x00-\x08\x0A-\x1F\x7F\uFFFD]"


def trim_whitespace(c: Column) -> Column:
    """Strip every kind of whitespace at both ends (``F.trim`` alone strips U+0020 only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def lower_case(c: Column) -> Column:
    return F.lower(c)


def upper_case(c: Column) -> Column:
    return F.upper(c)


def title_case(c: Column) -> Column:
    return F.initcap(c)


def remove_special_chars(c: Column) -> Column:
    return F.regexp_replace(c, SPECIAL_CLASS, "")


def remove_non_ascii(c: Column) -> Column:
    return F.regexp_replace(c, NON_ASCII_CLASS, "")


def standardise_nulls(c: Column) -> Column:
    return F.when(~c.isin(NULL_TOKENS), c)


def extract_numbers(c: Column) -> Column:
    """First unsigned number in the text, as double."""
    return F.nullif(F.regexp_extract(c, NUMBER_PATTERN, 1), F.lit("")).try_cast("double")


class PatternError(ValueError):
    """A regular expression outside the supported (linear-time) subset."""


_UNSUPPORTED = re.compile(r"\(\?<?[=!]|(?<!\\)(?:\\\\)*\\[1-9]")


def check_pattern(pattern: str) -> None:
    if _UNSUPPORTED.search(pattern):
        raise PatternError(f"look-around and back-references are not supported: {pattern!r}")
    try:
        re.compile(re.sub(r"\(\?U\)|\(\?<(?=[A-Za-z])", lambda m: "" if m.group() == "(?U)" else "(?P<",
                          pattern))
    except re.error as err:
        raise PatternError(f"invalid pattern {pattern!r}: {err}") from err


def java_replacement(replacement: str) -> str:
    """``$1``, ``${1}``, ``${name}`` and ``$$`` in the notation of Spark's ``regexp_replace``."""
    def convert(match: re.Match[str]) -> str:
        token = match.group()
        if token == "\\":
            return "\\\\"
        if token == "$$":
            return "\\$"
        group = match.group("braced") or match.group("bare")
        if group is None:
            return "\\$"
        return f"${group}" if group.isdigit() else f"${{{group}}}"

    return re.sub(r"\\|\$\$|\$\{(?P<braced>\w+)\}|\$(?P<bare>\w+)|\$", convert, replacement)


def regex_replace(c: Column, pattern: str, replacement: str) -> Column:
    check_pattern(pattern)
    return F.regexp_replace(c, F.lit(pattern), F.lit(java_replacement(replacement)))


def has_carriage_return(c: Column) -> Column:
    return F.contains(c, F.lit("\r"))


def has_control_character(c: Column) -> Column:
    return c.rlike(CONTROL_CLASS)
