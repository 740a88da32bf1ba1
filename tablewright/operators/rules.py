"""Validation gates: all rules of a table are evaluated in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.operators.aggregates import field


class ValidationFailed(ValueError):
    """At least one rule of a gate failed; the message lists all of them."""


@dataclass(frozen=True)
class Check:
    """One rule.  ``kind`` is one of the names in ``CHECKS``."""

    kind: str
    column: str | None = None
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    condition: str | None = None

    def label(self) -> str:
        return f"{self.kind}({self.column})" if self.column else self.kind


CHECKS = ("max_null_percent", "column_exists", "row_count_range", "no_duplicates", "value_range",
          "matches_pattern", "custom_condition")


def max_null_percent(column: str, limit: float) -> Check:
    return Check("max_null_percent", column, high=limit)


def column_exists(column: str) -> Check:
    return Check("column_exists", column)


def row_count_range(low: int, high: int) -> Check:
    return Check("row_count_range", low=low, high=high)


def no_duplicates(column: str) -> Check:
    return Check("no_duplicates", column)


def value_range(column: str, low: float, high: float) -> Check:
    return Check("value_range", column, low, high)


def matches_pattern(column: str, pattern: str) -> Check:
    text.check_pattern(pattern)
    return Check("matches_pattern", column, pattern=pattern)


def custom_condition(condition: str) -> Check:
    return Check("custom_condition", condition=condition)


def check_from_json(document: dict) -> Check:
    kind = document.get("kind") or document.get("rule")
    if kind not in CHECKS:
        raise ValueError(f"unknown rule {kind!r}")
    values = {k: document.get(k) for k in ("column", "low", "high", "pattern", "condition")}
    return Check(kind, **values)


def _aggregates(df: DataFrame, check: Check, tag: str) -> list[Column]:
    one = F.count(F.lit(1))
    c = field(check.column) if check.column else None
    match check.kind:
        case "max_null_percent":
            return [F.coalesce(F.try_divide(F.count_if(c.isNull()) * 100.0, one), F.lit(0.0)).alias(f"{tag}_a")]
        case "row_count_range":
            return [one.alias(f"{tag}_a")]
        case "value_range":
            v = F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
            return [F.min(v).alias(f"{tag}_a"), F.max(v).alias(f"{tag}_b")]
        case "matches_pattern":
            return [F.count_if(~c.cast("string").rlike(check.pattern)).alias(f"{tag}_a")]
        case "custom_condition":
            return [F.count_if(~F.coalesce(F.expr(check.condition), F.lit(False))).alias(f"{tag}_a")]
    return []


def _duplicates(df: DataFrame, check: Check) -> int:
    """Rows beyond the first of each value; null is a value."""
    counted = df.groupBy(field(check.column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]


def _verdict(df: DataFrame, check: Check, row, tag: str) -> tuple[bool, str]:
    if check.column and check.column not in df.columns:
        return False, f"column {check.column} does not exist"
    match check.kind:
        case "column_exists":
            return True, f"column {check.column} exists"
        case "max_null_percent":
            share = row[f"{tag}_a"]
            return share <= check.high, f"{check.column}: {share:.2f}% null, limit {check.high:g}%"
        case "row_count_range":
            n = row[f"{tag}_a"]
            return check.low <= n <= check.high, f"{n} rows, allowed {check.low:g} to {check.high:g}"
        case "no_duplicates":
            n = _duplicates(df, check)
            return n == 0, f"{check.column}: {n} repeated values"
        case "value_range":
            low, high = row[f"{tag}_a"], row[f"{tag}_b"]
            if low is None:
                return False, f"{check.column}: no numeric value"
            ok = low >= check.low and high <= check.high
            return ok, f"{check.column}: values {low:g} to {high:g}, allowed {check.low:g} to {check.high:g}"
        case "matches_pattern":
            n = row[f"{tag}_a"]
            return n == 0, f"{check.column}: {n} values do not match {check.pattern}"
    n = row[f"{tag}_a"]
    return n == 0, f"{n} rows break the condition {check.condition}"


def validate_table(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per rule: (position, rule, passed, message)."""
    aggs = [a for i, c in enumerate(checks) if not (c.column and c.column not in df.columns)
            for a in _aggregates(df, c, f"k{i}")]
    row = df.agg(*aggs).first() if aggs else None
    rows = [(i, c.label(), *_verdict(df, c, row, f"k{i}")) for i, c in enumerate(checks)]
    return df.sparkSession.createDataFrame(rows, "position int, rule string, passed boolean, message string")


def validation_gate(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The table unchanged if every rule passes, else an error with all failed messages."""
    failed = [r["message"] for r in validate_table(df, checks).where(~F.col("passed"))
              .orderBy("position").collect()]
    if failed:
        raise ValidationFailed("; ".join(failed))
    return df


def row_test(check: Check) -> Column:
    """A rule as a test of a single row, for the rules that can fail row by row."""
    c = field(check.column) if check.column else None
    match check.kind:
        case "max_null_percent":
            return c.isNotNull()
        case "value_range":
            return F.coalesce(c.try_cast("double").between(check.low, check.high), c.isNull())
        case "matches_pattern":
            return F.coalesce(c.cast("string").rlike(check.pattern), F.lit(True))
        case "custom_condition":
            return F.coalesce(F.expr(check.condition), F.lit(False))
    raise ValueError(f"no single row can break the rule {check.label()}")


def quarantine(df: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, DataFrame]:
    """Split into rows that fulfil every rule and rows that break one.  Rules on the table as a whole, which no row breaks
    by itself (numbers of rows, columns, duplicates), are an error."""
    good = F.lit(True)
    for check in checks:
        good = good & row_test(check)
    return df.where(good), df.where(~good)
