"""Steps of a declarative job: JSON on one side, ``DataFrame -> DataFrame`` on the other."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from tablewright.functions import casts, text
from tablewright.operators import clean as cleaning
from tablewright.operators import columns as C
from tablewright.operators import prepare
from tablewright.operators.ordering import sort_rows

Apply = Callable[[DataFrame, Mapping[str, Any]], DataFrame]


@dataclass(frozen=True)
class StepKind:
    """How a step runs, which parameters it takes and which columns it names."""

    apply: Apply
    required: tuple[str, ...]
    names: Callable[[Mapping[str, Any]], Sequence[str]]


def _columns(p: Mapping[str, Any]) -> list[str]:
    return list(p.get("columns") or [])


def _method(p: Mapping[str, Any]) -> str:
    given = str(p["method"]).lower()
    return cleaning.SCALE_NAMES.get(given, given)


STEPS: dict[str, StepKind] = {
    "drop_columns": StepKind(lambda df, p: C.drop_columns(df, _columns(p)), ("columns",), _columns),
    "rename_columns": StepKind(lambda df, p: C.rename_columns(df, p["mapping"]), ("mapping",),
                               lambda p: list(p.get("mapping") or {})),
    "trim_whitespace": StepKind(lambda df, p: C.trim_columns(df, _columns(p)), ("columns",), _columns),
    "standardise_nulls": StepKind(lambda df, p: C.standardise_null_columns(df, _columns(p)), ("columns",), _columns),
    "cast_types": StepKind(lambda df, p: C.cast_columns(df, p["columns"]), ("columns",), _columns),
    "parse_dates": StepKind(lambda df, p: C.parse_date_columns(df, p["columns"]), ("columns",), _columns),
    "impute": StepKind(lambda df, p: prepare.impute(df, str(p["strategy"]).lower(), _columns(p)),
                       ("strategy", "columns"), _columns),
    "one_hot_encode": StepKind(
        lambda df, p: prepare.one_hot_encode(df, _columns(p), p.get("drop_original", True),
                                             p.get("limit", prepare.ONE_HOT_LIMIT)),
        ("columns",), _columns),
    "normalise_columns": StepKind(lambda df, p: prepare.normalise(df, _method(p), _columns(p)),
                                  ("method", "columns"), _columns),
    "clip_outliers": StepKind(
        lambda df, p: prepare.clip_outliers(df, _columns(p), p["lower_quantile"], p["upper_quantile"]),
        ("columns", "lower_quantile", "upper_quantile"), _columns),
    "extract_numbers": StepKind(lambda df, p: C.extract_number_columns(df, _columns(p)), ("columns",), _columns),
    "regex_replace": StepKind(
        lambda df, p: C.regex_replace_columns(df, _columns(p), p["pattern"], p["replacement"]),
        ("columns", "pattern", "replacement"), _columns),
}

# Steps that look at the whole table before they can be planned.
STATISTICAL_STEPS = {"impute", "normalise_columns", "clip_outliers", "one_hot_encode"}

# Other spellings of step names.
STEP_ALIASES = {"normalize_columns": "normalise_columns", "standardize_nulls": "standardise_nulls"}


def _clean(df: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    return cleaning.clean(df, cleaning.settings_from_json(p.get("configs") or {}),
                          restricted=bool(p.get("restricted", False)))


TRANSFORMS: dict[str, StepKind] = {
    "clean": StepKind(_clean, ("configs",), lambda p: []),
    "select_columns": StepKind(lambda df, p: C.select_columns(df, _columns(p)), ("columns",), _columns),
    "filter_rows": StepKind(lambda df, p: C.filter_rows(df, p["condition"]), ("condition",), lambda p: []),
    "rename_columns": STEPS["rename_columns"],
    "drop_nulls": StepKind(lambda df, p: C.drop_nulls(df, p.get("columns")), (), _columns),
    "sort": StepKind(lambda df, p: sort_rows(df, p["by_columns"], p.get("descending") or False),
                     ("by_columns",), lambda p: list(p.get("by_columns") or [])),
}


class StepError(ValueError):
    """A step or transform document is not understood."""


def step_kind(name: str) -> StepKind:
    kind = STEPS.get(STEP_ALIASES.get(name, name))
    if kind is None:
        raise StepError(f"unknown step {name!r}; known: {', '.join(STEPS)}")
    return kind


def check_parameters(name: str, kind: StepKind, p: Mapping[str, Any]) -> list[str]:
    """Problems of one step that show without data."""
    problems = [f"parameter {key!r} is missing" for key in kind.required if p.get(key) is None]
    if problems:
        return problems
    match STEP_ALIASES.get(name, name):
        case "cast_types":
            problems += [f"unknown type {t!r} for column {c!r}" for c, t in p["columns"].items()
                         if t not in casts.STEP_TYPES]
        case "impute" if str(p["strategy"]).lower() not in prepare.IMPUTE_STRATEGIES:
            problems.append(f"unknown strategy {p['strategy']!r}")
        case "normalise_columns" if _method(p) not in prepare.SCALE_METHODS:
            problems.append(f"unknown method {p['method']!r}")
        case "clip_outliers" if not 0 <= p["lower_quantile"] < p["upper_quantile"] <= 1:
            problems.append("quantiles have to fulfil 0 <= lower < upper <= 1")
        case "regex_replace":
            try:
                text.check_pattern(p["pattern"])
            except text.PatternError as err:
                problems.append(str(err))
    return problems


def apply_transforms(df: DataFrame, transforms: Sequence[Mapping[str, Any]]) -> DataFrame:
    """A sequence of ``{"transform_type": ..., "parameters": {...}}`` documents."""
    for document in transforms:
        name = document.get("transform_type") or document.get("type")
        kind = TRANSFORMS.get(name)
        if kind is None:
            raise StepError(f"unknown transform {name!r}; known: {', '.join(TRANSFORMS)}")
        p = document.get("parameters") or {}
        missing = [key for key in kind.required if key not in p]
        if missing:
            raise StepError(f"transform {name!r} lacks {missing}")
        df = kind.apply(df, p)
    return df
