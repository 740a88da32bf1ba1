"""Ready step lists.  The columns are arguments; the steps are those of a job document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

Steps = list[dict[str, Any]]


def column_selection(drop: Sequence[str], rename: Mapping[str, str]) -> Steps:
    return [{"op": "drop_columns", "columns": list(drop)},
            {"op": "rename_columns", "mapping": dict(rename)}]


def data_cleaning(trim: Sequence[str], drop: Sequence[str], impute: Sequence[str]) -> Steps:
    return [{"op": "trim_whitespace", "columns": list(trim)},
            {"op": "drop_columns", "columns": list(drop)},
            {"op": "impute", "strategy": "mean", "columns": list(impute)}]


def date_normalisation(dates: Mapping[str, str], types: Mapping[str, str]) -> Steps:
    return [{"op": "parse_dates", "columns": dict(dates)},
            {"op": "cast_types", "columns": dict(types)}]


def missing_data(drop: Sequence[str], mean: Sequence[str], mode: Sequence[str]) -> Steps:
    return [{"op": "drop_columns", "columns": list(drop)},
            {"op": "impute", "strategy": "mean", "columns": list(mean)},
            {"op": "impute", "strategy": "mode", "columns": list(mode)}]


def ml_preprocessing(types: Mapping[str, str], impute: Sequence[str], scale: Sequence[str],
                     encode: Sequence[str]) -> Steps:
    return [{"op": "cast_types", "columns": dict(types)},
            {"op": "impute", "strategy": "mean", "columns": list(impute)},
            {"op": "normalise_columns", "method": "minmax", "columns": list(scale)},
            {"op": "one_hot_encode", "columns": list(encode), "drop_original": True}]


def outlier_handling(clip: Sequence[str], scale: Sequence[str]) -> Steps:
    return [{"op": "clip_outliers", "columns": list(clip), "lower_quantile": 0.01, "upper_quantile": 0.99},
            {"op": "normalise_columns", "method": "zscore", "columns": list(scale)}]


def text_processing(trim: Sequence[str], rename: Mapping[str, str], types: Mapping[str, str]) -> Steps:
    return [{"op": "trim_whitespace", "columns": list(trim)},
            {"op": "rename_columns", "mapping": dict(rename)},
            {"op": "cast_types", "columns": dict(types)}]


def type_conversion(types: Mapping[str, str], dates: Mapping[str, str]) -> Steps:
    return [{"op": "cast_types", "columns": dict(types)},
            {"op": "parse_dates", "columns": dict(dates)}]
