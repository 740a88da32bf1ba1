"""Cleaning by settings: one frozen setting per column, applied in fixed phases.

text -> extract numbers -> cast -> impute -> clip -> round -> scale -> rename -> one-hot.
Each phase is one projection over all columns; a phase that needs statistics looks at the
output of the phase before it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import casts, text
from tablewright.operators import prepare
from tablewright.operators.aggregates import field
from tablewright.operators.columns import replace_columns

# Spellings accepted for the choices of a setting.
CASE_NAMES = {"none": "none", "lowercase": "lower", "lower": "lower", "uppercase": "upper",
              "upper": "upper", "titlecase": "title", "title": "title"}
SCALE_NAMES = {"none": "none", "minmax": "minmax", "min_max": "minmax", "zscore": "zscore",
               "z_score": "zscore"}
IMPUTE_NAMES = {"none": "none", "mean": "mean", "median": "median", "mode": "mode", "zero": "zero"}
CLIP_QUANTILES = (0.05, 0.95)


@dataclass(frozen=True)
class CleanSetting:
    """How one column is cleaned; the defaults change nothing."""

    new_name: str = ""
    target_dtype: str | None = None
    active: bool = True
    ml_preprocessing: bool = False
    trim_whitespace: bool = False
    remove_special_chars: bool = False
    text_case: str = "none"
    standardise_nulls: bool = False
    remove_non_ascii: bool = False
    regex_find: str = ""
    regex_replace: str = ""
    rounding: int | None = None
    extract_numbers: bool = False
    clip_outliers: bool = False
    temporal_format: str = ""
    timezone_utc: bool = False
    source_timezone: str = "UTC"
    freq_threshold: int | None = None
    normalisation: str = "none"
    one_hot_encode: bool = False
    impute_mode: str = "none"

    @classmethod
    def from_json(cls, document: Mapping[str, Any]) -> CleanSetting:
        known = {f.name for f in fields(cls)}
        values = {k: v for k, v in document.items() if k in known}
        for key, names in (("text_case", CASE_NAMES), ("normalisation", SCALE_NAMES),
                           ("impute_mode", IMPUTE_NAMES)):
            if key in values:
                choice = str(values[key] or "none").lower()
                if choice not in names:
                    raise ValueError(f"{key}: unknown choice {values[key]!r}")
                values[key] = names[choice]
        return cls(**values)

    def to_json(self) -> dict[str, Any]:
        return asdict(self)


Settings = Mapping[str, CleanSetting]


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _text_phase(c: Column, s: CleanSetting) -> Column:
    if s.trim_whitespace:
        c = text.trim_whitespace(c)
    if s.text_case != "none":
        c = {"lower": text.lower_case, "upper": text.upper_case, "title": text.title_case}[s.text_case](c)
    if s.remove_special_chars:
        c = text.remove_special_chars(c)
    if s.remove_non_ascii:
        c = text.remove_non_ascii(c)
    if s.regex_find:
        c = text.regex_replace(c, s.regex_find, s.regex_replace)
    if s.standardise_nulls:
        c = text.standardise_nulls(c)
    return c


def _typed(c: Column, s: CleanSetting, is_text: bool) -> Column:
    if s.extract_numbers:
        c = text.extract_numbers(c.cast("string"))
    if s.target_dtype == "Temporal" and s.temporal_format:
        c = casts.parse_date(c, s.temporal_format)
    elif s.target_dtype:
        c = casts.cast_kind(c, s.target_dtype)
    if s.timezone_utc and (s.target_dtype == "Temporal" or not is_text):
        c = casts.to_utc(c, s.source_timezone)
    return c


def clean(df: DataFrame, settings: Settings, restricted: bool = False,
          one_hot_limit: int = prepare.ONE_HOT_LIMIT) -> DataFrame:
    """Clean the configured columns; others pass through.

    ``restricted`` leaves out clipping, rounding and scaling, nothing else.
    """
    used = {c: settings[c] for c in df.columns if c in settings}
    if not used:
        return df
    gone = {c for c, s in used.items() if not s.active}
    used = {c: s for c, s in used.items() if s.active}
    first = {}
    for c, s in used.items():
        is_text = _is_text(df, c)
        expression = _text_phase(field(c), s) if is_text else field(c)
        first[c] = _typed(expression, s, is_text)
    df = df.select(*[first[c].alias(c) if c in first else field(c) for c in df.columns if c not in gone])

    for c, s in used.items():
        if s.freq_threshold and _is_text(df, c):
            df = prepare.cap_rare_values(df, c, s.freq_threshold)
    learned = {c: s for c, s in used.items() if s.ml_preprocessing}
    filled = {c: s.impute_mode for c, s in learned.items() if s.impute_mode != "none"}
    if filled:
        df = prepare.impute_each(df, filled)
    if not restricted:
        clipped = [c for c, s in learned.items() if s.clip_outliers and _scalable(df, c)]
        if clipped:
            df = prepare.clip_outliers(df, clipped, *CLIP_QUANTILES)
        rounded = {c: casts.round_numeric(field(c), s.rounding) for c, s in used.items()
                   if s.rounding is not None and casts.is_numeric(df.schema[c].dataType)}
        if rounded:
            df = replace_columns(df, rounded)
        scaled = {c: s.normalisation for c, s in learned.items()
                  if s.normalisation != "none" and _scalable(df, c)}
        if scaled:
            df = prepare.normalise_each(df, scaled, zero_if_constant=False)
    names = {c: s.new_name or c for c, s in used.items()}
    if any(c != n for c, n in names.items()):
        df = df.select(*[field(c).alias(names.get(c, c)) for c in df.columns])
    encoded = [names[c] for c, s in learned.items() if s.one_hot_encode]
    encoded = [c for c in encoded if _is_text(df, c)]
    if encoded:
        df = prepare.one_hot_encode(df, encoded, drop_original=True, limit=one_hot_limit,
                                    clean_labels=False)
    return df


def _scalable(df: DataFrame, name: str) -> bool:
    return casts.is_numeric(df.schema[name].dataType)


def settings_from_json(document: Mapping[str, Mapping[str, Any]]) -> dict[str, CleanSetting]:
    return {column: CleanSetting.from_json(s) for column, s in document.items()}


def enable_ml_preprocessing(settings: Settings) -> dict[str, CleanSetting]:
    """Mean imputation, clipping and z-score for every column."""
    return {c: replace(s, ml_preprocessing=True, impute_mode="mean", clip_outliers=True,
                       normalisation="zscore") for c, s in settings.items()}


def auto_settings(profile: DataFrame) -> dict[str, CleanSetting]:
    """Cleaning settings derived from a profile (one small row per column)."""
    from tablewright.operators.insights import with_setting_flags

    settings = {}
    for r in with_setting_flags(profile).collect():
        settings[r["name"]] = CleanSetting(
            new_name=r["standard_name"],
            trim_whitespace=r["set_trim"], standardise_nulls=r["set_nulls"],
            remove_special_chars=r["set_special"], remove_non_ascii=r["set_special"],
            clip_outliers=r["set_clip"], normalisation="zscore" if r["set_scale"] else "none",
            impute_mode="mean" if r["set_impute"] else "none", one_hot_encode=r["set_one_hot"])
    return settings
