"""Job documents: parse, check before anything runs, then run as one Spark plan and one write."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.clean import CleanSetting
from tablewright.plans.steps import STATISTICAL_STEPS, STEP_ALIASES, StepError, check_parameters, step_kind
from tablewright.sources import files

DOCUMENT_VERSION = "0.1"


@dataclass
class Source:
    format: str = "csv"
    has_header: bool = True
    delimiter: str = ","
    encoding: str = "utf-8"
    path: str = ""


@dataclass
class Contract:
    """Columns the input has to have; ``strict`` allows no others."""

    match_mode: str = "tolerant"
    required_columns: list[str] = field(default_factory=list)


@dataclass
class Target:
    format: str = "parquet"
    path_template: str = ""
    overwrite: bool = True


@dataclass
class Document:
    name: str
    version: str = DOCUMENT_VERSION
    input: Source = field(default_factory=Source)
    schema: Contract = field(default_factory=Contract)
    steps: list[dict[str, Any]] = field(default_factory=list)
    output: Target = field(default_factory=Target)

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> Document:
        def part(kind, key):
            known = kind.__dataclass_fields__
            given = dict(data.get(key) or {})
            if kind is Target and not given.get("path_template") and given.get("path"):
                given["path_template"] = given["path"]
            return kind(**{k: v for k, v in given.items() if k in known})

        if "name" not in data or "steps" not in data:
            raise StepError("a document needs a name and steps")
        steps = [dict(s) for s in data["steps"]]
        for step in steps:
            step_kind(step.get("op", ""))
        return cls(data["name"], data.get("version", DOCUMENT_VERSION), part(Source, "input"),
                   part(Contract, "schema"), steps, part(Target, "output"))

    @classmethod
    def from_json(cls, text: str) -> Document:
        return cls.from_dict(json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


class InvalidDocument(ValueError):
    """All problems of a document, in order."""

    def __init__(self, problems: Sequence[str]):
        super().__init__("; ".join(problems))
        self.problems = list(problems)


def contract_problems(columns: Sequence[str], contract: Contract) -> list[str]:
    missing = [c for c in contract.required_columns if c not in columns]
    problems = [f"required column {c!r} is missing" for c in missing]
    if contract.match_mode == "strict":
        extra = [c for c in columns if c not in contract.required_columns]
        problems += [f"column {c!r} is not allowed in strict mode" for c in extra]
    return problems


def validate_document(columns: Sequence[str], document: Document) -> list[str]:
    """Walk through the steps with the set of columns each one sees; report every problem."""
    problems = contract_problems(columns, document.schema)
    present = list(columns)
    for number, step in enumerate(document.steps, start=1):
        name = STEP_ALIASES.get(step["op"], step["op"])
        kind = step_kind(name)
        found = check_parameters(name, kind, step)
        if not found:
            found = [f"unknown column {c!r}" for c in kind.names(step) if c not in present]
        problems += [f"step {number} ({name}): {p}" for p in found]
        if name == "drop_columns":
            present = [c for c in present if c not in (step.get("columns") or [])]
        elif name == "rename_columns":
            mapping = step.get("mapping") or {}
            present = [mapping.get(c, c) for c in present]
            repeated = sorted({c for c in present if present.count(c) > 1})
            problems += [f"step {number} ({name}): two columns named {c!r}" for c in repeated]
        elif name == "one_hot_encode" and step.get("drop_original", True):
            present = [c for c in present if c not in (step.get("columns") or [])]
    return problems


@dataclass
class Report:
    rows_before: int
    rows_after: int
    columns_before: int
    columns_after: int
    steps_applied: int
    warnings: list[str]
    seconds: float
    path: str | None = None


def apply_steps(df: DataFrame, steps: Sequence[Mapping[str, Any]],
                on_error: str = "skip") -> tuple[DataFrame, int, list[str]]:
    """Fold the steps into the plan.  A step that cannot be planned (unknown columns, wrong parameters or types) is
    skipped with a warning; an error while its statistics are computed is raised."""
    warnings, applied = [], 0
    for number, step in enumerate(steps, start=1):
        try:
            df = step_kind(step["op"]).apply(df, step)
            applied += 1
        except (ValueError, AnalysisException, IllegalArgumentException) as err:
            if on_error == "fail":
                raise
            reason = (str(err).splitlines() or [type(err).__name__])[0]
            warnings.append(f"step {number} ({step['op']}): {reason} (skipped)")
    return df, applied, warnings


def run_document(spark: SparkSession, document: Document, source: DataFrame | str | None = None,
                 target: str | None = None, date: str | None = None, on_error: str = "skip") -> Report:
    """load -> check -> steps -> write.

    Steps that need statistics pass over the input more than once, so text is then parsed once
    into Parquet.  Row counts of Parquet come from its footers.
    """
    started = time.monotonic()
    if isinstance(source, DataFrame):
        df = source
    else:
        path = source or document.input.path
        fmt = files.format_of(path, default=document.input.format)
        how = {}
        if fmt == "csv":
            how = {"header": document.input.has_header, "delimiter": document.input.delimiter,
                   "encoding": document.input.encoding}
        load = files.load_columnar if needs_statistics(document.steps) else files.load
        df = load(spark, path, fmt, **how)
    problems = validate_document(df.columns, document)
    if problems:
        raise InvalidDocument(problems)
    result, applied, warnings = apply_steps(df, document.steps, on_error)
    path = files.save(result, target or document.output.path_template, document.output.format,
                      document.output.overwrite, date)
    after = files.load_written(spark, path, document.output.format, result.schema).count()
    return Report(df.count(), after, len(df.columns), len(result.columns), applied, warnings,
                  time.monotonic() - started, path)


def needs_statistics(steps: Sequence[Mapping[str, Any]]) -> bool:
    return any(STEP_ALIASES.get(s["op"], s["op"]) in STATISTICAL_STEPS for s in steps)


def document_from_settings(name: str, settings: Mapping[str, CleanSetting], input_format: str = "csv",
                           output_path: str = "") -> Document:
    """Compile cleaning settings to steps.

    Columns of one kind of step share a step; renames come last, so that every step before
    them can use the names of the input.
    """
    active = {c: s for c, s in settings.items() if s.active}
    steps: list[dict[str, Any]] = []
    gone = [c for c, s in settings.items() if not s.active]
    if gone:
        steps.append({"op": "drop_columns", "columns": gone})
    trimmed = [c for c, s in active.items() if s.trim_whitespace]
    if trimmed:
        steps.append({"op": "trim_whitespace", "columns": trimmed})
    types = {c: s.target_dtype for c, s in active.items() if s.target_dtype and not s.temporal_format}
    if types:
        steps.append({"op": "cast_types", "columns": types})
    dates = {c: s.temporal_format for c, s in active.items() if s.temporal_format}
    if dates:
        steps.append({"op": "parse_dates", "columns": dates})
    learned = {c: s for c, s in active.items() if s.ml_preprocessing}
    for strategy in ("zero", "mean", "median", "mode"):
        names = [c for c, s in learned.items() if s.impute_mode == strategy]
        if names:
            steps.append({"op": "impute", "strategy": strategy, "columns": names})
    encoded = [c for c, s in learned.items() if s.one_hot_encode]
    if encoded:
        steps.append({"op": "one_hot_encode", "columns": encoded, "drop_original": True})
    names = {c: s.new_name for c, s in active.items()
             if s.new_name and s.new_name != c and c not in encoded}
    if names:
        steps.append({"op": "rename_columns", "mapping": names})
    return Document(name, input=Source(format=input_format), steps=steps,
                    output=Target(path_template=output_path))
