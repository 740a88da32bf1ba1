"""Immutable table versions: Parquet directories plus one log of events.

Data is written first and the event last, so a job that dies half-way leaves an unnamed
directory behind and no broken version.  Events are numbered commits (module ``eventlog``), of which two
writers never take the same; their order is that of the versions.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import columns as C
from tablewright.operators import diff
from tablewright.operators.aggregates import union_all
from tablewright.plans.eventlog import EventLog
from tablewright.plans.sql import sql_tables
from tablewright.plans.steps import apply_transforms
from tablewright.sources import files

# Stages of a dataset, in order.
STAGES = ["Raw", "Profiled", "Cleaned", "Advanced", "Validated", "Published"]

EVENTS = T.StructType([
    T.StructField("event", T.StringType()),            # create, activate, remove
    T.StructField("dataset", T.StringType()),
    T.StructField("version_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("projection", T.StringType()),       # JSON list of columns, or null for all
    T.StructField("transforms", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("makes_active", T.BooleanType()),
    T.StructField("schema", T.StringType()),           # JSON; of a file whose format has no types
])

ORDER = ("commit", "seq")  # of events


class VersionError(ValueError):
    """No such version, or a step that versions do not allow."""


def can_follow(stage: str, target: str) -> bool:
    """Stages only move forward; skipping is allowed."""
    return STAGES.index(target) > STAGES.index(stage)


def stage_transforms(stage: str, settings: Mapping[str, Any] | None = None) -> list[dict[str, Any]]:
    """The transforms a stage stands for; Profiled, Validated and Published add none."""
    if stage in ("Cleaned", "Advanced") and settings:
        documents = {c: s.to_json() if hasattr(s, "to_json") else dict(s) for c, s in settings.items()}
        return [{"transform_type": "clean",
                 "parameters": {"configs": documents, "restricted": stage == "Cleaned"}}]
    return []


@dataclass(frozen=True)
class Version:
    version_id: str
    parent_id: str | None
    dataset: str
    stage: str
    format: str
    location: str
    projection: list[str] | None
    row_count: int | None
    column_count: int | None
    schema: str | None = None


class VersionStore:
    """Versions of datasets below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = EventLog(spark, f"{self.root}/versions", EVENTS)

    # -- metadata -----------------------------------------------------------

    def _exists(self, location: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(location)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def events(self) -> DataFrame:
        return self.log.read()

    @staticmethod
    def _event(event: str, version: Version, transforms: Sequence[Mapping] = (), makes_active: bool = True) -> dict[str, Any]:
        now = datetime.datetime.now(datetime.timezone.utc)
        return {"event": event, "dataset": version.dataset, "version_id": version.version_id, "parent_id": version.parent_id,
                "stage": version.stage, "format": version.format, "location": version.location,
                "projection": json.dumps(version.projection) if version.projection is not None else None,
                "transforms": json.dumps(list(transforms)), "row_count": version.row_count, "column_count": version.column_count,
                "created_at": now.isoformat(timespec="microseconds"), "makes_active": makes_active, "schema": version.schema}

    def _append(self, event: str, version: Version, transforms: Sequence[Mapping] = (),
                makes_active: bool = True) -> None:
        self.log.append([self._event(event, version, transforms, makes_active)])

    def _of(self, dataset: str) -> DataFrame:
        mine = self.events().where(F.col("dataset") == dataset)
        removed = mine.where("event = 'remove'").select("version_id")
        return mine.where("event <> 'remove'").join(removed, "version_id", "left_anti")

    def version_list(self, dataset: str) -> DataFrame:
        return self._of(dataset).where("event = 'create'").select(
            "version_id", "parent_id", "stage", "created_at", "row_count", "column_count", "location", "transforms")

    def get(self, dataset: str, which: str = "active") -> Version:
        """By ``raw``, ``active``, ``latest``, ``stage:<name>`` or a version id."""
        rows = self._of(dataset)
        created = rows.where("event = 'create'")
        if which == "raw":
            hit = created.where("stage = 'Raw'").orderBy(*ORDER)
        elif which == "active":
            last = rows.where("makes_active").agg(F.max_by("version_id", F.struct(*ORDER)).alias("version_id"))
            hit = created.join(last, "version_id", "left_semi")
        elif which == "latest":
            hit = created.orderBy(*map(F.desc, ORDER))
        elif which.startswith("stage:"):
            hit = created.where(F.col("stage") == which[6:]).orderBy(*map(F.desc, ORDER))
        else:
            hit = created.where(F.col("version_id") == which)
        row = hit.first()
        if row is None:
            raise VersionError(f"dataset {dataset!r} has no version {which!r}")
        return Version(row["version_id"], row["parent_id"], dataset, row["stage"], row["format"],
                       row["location"], json.loads(row["projection"]) if row["projection"] else None,
                       row["row_count"], row["column_count"], row["schema"])

    # -- create -------------------------------------------------------------

    def version_create_raw(self, dataset: str, source: str, fmt: str | None = None,
                           shape: tuple[int, int] | None = None, schema: T.StructType | None = None) -> str:
        """Register a file or table as the first version; nothing is copied.

        ``shape`` gives the numbers of rows and columns, ``schema`` the types, where they are known already.  The types of
        a text file are kept with the version, so every read has the same.
        """
        version = self._raw(dataset, source, fmt, shape, schema)
        self._append("create", version)
        return version.version_id

    def _raw(self, dataset: str, source: str, fmt: str | None, shape: tuple[int, int] | None, schema: T.StructType | None) -> Version:
        fmt = fmt or files.format_of(source)
        typed = fmt == "parquet"
        if shape is None or schema is None and not typed:
            df = files.load(self.spark, source, fmt)
            shape, schema = shape or (df.count(), len(df.columns)), df.schema
        return Version(str(uuid.uuid4()), None, dataset, "Raw", fmt, source, None, *shape, None if typed else schema.json())

    def register(self, dataset: str, source: str, fmt: str, shape: tuple[int, int], schema: T.StructType | None = None) -> str:
        """A Raw version and its Profiled child in one commit; nothing is read."""
        raw = self._raw(dataset, source, fmt, shape, schema)
        child = replace(raw, version_id=str(uuid.uuid4()), parent_id=raw.version_id, stage="Profiled")
        self.log.append([self._event("create", raw), self._event("create", child)])
        return child.version_id

    def is_noop(self, transforms: Sequence[Mapping[str, Any]], parent: Version) -> bool:
        """No rewrite is needed: nothing to do, or a single restricted clean of a cleaned parent."""
        if not transforms:
            return True
        if len(transforms) > 1 or transforms[0].get("transform_type") != "clean":
            return False
        return bool(transforms[0].get("parameters", {}).get("restricted")) and parent.stage == "Cleaned"

    def version_apply(self, dataset: str, transforms: Sequence[Mapping[str, Any]], stage: str) -> str:
        """A child of the active version, which becomes the active one."""
        parent = self.get(dataset)
        if stage not in STAGES or not (stage == parent.stage or can_follow(parent.stage, stage)):
            raise VersionError(f"stage {stage!r} cannot follow {parent.stage!r}")
        fresh = str(uuid.uuid4())
        if len(transforms) == 1 and transforms[0].get("transform_type") == "select_columns":
            names = list(transforms[0]["parameters"]["columns"])
            C.require(self._read(parent), names)
            child = replace(parent, version_id=fresh, parent_id=parent.version_id, stage=stage, projection=names,
                            column_count=len(names))
        elif self.is_noop(transforms, parent):
            child = replace(parent, version_id=fresh, parent_id=parent.version_id, stage=stage)
        else:
            child = self._write(fresh, parent, stage, apply_transforms(self._read(parent), transforms))
        self._append("create", child, transforms)
        return fresh

    def _write(self, fresh: str, parent: Version, stage: str, df: DataFrame) -> Version:
        location = f"{self.root}/data/{parent.dataset}/{fresh}"
        files.sink_parquet(df, location, overwrite=False)
        written = self.spark.read.parquet(location)
        # The count comes from the footers of the new files, not from another scan.
        return Version(fresh, parent.version_id, parent.dataset, stage, "parquet", location, None,
                       written.count(), len(written.columns))

    def version_publish(self, dataset: str, which: str = "active", mode: str = "snapshot",
                        view: str | None = None) -> str:
        """``view`` points at the data of the version, ``snapshot`` copies it."""
        source = self.get(dataset, which)
        fresh = str(uuid.uuid4())
        if mode == "view":
            child = replace(source, version_id=fresh, parent_id=source.version_id, stage="Published")
            if view:
                self._read(child).createOrReplaceTempView(view)
        elif mode == "snapshot":
            child = self._write(fresh, source, "Published", self._read(source))
        else:
            raise VersionError(f"unknown publish mode {mode!r}")
        self._append("create", child, makes_active=False)
        return fresh

    def set_active(self, dataset: str, version_id: str) -> None:
        self._append("activate", self.get(dataset, version_id))

    # -- read ---------------------------------------------------------------

    def _read(self, version: Version) -> DataFrame:
        known = {"types": T.StructType.fromJson(json.loads(version.schema))} if version.schema else {}
        df = files.load(self.spark, version.location, version.format, **known)
        return df if version.projection is None else C.select_columns(df, version.projection)

    def version_read(self, dataset: str, which: str = "active") -> DataFrame:
        return self._read(self.get(dataset, which))

    def version_query(self, dataset: str, which: str = "active", columns: Sequence[str] | None = None,
                      condition: str | None = None, limit: int | None = None) -> DataFrame:
        df = self.version_read(dataset, which)
        if condition:
            df = df.filter(F.expr(condition))
        if columns:
            df = C.select_columns(df, columns)
        return df if limit is None else df.limit(limit)

    def version_schema(self, dataset: str, which: str = "active") -> DataFrame:
        return diff.schema_table(self.version_read(dataset, which))

    def sql_across(self, dataset: str, views: Mapping[str, str], query: str) -> DataFrame:
        """SQL over several versions; ``views`` maps a table name to a version."""
        return sql_tables({name: self.version_read(dataset, which) for name, which in views.items()}, query)

    def version_lineage(self, dataset: str, which: str = "active") -> DataFrame:
        """(depth, version_id, stage) from the version back to its root."""
        start = self.get(dataset, which).version_id
        return sql_tables({"versions": self.version_list(dataset)}, f"""
            WITH RECURSIVE up(depth, version_id, parent_id, stage) AS (
                SELECT 0, version_id, parent_id, stage FROM versions WHERE version_id = '{start}'
                UNION ALL
                SELECT up.depth + 1, v.version_id, v.parent_id, v.stage
                FROM versions v JOIN up ON v.version_id = up.parent_id
            )
            SELECT depth, version_id, stage FROM up""")

    def version_children(self, dataset: str, which: str) -> DataFrame:
        parent = self.get(dataset, which).version_id
        return self.version_list(dataset).where(F.col("parent_id") == parent).select("version_id", "stage")

    # -- storage ------------------------------------------------------------

    def _listing(self) -> DataFrame:
        base = f"{self.root}/data"
        if not self._exists(base):
            return self.spark.createDataFrame([], "path string, size bigint, dataset string, version_id string")
        listed = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
                  .option("pathGlobFilter", "part-*").load(base)
                  .select("path", F.col("length").alias("size")))
        parts = F.split(F.col("path"), "/")
        return listed.select("path", "size", F.element_at(parts, -3).alias("dataset"),
                             F.element_at(parts, -2).alias("version_id"))

    def version_storage_stats(self, dataset: str | None = None) -> DataFrame:
        rows = self._listing()
        if dataset:
            rows = rows.where(F.col("dataset") == dataset)
        return rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
                        F.count(F.lit(1)).alias("files"),
                        F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_bytes"))

    def unreferenced(self, dataset: str, keep: Sequence[str]) -> DataFrame:
        """Data folders that no kept version points to (a kept one may share its parent's data)."""
        wanted = self.spark.createDataFrame([(k,) for k in keep], "version_id string")
        in_use = self._of(dataset).where("event = 'create'").join(wanted, "version_id", "left_semi").select(
            F.element_at(F.split(F.regexp_replace("location", "/+$", ""), "/"), -1).alias("version_id"))
        return (self._listing().where(F.col("dataset") == dataset)
                .select("version_id").distinct().join(in_use, "version_id", "left_anti"))

    def version_cleanup(self, dataset: str, keep: Sequence[str]) -> list[str]:
        """Remove all versions not listed; returns the ids of the deleted data folders."""
        known = {r["version_id"]: r for r in self.version_list(dataset).collect()}
        unknown = [k for k in keep if k not in known]
        if unknown:
            raise VersionError(f"cannot keep unknown versions {unknown}")
        active = self.get(dataset).version_id
        if active not in keep:
            raise VersionError("the active version has to be kept")
        doomed = sorted(r["version_id"] for r in self.unreferenced(dataset, keep).collect())
        gone = [self._event("remove", Version(i, r["parent_id"], dataset, r["stage"], None, r["location"], None, r["row_count"],
                                              r["column_count"]), makes_active=False) for i, r in known.items() if i not in keep]
        if gone:
            self.log.append(gone)
        for version_id in doomed:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{dataset}/{version_id}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return doomed

    # -- compare ------------------------------------------------------------

    def diff_versions(self, dataset: str, old: str, new: str, keys: Sequence[str] | None = None) -> VersionDiff:
        return diff_tables(self.version_read(dataset, old), self.version_read(dataset, new), keys)


@dataclass
class VersionDiff:
    """Four small tables and a summary of what changed."""

    schema: DataFrame
    rows: DataFrame
    keys: DataFrame | None
    samples: DataFrame | None
    statistics: DataFrame
    renames: DataFrame

    def summary(self) -> DataFrame:
        """(aspect, changes, detail) in long form."""
        shown = self.schema.where("change <> 'unchanged'").select(
            F.concat(F.lit("column "), "change").alias("aspect"), F.lit(1).cast("bigint").alias("changes"),
            F.col("name").alias("detail"))
        renamed = self.renames.select(F.lit("column renamed").alias("aspect"), F.lit(1).cast("bigint").alias("changes"),
                                      F.concat("old_name", F.lit(" -> "), "new_name").alias("detail"))
        counts = self.rows.where("net_added + net_removed > 0").select(
            F.lit("row count").alias("aspect"), (F.col("net_added") + F.col("net_removed")).alias("changes"),
            F.concat(F.col("rows_old").cast("string"), F.lit(" -> "), F.col("rows_new").cast("string")).alias("detail"))
        parts = [shown, renamed, counts]
        if self.keys is not None:
            parts.append(self.keys.where("change <> 'unchanged'").select(
                F.concat(F.lit("rows "), "change").alias("aspect"), F.col("keys").alias("changes"),
                F.lit("by key").alias("detail")))
        return union_all(parts)

    def has_changes(self) -> bool:
        return bool(self.summary().take(1))


def diff_tables(old: DataFrame, new: DataFrame, keys: Sequence[str] | None = None) -> VersionDiff:
    return VersionDiff(
        diff.schema_diff(old, new), diff.diff_row_counts(old, new),
        diff.diff_rows_by_key(old, new, keys) if keys else None,
        diff.sample_changes(old, new, keys) if keys else None,
        diff.mean_shift(old, new), diff.schema_rename_detect(old, new))
