"""Three small models on ``pyspark.ml``: linear regression, logistic regression, decision tree."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field as dataclass_field
from functools import reduce
from operator import or_

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import casts
from tablewright.operators import aggregates as A
from tablewright.operators import quantiles as Q
from tablewright.operators.columns import require
from tablewright.operators.ordering import row_index

MODEL_KINDS = ("linear_regression", "logistic_regression", "decision_tree")
TRAIN_SHARE = 0.8


class ModelError(ValueError):
    """The table cannot train the wanted model."""


@dataclass
class ModelResult:
    kind: str
    target: str
    features: list[str]
    r2: float | None = None
    mse: float | None = None
    accuracy: float | None = None
    coefficients: dict[str, float] = dataclass_field(default_factory=dict)
    intercept: float | None = None
    seconds: float = 0.0
    rows_with_gaps: int = 0  # rows that a missing feature keeps out of training and scoring


def feature_columns(df: DataFrame, target: str) -> list[str]:
    return [f.name for f in df.schema if f.name != target
            and (casts.is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType))]


def ml_features(df: DataFrame, target: str, keep: Sequence[str] = (),
                exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Rows with a target; all other numeric and boolean columns as double, plus ``keep``."""
    require(df, [target])
    names = [c for c in feature_columns(df, target) if c not in set(exclude)]
    if not names:
        raise ModelError(f"no numeric or boolean column besides {target!r}")
    kept = [A.field(c).alias(f"__keep_{i}") for i, c in enumerate(keep)]
    rows = df.where(A.field(target).isNotNull()).select(
        A.field(target), *[A.field(c).cast("double").alias(c) for c in names], *kept)
    return rows, names


def ml_split(df: DataFrame, order_by: Sequence[str] | None = None,
             share: float = TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """First part for training, rest for testing, in the order of the keys.

    A single numeric or temporal key needs no sort: the key value at the cut is found exactly
    and two filters do the rest; among rows that share the cut value a hash decides.  Several keys
    take row positions.  Without a key a hash of the row decides.
    """
    if not order_by:
        bucket = F.pmod(F.xxhash64(*[A.field(c) for c in df.columns]), F.lit(1000))
        return df.where(bucket < int(share * 1000)), df.where(bucket >= int(share * 1000))
    first = df.schema[order_by[0]].dataType
    if len(order_by) == 1 and (casts.is_numeric(first) or casts.is_temporal(first)):
        key = Q.value_column(df, order_by[0])
        n = df.agg(F.count(key)).first()[0]
        cut = int(n * share)
        if cut == 0:
            return df.limit(0), df
        at = Q.order_statistics(df, {order_by[0]: [cut - 1]})[order_by[0]][cut - 1]
        counts = df.agg(F.count_if(key < at).alias("below"), F.count_if(key == at).alias("ties")).first()
        wanted = cut - counts["below"]
        if wanted == counts["ties"]:
            return df.where(key <= at), df.where((key > at) | key.isNull())
        # The cut runs through rows of one key: the order of their hashes decides; equal rows stay together.
        tagged = df.withColumn("__tie", F.xxhash64(*[A.field(c) for c in df.columns]).cast("decimal(38,0)") % (1 << 50))
        tagged = tagged.withColumn("__tie", F.col("__tie").cast("double"))
        last = Q.order_statistics(tagged.where(key == at), {"__tie": [wanted - 1]})["__tie"][wanted - 1]
        first = (key < at) | ((key == at) & (F.col("__tie") <= last))
        return (tagged.where(first).drop("__tie"), tagged.where(~first | key.isNull()).drop("__tie"))
    placed = row_index(df, order_by, "__position")
    cut = int(placed.count() * share)
    return (placed.where(F.col("__position") < cut).drop("__position"),
            placed.where(F.col("__position") >= cut).drop("__position"))


MOST_CLASSES = 1_000  # a model and its label index grow with them


def ml_class_check(df: DataFrame, target: str, most: int | None = None) -> int:
    """Number of classes; fewer than two is an error, and so are more than ``most``.  Null is no class."""
    n = df.agg(F.count_distinct(A.field(target))).first()[0]
    if n < 2:
        raise ModelError(f"classification needs at least two classes in {target!r}, found {n}")
    if most is not None and n > most:
        raise ModelError(f"{target!r} has {n} classes, more than {most}")
    return n


def train_model(df: DataFrame, kind: str, target: str, order_by: Sequence[str] | None = None,
                exclude: Sequence[str] = (), refuse_gaps: bool = False, most_classes: int = MOST_CLASSES) -> ModelResult:
    """Train on the first 80 % and score on the rest.  Rows that lack a feature are left out and counted in the result,
    or refused."""
    if kind not in MODEL_KINDS:
        raise ModelError(f"unknown model {kind!r}; known: {', '.join(MODEL_KINDS)}")
    started = time.monotonic()
    keys = list(order_by or [])
    rows, names = ml_features(df, target, keep=keys, exclude=exclude)
    if kind != "linear_regression":
        ml_class_check(rows, target, most_classes)
    gaps = reduce(or_, (A.field(c).isNull() | F.isnan(A.field(c)) for c in names))
    skipped = rows.agg(F.count_if(gaps)).first()[0]
    if skipped and refuse_gaps:
        raise ModelError(f"{skipped} rows lack a feature; fill them first")
    train, test = ml_split(rows, [f"__keep_{i}" for i, _ in enumerate(keys)] or None)
    inputs = VectorAssembler(inputCols=names, outputCol="__features", handleInvalid="skip")
    result = ModelResult(kind, target, names, rows_with_gaps=skipped)
    if kind == "linear_regression":
        label = F.col(f"`{target}`").cast("double").alias("__label")
        prepared = [inputs.transform(part.select("*", label)).select("__features", "__label")
                    for part in (train, test)]
        model = LinearRegression(featuresCol="__features", labelCol="__label", solver="normal",
                                 regParam=0.0, standardization=False).fit(prepared[0])
        scored = model.transform(prepared[1])
        error = F.col("__label") - F.col("prediction")
        row = scored.agg(F.avg(error * error).alias("mse"), F.var_pop("__label").alias("spread")).first()
        result.mse = row["mse"]
        result.r2 = 1 - row["mse"] / row["spread"] if row["mse"] is not None and row["spread"] else None
        result.coefficients = dict(zip(names, map(float, model.coefficients)))
        result.intercept = float(model.intercept)
    else:
        labels = StringIndexer(inputCol="__class", outputCol="__label", stringOrderType="alphabetAsc",
                               handleInvalid="skip")
        named = F.col(f"`{target}`").cast("string").alias("__class")
        train, test = (inputs.transform(part.select("*", named)).select("__features", "__class")
                       for part in (train, test))
        indexer = labels.fit(train)
        known = indexer.transform(train)
        indexer.setHandleInvalid("keep")  # a class that training has not seen is a miss, not a row less
        learner = (LogisticRegression if kind == "logistic_regression" else DecisionTreeClassifier)(
            featuresCol="__features", labelCol="__label")
        scored = learner.fit(known).transform(indexer.transform(test))
        hit = (F.col("__label") == F.col("prediction")).cast("double")
        result.accuracy = scored.agg(F.avg(hit)).first()[0]
    result.seconds = time.monotonic() - started
    return result


def result_table(df: DataFrame, result: ModelResult) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(result.kind, result.target, result.features, result.r2, result.mse, result.accuracy,
          result.coefficients, result.intercept, result.rows_with_gaps)],
        "kind string, target string, features array<string>, r2 double, mse double, "
        "accuracy double, coefficients map<string,double>, intercept double, rows_with_gaps bigint")


def target_suitability(profile: DataFrame) -> DataFrame:
    """Which models each column can be the target of."""
    return profile.select(
        "name", "kind", (F.col("kind") == "Numeric").alias("linear_regression"),
        F.col("kind").isin("Boolean", "Categorical").alias("logistic_regression"),
        F.col("kind").isin("Boolean", "Categorical").alias("decision_tree"))


# Limits of the verdicts on a model.
STRONG_R2, MODERATE_R2 = 0.7, 0.3
GOOD_ACCURACY, POOR_ACCURACY = 0.8, 0.6
TOP_DRIVERS = 3


def ml_interpretation(results: DataFrame) -> DataFrame:
    """Verdicts on model results in long form: (kind, target, code, message)."""
    percent = F.round(F.greatest(F.col("r2"), F.lit(0.0)) * 100, 1).cast("string")
    hits = F.round(F.col("accuracy") * 100, 1).cast("string")
    ranked = F.slice(F.reverse(F.array_sort(F.transform(
        F.map_entries(F.coalesce("coefficients", F.create_map().cast("map<string,double>"))),
        lambda e: F.struct(F.abs(e["value"]).alias("size"), e["key"].alias("name"), e["value"].alias("value"))))),
        1, TOP_DRIVERS)
    drivers = F.transform(ranked, lambda d: F.struct(
        F.lit("driver").alias("code"),
        F.concat(F.lit("a higher "), d["name"], F.when(d["value"] > 0, " raises ").otherwise(" lowers "),
                 F.col("target")).alias("message")))

    def verdict(when, code, *message):
        return F.when(when, F.struct(F.lit(code).alias("code"), F.concat(*message).alias("message")))

    strength = F.array_compact(F.array(
        verdict(F.col("r2") > STRONG_R2, "strong", F.lit("explains much of the variation: "), percent, F.lit("%")),
        verdict((F.col("r2") <= STRONG_R2) & (F.col("r2") > MODERATE_R2), "moderate",
                F.lit("explains part of the variation: "), percent, F.lit("%")),
        verdict(F.col("r2") <= MODERATE_R2, "weak", F.lit("explains little of the variation: "), percent, F.lit("%")),
        verdict(F.col("accuracy").isNotNull(), "accuracy", F.lit("right in "), hits, F.lit("% of the cases")),
        verdict(F.col("accuracy") > GOOD_ACCURACY, "reliable", F.lit("a dependable classifier")),
        verdict(F.col("accuracy") < POOR_ACCURACY, "unreliable", F.lit("close to guessing: add better features"))))
    return results.select("kind", "target", F.inline(F.concat(strength, drivers)))
