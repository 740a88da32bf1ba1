"""Findings and advice as expressions over the profile table.

Every rule is a condition over one profile row with a code, a technical text and, for some, a
plain-language text.  All rules of all columns are evaluated in one projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the rules.
MISSING_SOME, MISSING_MUCH, MISSING_MOST = 5.0, 15.0, 40.0
SKEW_LIMIT = 0.5
GAP_LIMIT = 0.1
OFFSET_LIMIT = 0.3
SPREAD_LOW, SPREAD_HIGH = 0.1, 0.6
ZOOM_FACTOR = 3.0
TINY_SHARE = 0.005
DOMINANT_SHARE = 0.9
PEAK_FACTOR = 1.5
PEAK_PROMINENCE = 1.2
UNEVEN_FACTOR = 5.0
ZERO_SHARE = 0.3
MANY_BINS = 40
TIME_GAP_BINS = 2.5
INTERVAL_TOLERANCE = 0.1
TINY = 1e-9

# Name parts that mark an identifier.
ID_NAMES = ["id", "uuid", "pk", "key", "code"]


@dataclass(frozen=True)
class Rule:
    group: str
    code: str
    when: Column
    message: str
    plain: str | None = None


def _kind(name: str) -> Column:
    return F.col("kind") == name


def _num(name: str) -> Column:
    return F.col(f"numeric.{name}")


def _bins() -> Column:
    return _num("histogram")


def _bin_count(bins: Column) -> Column:
    """Total of a bin array."""
    return F.aggregate(bins, F.lit(0).cast("bigint"), lambda acc, b: acc + b["count"])


def _peak(bins: Column) -> Column:
    return F.array_max(F.transform(bins, lambda b: b["count"]))


def _inner_bins(bins: Column) -> Column:
    return F.filter(bins, lambda b, i: (i > 0) & (i < F.size(bins) - 1))


def _peak_number(bins: Column) -> Column:
    """Inner bins that stand clearly above both neighbours."""
    counts = F.transform(bins, lambda b: b["count"])
    before, after = F.slice(counts, 1, F.greatest(F.size(counts) - 2, F.lit(0))), F.slice(
        counts, 3, F.greatest(F.size(counts) - 2, F.lit(0)))
    middle = F.slice(counts, 2, F.greatest(F.size(counts) - 2, F.lit(0)))
    triples = F.arrays_zip(before.alias("a"), middle.alias("b"), after.alias("c"))
    return F.when(F.size(bins) < 3, F.lit(0)).otherwise(F.size(F.filter(
        triples, lambda t: (t["a"] < t["b"]) & (t["c"] < t["b"])
        & (t["b"] > PEAK_PROMINENCE * (t["a"] + t["b"] + t["c"]) / 3.0))))


def _rules() -> list[Rule]:
    rules: list[Rule] = []

    def add(group: str, code: str, when: Column, message: str, plain: str | None = None) -> None:
        rules.append(Rule(group, code, when, message, plain))

    nulls, pct = F.col("null_count"), F.col("null_pct")
    add("missing", "complete", nulls == 0, "no value is missing",
        "Nothing is missing in this column.")
    add("missing", "missing_much", (nulls > 0) & (pct > MISSING_MUCH),
        "so many values are missing that results can be biased",
        "Many entries are missing; conclusions may be incomplete.")
    add("missing", "missing_some", (nulls > 0) & (pct > MISSING_SOME) & (pct <= MISSING_MUCH),
        "a noticeable part of the values is missing",
        "Some entries lack this detail.")

    is_num = _kind("Numeric") & _num("mean").isNotNull() & _num("median").isNotNull()
    low, high, mean, median = _num("min"), _num("max"), _num("mean"), _num("median")
    q1, q3, sd, skew = _num("q1"), _num("q3"), _num("stddev"), _num("skew")
    span, iqr = high - low, q3 - q1
    total = _bin_count(_bins())
    zero_share = F.coalesce(F.try_divide(_num("zero_count"), total), F.lit(0.0))
    up, down = F.coalesce(F.col("is_sorted"), F.lit(False)), F.coalesce(F.col("is_sorted_desc"), F.lit(False))

    add("numeric", "constant", is_num & (span == 0), "all values are the same",
        "Every entry holds the same number.")
    add("numeric", "ascending", is_num & up, "values never fall in row order",
        "The numbers follow the order of the rows.")
    add("numeric", "descending", is_num & ~up & down, "values never rise in row order")
    add("numeric", "whole_numbers", is_num & _num("is_integer"), "all values are whole numbers",
        "Only whole numbers occur, as for counts.")
    add("numeric", "has_zeros", is_num & (_num("zero_count") > 0), "zeros occur")
    add("numeric", "many_zeros", is_num & (_num("zero_count") > 0) & (zero_share > ZERO_SHARE),
        "zeros are frequent and may stand for missing values",
        "Many entries are zero and may be empty or inactive.")
    add("numeric", "some_zeros", is_num & (_num("zero_count") > 0) & (zero_share <= ZERO_SHARE), "",
        "Zero occurs as a neutral value.")
    add("numeric", "has_negatives", is_num & (_num("negative_count") > 0), "negative values occur",
        "Negative numbers occur, such as corrections or refunds.")
    add("numeric", "outliers", is_num & ((low < q1 - 1.5 * iqr) | (high > q3 + 1.5 * iqr)),
        "values lie more than 1.5 interquartile ranges outside the quartiles")

    fallback = F.abs(mean - median) / F.greatest(iqr, F.coalesce(sd, F.lit(0.0)) * 0.1, F.lit(TINY))
    symmetric = F.when(skew.isNotNull(), F.abs(skew) < SKEW_LIMIT).otherwise(fallback < SKEW_LIMIT)
    rightward = F.when(skew.isNotNull(), skew > 0).otherwise(mean > median)
    known_skew = skew.isNotNull()
    add("distribution", "symmetric", is_num & symmetric, "the distribution is symmetric")
    add("distribution", "right_skewed", is_num & ~symmetric & rightward,
        "skewed to the right: high values raise the mean")
    add("distribution", "left_skewed", is_num & ~symmetric & ~rightward,
        "skewed to the left: low values lower the mean")
    add("distribution", "balanced_plain", is_num & known_skew & symmetric, "",
        "The values are balanced around their middle.")
    add("distribution", "high_tail_plain", is_num & known_skew & ~symmetric & rightward, "",
        "A few high values pull the average up.")
    add("distribution", "low_tail_plain", is_num & known_skew & ~symmetric & ~rightward, "",
        "A few low values pull the average down.")
    add("distribution", "mean_median_gap",
        is_num & (F.abs(median) > TINY)
        & (F.try_divide(F.abs(mean - median), F.abs(median)) > GAP_LIMIT),
        "mean and median differ by more than a tenth")
    spread = is_num & (sd > 0)
    add("distribution", "unreliable_deviation",
        spread & (F.try_divide(F.abs(mean - median), sd) > OFFSET_LIMIT),
        "the mean is so far off the median that the deviation says little",
        "The average does not describe a typical entry.")
    cv = F.try_divide(sd, F.abs(mean))
    add("distribution", "high_variation", spread & (F.abs(mean) > TINY) & (cv > 1.0),
        "the deviation exceeds the mean")
    add("distribution", "low_variation", spread & (F.abs(mean) > TINY) & (cv < 0.1),
        "values lie close to the mean")
    percent = (low >= 0) & (high <= 100) & (_num("p05") >= 0) & (_num("p95") <= 100)
    add("distribution", "percent_plain", is_num & percent, "",
        "Nine of ten values lie inside a usual score or percentage range.")
    add("distribution", "central_plain", is_num & ~percent, "",
        "The middle nine tenths of the values give a dependable range.")

    wide = is_num & (span > 0)
    add("histogram", "clustered", wide & (F.try_divide(iqr, span) < SPREAD_LOW),
        "most values sit close to the centre of the range")
    add("histogram", "spread_out", wide & (F.try_divide(iqr, span) > SPREAD_HIGH),
        "values are spread over the range")
    add("histogram", "gaps", wide & (F.size(_bins()) >= 3)
        & F.exists(_inner_bins(_bins()), lambda b: b["count"] == 0),
        "empty bins separate parts of the data")
    add("histogram", "fine_grained", wide & (F.size(_bins()) > MANY_BINS),
        "many bins are needed to describe the values")
    zoom = _num("p95") - _num("p05")
    add("histogram", "stretched", wide & (zoom > 0) & (span > ZOOM_FACTOR * zoom),
        "extreme values stretch the range")
    peak = _peak(_bins()).cast("double")
    add("histogram", "tiny_bars", wide & F.exists(
        _bins(), lambda b: (b["count"] > 0) & (b["count"] < peak * TINY_SHARE)),
        "some bins are tiny beside the highest")
    add("histogram", "one_bin", wide & (total > 0) & (F.try_divide(peak, total) > DOMINANT_SHARE),
        "one bin holds nearly all rows")
    bell = F.try_divide(total * _num("bin_width"), sd * math.sqrt(2.0 * math.pi))
    shaped = is_num & (sd > 0) & (F.size(_bins()) > 0)
    add("histogram", "steeper_than_normal", shaped & (peak > bell * PEAK_FACTOR),
        "more concentrated than a normal distribution")
    add("histogram", "flatter_than_normal", shaped & (peak < bell / PEAK_FACTOR),
        "flatter than a normal distribution or of several parts")
    add("histogram", "several_peaks", is_num & (F.size(_bins()) > 5) & (_peak_number(_bins()) >= 2),
        "several peaks hint at subgroups")

    is_cat = _kind("Categorical")
    n, present = F.col("distinct_count"), F.col("row_count") - F.col("null_count")
    most, least = F.col("text.max_frequency"), F.col("text.min_frequency")
    uneven = F.coalesce(F.try_divide(most, least) > UNEVEN_FACTOR, F.lit(False))
    all_once = F.coalesce(most == 1, F.lit(True))
    add("categorical", "constant", is_cat & (n == 1), "all values are the same",
        "Every entry falls into the same category.")
    add("categorical", "unique", is_cat & all_once & (n > 1), "every value occurs once",
        "Each entry has a number or name of its own.")
    add("categorical", "category", is_cat & ~(all_once & (n > 1)), "a field of categories")
    plain_cat = is_cat & ~all_once & (n > 1)
    add("categorical", "two_values", is_cat & (n == 2), "two values: a switch or a yes/no answer")
    add("categorical", "two_values_plain", plain_cat & (n == 2), "",
        "A choice between two values.")
    add("categorical", "uneven", is_cat & (n > 1) & uneven, "a few values dominate")
    add("categorical", "uneven_plain", plain_cat & (n > 2) & uneven, "",
        "Some categories are far more common than others.")
    add("categorical", "even_plain", plain_cat & (n > 2) & ~uneven, "",
        "The entries are spread well over the categories.")
    add("categorical", "many_plain", plain_cat & (n > 50), "",
        "There are too many categories for a simple report.")
    ratio = F.coalesce(F.try_divide(n, present), F.lit(0.0))
    add("categorical", "mostly_unique", is_cat & (present > 0) & (ratio > 0.5),
        "more than half of the values are different; group rare ones")
    add("categorical", "many_values", is_cat & (present > 0) & (ratio <= 0.5) & (n > 100),
        "more than 100 categories")

    is_time = _kind("Temporal")
    line, width = F.col("temporal.timeline"), F.col("temporal.bin_width")
    filled = F.filter(line, lambda b: b["count"] > 0)
    steps = F.zip_with(F.slice(filled, 1, F.greatest(F.size(filled) - 1, F.lit(0))),
                       F.slice(filled, 2, F.greatest(F.size(filled) - 1, F.lit(0))),
                       lambda a, b: b["bin_start"] - a["bin_start"])
    average = F.try_divide(F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x), F.size(steps))
    variance = F.try_divide(F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + (x - average) * (x - average)),
                            F.size(steps))
    gap = F.exists(steps, lambda x: x > width * TIME_GAP_BINS)
    add("temporal", "time_sequence", is_time, "points in time",
        "Tells when something happened.")
    add("temporal", "chronological", is_time & up, "in chronological order",
        "Entries are stored in the order of time.")
    add("temporal", "reverse_chronological", is_time & ~up & down, "in reverse chronological order")
    add("temporal", "time_gaps", is_time & gap, "long stretches without any row",
        "There are long periods without activity.")
    add("temporal", "regular", is_time & (F.col("distinct_count") > 10) & (F.size(filled) > 2)
        & (variance < (average * INTERVAL_TOLERANCE) * (average * INTERVAL_TOLERANCE)),
        "spread regularly over time")

    is_text = _kind("Text")
    unique_text = (F.col("distinct_count") == F.col("row_count")) & (nulls == 0)
    add("text", "constant", is_text & (F.col("distinct_count") == 1), "all values are the same",
        "Every entry is identical.")
    add("text", "unique", is_text & unique_text, "every value occurs once",
        "Each entry has a number or name of its own.")
    add("text", "free_text", is_text & ~unique_text, "ordinary text",
        "Descriptive text.")
    add("text", "fixed_length", is_text & (F.col("text.min_length") == F.col("text.max_length"))
        & (F.col("text.min_length") > 0), "all values have the same length",
        "All entries have the same length, as codes do.")

    is_bool = _kind("Boolean")
    add("boolean", "two_values", is_bool, "a switch or a yes/no answer", "A yes/no state.")
    add("boolean", "constant", is_bool & ((F.col("boolean.true_count") == 0) | (F.col("boolean.false_count") == 0)),
        "only one of the two states occurs")

    add("quality", "special_characters", F.col("has_special"), "unusual or hidden characters")
    add("quality", "odd_name", F.col("name") != F.col("standard_name"), "the name is not in standard form")
    return rules


def _coalesced(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def with_insights(profile: DataFrame) -> DataFrame:
    """Add ``insights`` (technical) and ``summary`` (plain language) arrays to a profile."""
    rules = _rules()
    findings = F.array_compact(F.array(*[
        F.when(_coalesced(r.when), F.struct(F.lit(r.group).alias("group"), F.lit(r.code).alias("code"),
                                            F.lit(r.message).alias("message")))
        for r in rules if r.message]))
    plain = F.array_compact(F.array(*[
        F.when(_coalesced(r.when), F.struct(F.lit(r.group).alias("group"), F.lit(r.code).alias("code"),
                                            F.lit(r.plain).alias("message")))
        for r in rules if r.plain]))
    nothing = F.array(F.struct(F.lit("quality").alias("group"), F.lit("nothing_found").alias("code"),
                               F.lit("nothing remarkable").alias("message")))
    return (profile.withColumn("insights", findings).withColumn("summary", plain)
            .withColumn("insights", F.when(F.size("insights") == 0, nothing).otherwise(F.col("insights")))
            .withColumn("summary", F.when(F.size("summary") == 0, nothing).otherwise(F.col("summary"))))


def insights(profile: DataFrame, *groups: str) -> DataFrame:
    """Findings in long form: (name, group, code, message)."""
    long = with_insights(profile).select("name", F.inline("insights"))
    return long.where(F.col("group").isin(*groups)) if groups else long


def business_summary(profile: DataFrame) -> DataFrame:
    return with_insights(profile).select("name", F.inline("summary"))


# ---------------------------------------------------------------- advice for model building

def is_id_name(name: Column) -> Column:
    """One of the identifier words stands alone, in front, in the middle or at the end."""
    return F.lower(name).rlike(r"(^|_)(" + "|".join(ID_NAMES) + r")(_|$)")


def likely_identifier(profile_row_kind: Column | None = None) -> Column:
    unique = (F.col("distinct_count") == F.col("row_count")) & (F.col("null_count") == 0)
    named = is_id_name(F.col("name")) & (F.col("uniqueness_ratio") > 0.3)
    counted = (_kind("Numeric") & F.coalesce(_num("is_integer"), F.lit(False))
               & F.coalesce(F.col("is_sorted"), F.lit(False)) & (F.col("uniqueness_ratio") > 0.5))
    return _coalesced(unique | named | counted)


def with_advice_flags(profile: DataFrame) -> DataFrame:
    """The conditions of all advice as boolean columns."""
    numeric, category = _kind("Numeric"), F.col("kind").isin("Categorical", "Boolean")
    nulls, pct = F.col("null_count"), F.col("null_pct")
    some_missing = (nulls > 0) & (pct <= MISSING_MOST)
    ident = F.col("is_identifier")
    flags = {
        "exclude_identifier": ident,
        "identifier_by_name": ident & is_id_name(F.col("name")),
        "no_linear_feature": numeric & ident,
        "regression": numeric & ~ident,
        "clip": numeric & (F.abs(_num("skew")) > SKEW_LIMIT),
        "classification": category,
        "one_hot": category,
        "cap_categories": _kind("Categorical") & (F.col("distinct_count") > 20),
        "extract_features": _kind("Text") & ~ident,
        "exclude_missing": (nulls > 0) & (pct > MISSING_MOST),
        "impute_mean": some_missing & numeric,
        "impute_mode": some_missing & category,
        "scale": numeric & ~ident,
        "zero_inflated": numeric & ~ident & (F.try_divide(_num("zero_count"), F.col("row_count")) > ZERO_SHARE),
        "standard_name": F.col("name") != F.col("standard_name"),
    }
    base = profile.withColumn("is_identifier", likely_identifier())
    return base.select("*", *[_coalesced(c).alias(f"advise_{n}") for n, c in flags.items()])


# Texts of the advice, in the order they are given.
ADVICE = {
    "exclude_identifier": "leave this identifier out of the features",
    "identifier_by_name": "name and variety of values mark an identifier",
    "no_linear_feature": "do not use numeric identifiers in linear models",
    "regression": "fit for linear regression, as target or feature",
    "clip": "clip outliers for a more stable model",
    "classification": "fit as the target of a logistic regression or a decision tree",
    "one_hot": "one-hot encode to use as a feature",
    "cap_categories": "group rare values before encoding",
    "extract_features": "derive features from the text or turn it into categories",
    "exclude_missing": "mostly empty: consider leaving the column out",
    "impute_mean": "fill missing values with the mean or the median",
    "impute_mode": "fill missing values with the most frequent value",
    "scale": "scale if other numeric features differ in size",
    "zero_inflated": "zeros are frequent: consider a zero-inflated model",
    "standard_name": "give the column a standard name",
}


def ml_advice(profile: DataFrame) -> DataFrame:
    """Advice in long form: (name, kind, code, message)."""
    given = F.array_compact(F.array(*[
        F.when(F.col(f"advise_{code}"), F.struct(F.lit(code).alias("code"), F.lit(text).alias("message")))
        for code, text in ADVICE.items()]))
    default = F.array(F.struct(F.lit("check_types").alias("code"),
                               F.lit("clean the data and check the types first").alias("message")))
    return (with_advice_flags(profile)
            .select("name", "kind", given.alias("advice"))
            .select("name", "kind", F.inline(F.when(F.size("advice") == 0, default).otherwise(F.col("advice")))))


def with_setting_flags(profile: DataFrame) -> DataFrame:
    """Flags from which automatic cleaning settings are made."""
    texts = F.col("kind").isin("Text", "Categorical")
    return with_advice_flags(profile).select(
        "position", "name", "standard_name", "kind",
        texts.alias("set_trim"), texts.alias("set_nulls"), F.col("has_special").alias("set_special"),
        F.col("advise_clip").alias("set_clip"), F.col("advise_scale").alias("set_scale"),
        F.col("advise_impute_mean").alias("set_impute"), F.col("advise_one_hot").alias("set_one_hot"))


def column_warnings(profile: DataFrame) -> DataFrame:
    """Warnings per column: mostly empty, constant, like an identifier."""
    n, ratio = F.col("distinct_count"), F.col("uniqueness_ratio")
    return profile.select("position", "name", F.array_compact(F.array(
        F.when(F.col("null_pct") > 50.0, F.format_string("%.1f%% of the values are missing", "null_pct")),
        F.when(n == 1, F.lit("only one distinct value")),
        F.when((ratio > 0.95) & (n > 100), F.format_string("like an identifier: %.1f%% unique values", ratio * 100)),
    )).alias("warnings"))
