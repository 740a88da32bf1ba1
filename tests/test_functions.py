import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.functions import casts, names, text


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_standard_names():
    assert names.standard_names([" Customer ID ", "customer--id", "1st", "***", "Größe (cm)"]) == [
        "customer_id", "customer_id_1", "col_1st", "col", "größe_cm"]
    assert names.standard_names(["a", "a", "a_1"]) == ["a", "a_1", "a_1_1"]


def test_indicator_label():
    assert names.indicator_label("a  b/c!") == "a_b_c"
    assert names.indicator_label("!!!") == "value"
    assert len(names.indicator_label("x" * 80)) == 32


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=8))
def test_trim_is_what_python_strips_and_idempotent(spark, values):
    values = [v.replace("\x00", "") for v in values]
    white = text.WHITESPACE
    once = column(spark, values, text.trim_whitespace)
    assert once == [v.strip(white) for v in values]
    assert column(spark, once, text.trim_whitespace) == once


def test_text_functions(spark):
    assert column(spark, ["a-b_c é", None], text.remove_special_chars) == ["abc ", None]
    assert column(spark, ["naïve", "ok"], text.remove_non_ascii) == ["nave", "ok"]
    assert column(spark, ["null", "NULL", "", "N/A", "nan", "NaN", "n/a", None, "x"], text.standardise_nulls) == [
        None] * 6 + ["n/a", None, "x"]
    assert column(spark, ["cost -12.5 or 3", "7.", "none", None], text.extract_numbers) == [12.5, 7.0, None, None]
    assert column(spark, ["a\nb", "a\tb", "�"], text.has_control_character) == [True, False, True]


@pytest.mark.parametrize("replacement, expected", [
    ("$2 $1", "b a"), ("${2}0", "b0"), ("$$", "$"), (r"\1", r"\1"), ("", "")])
def test_replacement_notation(spark, replacement, expected):
    assert column(spark, ["a-b"], lambda c: text.regex_replace(c, r"(\w)-(\w)", replacement)) == [expected]


@pytest.mark.parametrize("pattern", ["(", "(?=a)", "(?<!a)b", r"(a)\1"])
def test_refused_patterns(pattern):
    with pytest.raises(text.PatternError):
        text.check_pattern(pattern)


def test_casts(spark):
    assert column(spark, ["Yes", "TRUE", "1", "no", "False", "0", "maybe", None], casts.cast_boolean_tokens) == [
        True, True, True, False, False, False, None, None]
    assert column(spark, ["12", "3.5", "x"], lambda c: casts.cast_step_type(c, "i64")) == [12, None, None]
    assert column(spark, ["3.5"], lambda c: casts.cast_step_type(c, "i64", via_double=True)) == [3]
    with pytest.raises(ValueError):
        casts.cast_step_type(F.col("v"), "i8")
    days = column(spark, ["03.02.2024", "2024-02-03"], lambda c: casts.parse_date(c, "dd.MM.yyyy").cast("string"))
    assert days == ["2024-02-03 00:00:00", None]
