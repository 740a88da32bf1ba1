import pytest
from pyspark.sql import functions as F

from tablewright.operators import clean as K
from tablewright.operators import columns as C
from tablewright.operators import prepare as R


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_impute(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "b"), (None, None), (5.0, "a")], "v double, c string").coalesce(1)
    assert values(R.impute(df, "mean", ["v"]), "v") == [1, 3, 3, 3, 5]
    assert values(R.impute(df, "median", ["v"]), "v") == [1, 3, 3, 3, 5]
    assert values(R.impute(df, "zero", ["v"]), "v") == [1, 0, 3, 0, 5]
    assert values(R.impute(df, "mode", ["c"]), "c") == ["a", "b", "b", "a", "a"]
    with pytest.raises(ValueError):
        R.impute(df, "guess", ["v"])
    with pytest.raises(C.UnknownColumnError):
        R.impute(df, "mean", ["w"])


def test_scaling(spark):
    df = spark.createDataFrame([(10.0, 4.0), (20.0, 4.0), (30.0, None)], "v double, same double").coalesce(1)
    done = R.normalise(df, "minmax", ["v", "same"])
    assert values(done, "v") == [0, 0.5, 1] and values(done, "same") == [0, 0, 0]
    assert values(R.normalise(df, "zscore", ["v"]), "v") == [-1, 0, 1]
    assert values(R.normalise(df, "zscore", ["same"], zero_if_constant=False), "same") == [None] * 3


def test_clip_stays_inside(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v")).union(spark.createDataFrame([(None,)], "v double"))
    got = values(R.clip_outliers(df, ["v"], 0.1, 0.9), "v")
    assert min(v for v in got if v is not None) == 10 and max(v for v in got if v is not None) == 90
    assert got.count(None) == 1
    with pytest.raises(ValueError):
        R.clip_outliers(df, ["v"], 0.9, 0.1)


def test_one_hot(spark):
    df = spark.createDataFrame([("a b",), ("a-b",), (None,)], "c string").coalesce(1)
    done = R.one_hot_encode(df, ["c"])
    assert done.columns == ["c_a_b", "c_a_b_1"]
    assert [tuple(r) for r in done.collect()] == [(1, 0), (0, 1), (0, 0)]
    with pytest.raises(R.TooManyValuesError):
        R.one_hot_encode(spark.range(300).select(F.col("id").cast("string").alias("c")), ["c"])
    with pytest.raises(ValueError):
        R.one_hot_encode(spark.range(3), ["id"])


@pytest.mark.parametrize("few", [1000, 2])
def test_cap_rare_values_both_ways(spark, few):
    rows = [("hot",)] * 500 + [("warm",)] * 40 + [(f"mild{i}",) for i in range(30) for _ in range(5)] \
        + [(f"rare{i}",) for i in range(50)] + [(None,)] * 3
    df = spark.createDataFrame(rows, "c string")
    got = {r["c"]: r["count"] for r in R.cap_rare_values(df, "c", 5, broadcast_values=few).groupBy("c").count().collect()}
    assert got == {"hot": 500, "warm": 40, **{f"mild{i}": 5 for i in range(30)}, "Other": 50, None: 3}


def test_clean_in_order(spark):
    """Mean imputation, then min-max, then one-hot."""
    df = spark.createDataFrame([(10.0, "A"), (20.0, "B"), (None, "A"), (30.0, "C")], "vals double, cat string").coalesce(1)
    done = K.clean(df, {
        "vals": K.CleanSetting(ml_preprocessing=True, impute_mode="mean", normalisation="minmax"),
        "cat": K.CleanSetting(ml_preprocessing=True, one_hot_encode=True)})
    assert done.columns == ["vals", "cat_A", "cat_B", "cat_C"]
    assert [tuple(r) for r in done.collect()] == [(0, 1, 0, 0), (0.5, 0, 1, 0), (0.5, 1, 0, 0), (1, 0, 0, 1)]


def test_restricted_leaves_out_clip_round_scale(spark):
    df = spark.createDataFrame([(1.234, " X "), (None, "y")], "v double, t string").coalesce(1)
    settings = {"v": K.CleanSetting(ml_preprocessing=True, impute_mode="zero", rounding=1, normalisation="zscore"),
                "t": K.CleanSetting(new_name="label", trim_whitespace=True, text_case="lower")}
    done = K.clean(df, settings, restricted=True)
    assert [tuple(r) for r in done.collect()] == [(1.234, "x"), (0.0, "y")] and done.columns == ["v", "label"]


def test_settings_from_json():
    s = K.CleanSetting.from_json({"text_case": "TitleCase", "normalisation": "ZScore", "impute_mode": "Mean",
                                  "advanced_cleaning": True, "target_dtype": "Numeric"})
    assert (s.text_case, s.normalisation, s.impute_mode, s.target_dtype) == ("title", "zscore", "mean", "Numeric")
    with pytest.raises(ValueError):
        K.CleanSetting.from_json({"impute_mode": "best"})


def test_dirty_names(spark):
    df = spark.createDataFrame([(" Ann\r", " 30"), ("\tBob ", "x")], "name string, age string").coalesce(1)
    done = K.clean(df, {"name": K.CleanSetting(trim_whitespace=True),
                        "age": K.CleanSetting(trim_whitespace=True, target_dtype="Numeric")})
    assert [tuple(r) for r in done.collect()] == [("Ann", 30.0), ("Bob", None)]


def test_very_wide_clean(spark):
    df = spark.range(5).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(400)])
    settings = {c: K.CleanSetting(trim_whitespace=True, standardise_nulls=True, text_case="upper",
                                  new_name=f"n_{c}") for c in df.columns}
    assert K.clean(df, settings).count() == 5


def test_drop_nulls_keeps_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 2), (1.0, None)], "a double, b int")
    assert C.drop_nulls(df).count() == 1 and C.drop_nulls(df, ["a"]).count() == 2
