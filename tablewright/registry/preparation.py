"""Queries of imputation, scaling, clipping and encoding, as steps and as settings."""

from pyspark.sql import functions as F

from tablewright.operators import clean as K
from tablewright.operators import prepare as R
from tablewright.registry.core import GAPPY, gappy, query, rounded, table

KEYS = ["l_orderkey", "l_linenumber"]


def _lines(spark, sf, *columns):
    return gappy(spark, sf).select(*KEYS, *columns)


def _numeric(name, fn, column, expression, extra=""):
    @query(name, f"WITH {GAPPY}{extra} SELECT l_orderkey, l_linenumber, round({expression}, 6) AS {column} FROM "
                 + ("gappy" if not extra else "last"))
    def run(spark, sf):
        return rounded(fn(_lines(spark, sf, column)), 6, column)
    return run


PRICE, QTY = "l_extendedprice", "l_quantity"

_numeric("impute_zero", lambda df: R.impute(df, "zero", [PRICE]), PRICE, f"coalesce({PRICE}, 0)")
_numeric("impute_mean", lambda df: R.impute(df, "mean", [PRICE]), PRICE, f"coalesce({PRICE}, avg({PRICE}) OVER ())")
_numeric("impute_median", lambda df: R.impute(df, "median", [PRICE]), PRICE, f"coalesce({PRICE}, median({PRICE}) OVER ())")
_numeric("normalise_minmax", lambda df: R.normalise(df, "minmax", [PRICE]), PRICE,
         f"({PRICE} - min({PRICE}) OVER ()) / (max({PRICE}) OVER () - min({PRICE}) OVER ())")
_numeric("normalise_zscore", lambda df: R.normalise(df, "zscore", [PRICE]), PRICE,
         f"({PRICE} - avg({PRICE}) OVER ()) / stddev_samp({PRICE}) OVER ()")

_QUANT = f", q AS (SELECT quantile_cont({PRICE}, {{lo}}) AS lo, quantile_cont({PRICE}, {{hi}}) AS hi FROM gappy), " \
         "last AS (SELECT * FROM gappy CROSS JOIN q)"
_CLIPPED = f"CASE WHEN {PRICE} IS NOT NULL THEN least(greatest({PRICE}, lo), hi) END"
_numeric("clip_outliers", lambda df: R.clip_outliers(df, [PRICE], 0.1, 0.9), PRICE, _CLIPPED,
         _QUANT.format(lo=0.1, hi=0.9))
_numeric("clip_outliers_config",
         lambda df: K.clean(df, {PRICE: K.CleanSetting(ml_preprocessing=True, clip_outliers=True)}), PRICE, _CLIPPED,
         _QUANT.format(lo=0.05, hi=0.95))


@query("impute_mode", f"""
WITH {GAPPY}, m AS (SELECT l_returnflag AS v FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
n AS (SELECT l_quantity AS w FROM gappy WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, v) AS l_returnflag, coalesce(l_quantity, w) AS l_quantity
FROM gappy CROSS JOIN m CROSS JOIN n""")
def impute_mode(spark, sf):
    return R.impute(_lines(spark, sf, "l_returnflag", QTY), "mode", ["l_returnflag", QTY])


@query("impute_config", f"""
WITH {GAPPY}, m AS (SELECT l_returnflag AS v FROM gappy WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT l_orderkey, l_linenumber, round(coalesce(l_extendedprice, avg(l_extendedprice) OVER ()), 6) AS price,
       coalesce(l_quantity, median(l_quantity) OVER ()) AS l_quantity, coalesce(l_returnflag, v) AS l_returnflag
FROM gappy CROSS JOIN m""")
def impute_config(spark, sf):
    def fill(mode, name=""):
        return K.CleanSetting(ml_preprocessing=True, impute_mode=mode, new_name=name)
    done = K.clean(_lines(spark, sf, PRICE, QTY, "l_returnflag"),
                   {PRICE: fill("mean", "price"), QTY: fill("median"), "l_returnflag": fill("mode")}, restricted=True)
    return rounded(done, 6, "price")


@query("normalise_config", f"""
WITH {GAPPY}, i AS (SELECT l_orderkey, l_linenumber, coalesce(l_extendedprice, avg(l_extendedprice) OVER ()) AS p,
                           l_quantity AS q FROM gappy),
c AS (SELECT quantile_cont(p, 0.05) AS lo, quantile_cont(p, 0.95) AS hi FROM i),
d AS (SELECT l_orderkey, l_linenumber, q, least(greatest(p, lo), hi) AS p FROM i CROSS JOIN c)
SELECT l_orderkey, l_linenumber, round((p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER ()), 6) AS l_extendedprice,
       round((q - avg(q) OVER ()) / stddev_samp(q) OVER (), 6) AS l_quantity, CAST(NULL AS DOUBLE) AS same FROM d""")
def normalise_config(spark, sf):
    df = _lines(spark, sf, PRICE, QTY).withColumn("same", F.lit(3.0))
    done = K.clean(df, {
        PRICE: K.CleanSetting(ml_preprocessing=True, impute_mode="mean", clip_outliers=True, normalisation="minmax"),
        QTY: K.CleanSetting(ml_preprocessing=True, normalisation="zscore"),
        "same": K.CleanSetting(ml_preprocessing=True, normalisation="zscore")})
    return rounded(done, 6, PRICE, QTY)


@query("one_hot_encode", f"""
WITH {GAPPY} SELECT l_orderkey, l_linenumber, l_returnflag,
       CAST(coalesce(l_returnflag = 'A', false) AS INTEGER) AS l_returnflag_A,
       CAST(coalesce(l_returnflag = 'N', false) AS INTEGER) AS l_returnflag_N,
       CAST(coalesce(l_returnflag = 'R', false) AS INTEGER) AS l_returnflag_R FROM gappy""")
def one_hot_encode(spark, sf):
    return R.one_hot_encode(_lines(spark, sf, "l_returnflag"), ["l_returnflag"], drop_original=False)


@query("one_hot_config", """
SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS "priority_1-URGENT",
       CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS "priority_2-HIGH",
       CAST(o_orderpriority = '3-MEDIUM' AS INTEGER) AS "priority_3-MEDIUM",
       CAST(o_orderpriority = '4-NOT SPECIFIED' AS INTEGER) AS "priority_4-NOT SPECIFIED",
       CAST(o_orderpriority = '5-LOW' AS INTEGER) AS "priority_5-LOW" FROM orders""")
def one_hot_config(spark, sf):
    return K.clean(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"),
                   {"o_orderpriority": K.CleanSetting(new_name="priority", ml_preprocessing=True, one_hot_encode=True)})
