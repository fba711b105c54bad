"""Registered time-series queries (TS). ACF and the significance count have
SQL twins; the fitted tests and forecasts are checked by rows and pytest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as T
from ..operators import relational as R
from ..operators import ml as M
from .registry import register
from .relational_queries import monthly_totals

ACF_SQL = """(
with m as (select o_orderpriority, date_trunc('month', o_orderdate) as month, sum(o_totalprice) as total
           from orders group by 1, 2),
x as (select o_orderpriority, row_number() over (partition by o_orderpriority order by month) as i, total as y from m),
st as (select o_orderpriority, avg(y) as mu, count(*) as n from x group by 1),
d as (select x.o_orderpriority, i, y - mu as e, n from x join st using (o_orderpriority)),
l as (select o_orderpriority, i, e, unnest(generate_series(0, greatest(5, least(40, cast(floor(n / 2) as bigint) - 1))))
      as lag from d),
p as (select l.o_orderpriority, l.lag, l.e * d2.e as p from l left join d d2
      on d2.o_orderpriority = l.o_orderpriority and d2.i = l.i - l.lag),
num as (select o_orderpriority, lag, coalesce(sum(p), 0) as num from p group by 1, 2),
den as (select o_orderpriority, sum(e * e) as den, first(n) as n_obs from d group by 1)
select o_orderpriority, lag, num / den as acf, n_obs from num join den using (o_orderpriority))"""


@register("ts_01", f"select o_orderpriority, lag, round(acf, 6) as acf, n_obs from {ACF_SQL}")
def q_ts_01(spark, d):
    a = T.acf(monthly_totals(spark, d), "o_orderpriority", "month", "total")
    return a.select("o_orderpriority", F.col("lag").cast("long").alias("lag"), F.round("acf", 6).alias("acf"),
                    "n_obs")


@register("ts_03", f"""
with a as {ACF_SQL}, g as (select o_orderpriority, max(lag) as n_lags, first(n_obs) as n_obs from a group by 1)
select o_orderpriority, round(1.96 / sqrt(g.n_obs), 6) as band, g.n_lags,
  count(*) filter (where a.lag > 0 and abs(a.acf) > 1.96 / sqrt(g.n_obs)) as significant_lags
from a join g using (o_orderpriority) group by o_orderpriority, g.n_obs, g.n_lags""")
def q_ts_03(spark, d):
    a = T.acf(monthly_totals(spark, d), "o_orderpriority", "month", "total")
    s = T.significant_lags(a, "o_orderpriority")
    return s.select("o_orderpriority", F.round("band", 6).alias("band"), F.col("n_lags").cast("long").alias("n_lags"),
                    "significant_lags")


@register("ts_02")
def q_ts_02(spark, d):
    return T.pacf(monthly_totals(spark, d), "o_orderpriority", "month", "total")


@register("ts_04")
def q_ts_04(spark, d):
    """ADF, KPSS and the 2x2 verdict (TS-04..06) per priority series."""
    return T.diagnostics(monthly_totals(spark, d), "o_orderpriority", "month", "total")


@register("ts_07")
def q_ts_07(spark, d):
    """ARIMA(1,1,1) and Holt fits with AIC/BIC and 6-step forecasts
    (TS-07, TS-08, TS-11)."""
    return T.forecast(monthly_totals(spark, d), "o_orderpriority", "month", "total", h=6)


@register("ts_09")
def q_ts_09(spark, d):
    """VAR on two measures (total value, order count) per priority."""
    m = monthly_totals(spark, d).withColumn("n_orders", F.col("n_orders").cast("double"))
    return T.var_forecast(m, "o_orderpriority", "month", ["total", "n_orders"], h=6)


@register("ts_10")
def q_ts_10(spark, d):
    """Forecast candidates on lag and rolling-mean features (WN-01/02),
    chronological 80/20 split per the whole table, Spark ML regressors."""
    m = monthly_totals(spark, d)
    f = R.lag_features(m, "o_orderpriority", "month", ["total"], lags=(1, 3), backfill=False)
    # means of earlier months only: the current total is the target
    f = R.rolling_mean(f, "o_orderpriority", "month", ["total_lag1"], sizes=(3, 6))
    f = f.withColumnsRenamed({"total_lag1_roll3": "total_roll3", "total_lag1_roll6": "total_roll6"})
    f = f.na.drop(subset=["total_lag1", "total_lag3"]).withColumn(
        "row_key", F.concat_ws("|", "o_orderpriority", F.col("month").cast("string")))
    f = M.assemble(f, ["total_lag1", "total_lag3", "total_roll3", "total_roll6"])
    s = M.chronological_split(f, "month", "n_orders")
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    cands = [("ridge", LinearRegression(labelCol="total", regParam=1.0)),
             ("random_forest", RandomForestRegressor(labelCol="total", numTrees=20, seed=42)),
             ("gradient_boosting", GBTRegressor(labelCol="total", maxIter=20, seed=42))]
    p = M.fit_candidates(s.where("split = 'train'"), s.where("split = 'test'"), cands, "total", "row_key")
    return M.regression_metrics(p)


@register("ts_05")
def q_ts_05(spark, d):
    """KPSS level test per series (TS-05)."""
    return q_ts_04(spark, d).select("series", "kpss_stat", "kpss_pvalue", "kpss_lags", "kpss_stationary")


@register("ts_06")
def q_ts_06(spark, d):
    """2x2 stationarity verdict per series (TS-06)."""
    return q_ts_04(spark, d).select("series", "adf_stationary", "kpss_stationary", "verdict")


@register("ts_08")
def q_ts_08(spark, d):
    """Holt additive-trend smoothing, fitted parameters and forecasts."""
    return T.forecast(monthly_totals(spark, d), "o_orderpriority", "month", "total", h=6, models=("holt",))


@register("ts_11")
def q_ts_11(spark, d):
    """Information criteria per fitted series and model (TS-11)."""
    f = T.forecast(monthly_totals(spark, d), "o_orderpriority", "month", "total", h=1)
    return f.select("series", "model", "aic", "bic", "params")
