"""Registered model-selection and metric queries (ML). Metric operators run
on a naive-forecast prediction table that SQL can reproduce; model fits
(Spark ML) register without SQL and are checked by rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ml as M
from ..operators.density import density_clusters
from ..operators.segments import silhouette_summary, silhouettes
from ..sources.tables import table
from .registry import register
from .relational_queries import monthly_totals
from .scale import cut_lineage

CUT = "1998-05-01"


def preds(spark, d):
    """(target, model, row_key, ts, actual, predicted): naive (lag 1) and
    seasonal naive (lag 12) forecasts of monthly order totals per priority."""
    m = monthly_totals(spark, d)
    w = Window.partitionBy("o_orderpriority").orderBy("month")
    base = m.select(F.lit("monthly_total").alias("target"), "o_orderpriority",
                    F.col("month").alias("ts"), F.col("total").alias("actual"),
                    F.lag("total").over(w).alias("naive"),
                    F.lag("total", 12).over(w).alias("seasonal_naive"))
    st = F.expr("stack(2, 'naive', naive, 'seasonal_naive', seasonal_naive)").alias("model", "predicted")
    return (base.select("target", st, F.concat_ws("|", "o_orderpriority", F.col("ts").cast("string"))
                        .alias("row_key"), "ts", "actual")
            .where(F.col("predicted").isNotNull()))


PREDS_SQL = """(with m as (select o_orderpriority, date_trunc('month', o_orderdate) as month,
    sum(o_totalprice) as total from orders group by 1, 2),
b as (select 'monthly_total' as target, o_orderpriority, month as ts, total as actual,
    lag(total) over (partition by o_orderpriority order by month) as naive,
    lag(total, 12) over (partition by o_orderpriority order by month) as seasonal_naive from m)
select target, 'naive' as model, o_orderpriority || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') as row_key, ts, actual,
  naive as predicted from b where naive is not null
union all
select target, 'seasonal_naive', o_orderpriority || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S'), ts, actual, seasonal_naive
  from b where seasonal_naive is not null)"""


def _metrics_sql(src):
    return f"""(select target, model, count(*) as n, sqrt(avg((actual - predicted) ^ 2)) as rmse,
  avg(abs(actual - predicted)) as mae,
  coalesce(avg(abs((actual - predicted) / actual)) filter (where actual <> 0) * 100, 0) as mape,
  case when var_pop(actual) > 0 then 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*))
    else case when sum((actual - predicted) ^ 2) = 0 then 1.0 else 0.0 end end as r2
  from {src} group by 1, 2)"""


METRICS_SQL = _metrics_sql(PREDS_SQL)


def _r(df, cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def metrics(spark, d):
    return M.regression_metrics(preds(spark, d))


@register("ml_14", f"""select target, model, n, round(rmse, 6) as rmse, round(mae, 6) as mae,
  round(mape, 6) as mape, round(r2, 6) as r2,
  case when mape > 200 then 'extreme' when mape > 100 then 'high' else 'normal' end as mape_flag,
  r2 < 0 as r2_warning from {METRICS_SQL}""")
def q_ml_14(spark, d):
    return _r(metrics(spark, d), ["rmse", "mae", "mape", "r2"])


@register("ml_17", f"""select target, model, round(0.35 / (1 + rmse) + 0.25 / (1 + mape / 100)
  + 0.25 * greatest(0.0, r2) + 0.15 / (1 + 0.0), 6) as composite from {METRICS_SQL}""")
def q_ml_17(spark, d):
    return M.composite_score(metrics(spark, d)).select("target", "model", "composite")


@register("ml_19", f"""
with c as (select *, 0.35 / (1 + rmse) + 0.25 / (1 + mape / 100) + 0.25 * greatest(0.0, r2) + 0.15 as composite
           from {METRICS_SQL}),
l as (select target, model, 'rmse' as metric, rmse as value, false as hib from c
  union all select target, model, 'mae', mae, false from c
  union all select target, model, 'mape', mape, false from c
  union all select target, model, 'r2', r2, true from c
  union all select target, model, 'composite', round(composite, 6), true from c)
select target, model, metric, round(value, 6) as value,
  row_number() over (partition by target, metric order by case when hib then -value else value end, model) as rank,
  first_value(model) over (partition by target, metric order by case when hib then -value else value end, model
    rows between unbounded preceding and unbounded following) as best_model,
  round(max(value) over (partition by target, metric) - min(value) over (partition by target, metric), 6) as spread
from l""")
def q_ml_19(spark, d):
    lb = M.leaderboards(M.composite_score(metrics(spark, d)))
    return _r(lb.select("target", "model", "metric", "value", F.col("rank").cast("long").alias("rank"),
                        "best_model", "spread"), ["value", "spread"])


@register("ml_20", f"""
with b as {_metrics_sql(f"(select * from {PREDS_SQL} where ts < timestamp '{CUT}')")},
n as {_metrics_sql(f"(select * from {PREDS_SQL} where ts >= timestamp '{CUT}')")},
lb as (select target, model, 'rmse' as metric, rmse as base from b union all select target, model, 'mae', mae from b
  union all select target, model, 'mape', mape from b union all select target, model, 'r2', r2 from b),
ln as (select target, model, 'rmse' as metric, rmse as new from n union all select target, model, 'mae', mae from n
  union all select target, model, 'mape', mape from n union all select target, model, 'r2', r2 from n)
select target, model, metric, round(base, 6) as base, round(new, 6) as new,
  round(case when abs(base) <= 1e-6 then 0 else abs(new - base) / abs(base) * 100 end, 6) as drift_pct,
  case when abs(base) <= 1e-6 then 0 else abs(new - base) / abs(base) * 100 end > 5 as drifted
from lb join ln using (target, model, metric)""")
def q_ml_20(spark, d):
    p = preds(spark, d)
    cut = F.lit(CUT).cast("timestamp_ntz")
    dr = M.metric_drift(M.regression_metrics(p.where(F.col("ts") < cut)),
                        M.regression_metrics(p.where(F.col("ts") >= cut)))
    return _r(dr, ["base", "new", "drift_pct"])


@register("ml_21", f"""select target, model, row_key, round(actual - predicted, 3) as residual,
  round(predicted, 3) as predicted from {PREDS_SQL}""")
def q_ml_21(spark, d):
    r = M.residuals(preds(spark, d))
    return r.select("target", "model", "row_key", F.round("residual", 3).alias("residual"),
                    F.round("predicted", 3).alias("predicted"))


@register("ml_25", f"""select target, model, round(avg(predicted), 6) as mean_pred, round(avg(actual), 6) as mean_actual,
  round(stddev_samp(actual), 6) as sd_actual,
  abs(avg(predicted) - avg(actual)) > 3 * stddev_samp(actual) as scale_mismatch
from {PREDS_SQL} group by 1, 2""")
def q_ml_25(spark, d):
    return _r(M.scale_check(preds(spark, d)), ["mean_pred", "mean_actual", "sd_actual"])


@register("ml_28", f"""select target, model,
  case when r2 > 0.8 then 'High' when r2 > 0.5 then 'Moderate' else 'Low' end as confidence,
  case when mape < 10 then 'High' when mape < 20 then 'Moderate' else 'Low' end as reliability
from {METRICS_SQL}""")
def q_ml_28(spark, d):
    return M.insights(metrics(spark, d)).select("target", "model", "confidence", "reliability")


@register("ml_26", f"""
select target, model, 'mape_over_200' as finding, 'major' as severity from {METRICS_SQL} where mape > 200
union all select target, model, 'negative_r2', 'major' from {METRICS_SQL} where r2 < 0
union all select target, model, 'nan_metric', 'error' from {METRICS_SQL} where isnan(rmse) or rmse is null
union all select target, null, 'few_models', 'minor' from {METRICS_SQL} group by target having count(distinct model) < 3""")
def q_ml_26(spark, d):
    return M.self_check(metrics(spark, d))


@register("ml_29", f"""
select target, model, ts, actual, round(predicted, 3) as predicted,
  min(ts) over (partition by target, model) as range_start, max(ts) over (partition by target, model) as range_end
from {PREDS_SQL}""")
def q_ml_29(spark, d):
    p = preds(spark, d)
    w = Window.partitionBy("target", "model")
    return p.select("target", "model", "ts", "actual", F.round("predicted", 3).alias("predicted"),
                    F.min("ts").over(w).alias("range_start"), F.max("ts").over(w).alias("range_end"))


@register("ml_18", f"""
with st as (select 'monthly_total' as target, min(total) as t_min, max(total) as t_max, stddev_samp(total) as t_sd
  from (select date_trunc('month', o_orderdate) as month, o_orderpriority, sum(o_totalprice) as total
        from orders group by 1, 2) where month < timestamp '{CUT}'),
x as (select p.*, row_number() over (partition by p.target, p.model order by p.ts, p.row_key) as rn
  from {PREDS_SQL} p join st using (target)
  where p.predicted < st.t_min - 2 * st.t_sd or p.predicted > st.t_max + 2 * st.t_sd)
select target, model, row_key, ts, actual, round(predicted, 6) as predicted from x where rn <= 20""")
def q_ml_18(spark, d):
    m = monthly_totals(spark, d).where(F.col("month") < F.lit(CUT).cast("timestamp_ntz"))
    st = m.agg(F.min("total").alias("t_min"), F.max("total").alias("t_max"),
               F.stddev_samp("total").alias("t_sd")).withColumn("target", F.lit("monthly_total"))
    a = M.prediction_anomalies(preds(spark, d), st)
    return a.select("target", "model", "row_key", "ts", "actual", F.round("predicted", 6).alias("predicted"))


# ------------------------------------------------------------ classification

def doc_preds(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    j = docs.join(lab, "doc_id")
    return j.select(F.lit("length_rule").alias("model"), F.col("quality").alias("actual"),
                    F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("predicted"),
                    F.col("n_chars").cast("double").alias("score"))


DOC_PREDS_SQL = """(select 'length_rule' as model, l.quality as actual,
  case when d.n_chars >= 1000 then 1 else 0 end as predicted, cast(d.n_chars as double) as score
  from documents d join labels l using (doc_id))"""


@register("ml_15", f"""
with p as {DOC_PREDS_SQL},
cls as (select c as cls from (select actual as c from p union select predicted from p)),
pc as (select cls, count(*) filter (where actual = cls) as support, count(*) filter (where predicted = cls) as pred_n,
  count(*) filter (where actual = cls and predicted = cls) as tp from p, cls group by cls),
m as (select sum(tp) / sum(support) as accuracy,
  sum(case when pred_n = 0 then 0 else tp / pred_n end * support) / sum(support) as precision,
  sum(case when support = 0 then 0 else tp / support end * support) / sum(support) as recall,
  sum(case when pred_n = 0 or support = 0 or tp = 0 then 0 else
    2 * (tp / pred_n) * (tp / support) / ((tp / pred_n) + (tp / support)) end * support) / sum(support) as f1 from pc),
r as (select actual, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from p),
a as (select (sum(rk) filter (where actual = 1) - count(*) filter (where actual = 1) * (count(*) filter (where actual = 1) + 1) / 2.0)
  / (count(*) filter (where actual = 1) * count(*) filter (where actual <> 1)) as auc_roc from r)
select 'length_rule' as model, round(accuracy, 6) as accuracy, round(precision, 6) as precision,
  round(recall, 6) as recall, round(f1, 6) as f1, round(auc_roc, 6) as auc_roc from m, a""")
def q_ml_15(spark, d):
    p = doc_preds(spark, d)
    c = M.classification_metrics(p)
    a = M.binary_auc(p, model="model")
    return _r(c.join(a, "model"), ["accuracy", "precision", "recall", "f1", "auc_roc"])


# Two scorers of a text's language: small words and letters, per 1,000 characters.
LANG_MARKS = {"en": (" the ", "w"), "de": (" der ", "ß"), "fr": (" le ", "ê"), "es": (" el ", "ñ")}
LANG_SQL = "select doc_id, lang, m, cls, score from (" + " union all ".join(
    f"""select doc_id, lang, '{model}' as m, '{cls}' as cls,
  round((length(text) - length(replace(text, '{marks[i]}', ''))) * 1000.0 / greatest(length(text), 1), 6) as score from documents"""
    for cls, marks in LANG_MARKS.items() for i, model in enumerate(("words", "letters"))) + ")"


@register("ml_15_multiclass", f"""
with s as ({LANG_SQL}),
d as (select m as model, doc_id, lang as actual, first(cls order by score desc, cls) as predicted from s group by all),
cls as (select c from (select actual as c from d union select predicted from d)),
pc as (select model, c, count(*) filter (where actual = c) as support, count(*) filter (where predicted = c) as pred_n,
  count(*) filter (where actual = c and predicted = c) as tp from d, cls group by model, c),
f as (select model, sum(tp) / sum(support) as accuracy,
  sum(case when pred_n = 0 or support = 0 or tp = 0 then 0 else
    2 * (tp / pred_n) * (tp / support) / ((tp / pred_n) + (tp / support)) end * support) / sum(support) as f1 from pc group by model),
r as (select m, cls, lang, rank() over (partition by m, cls order by score)
  + (count(*) over (partition by m, cls, score) - 1) / 2.0 as rk from s),
a as (select m, cls, count(*) filter (where lang = cls) as p, count(*) filter (where lang <> cls) as n,
  sum(rk) filter (where lang = cls) as rs from r group by m, cls),
w as (select m as model, sum((rs - p * (p + 1) / 2.0) / (p * n) * p) / sum(p) as auc_roc from a group by m)
select model, round(accuracy, 6) as accuracy, round(f1, 6) as f1, round(auc_roc, 6) as auc_roc from f join w using (model)""")
def q_ml_15_multiclass(spark, d):
    """Weighted one-versus-rest AUC of two language scorers, all models and
    classes ranked in one pass."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    size = F.greatest(F.char_length("text"), F.lit(1))

    def score(mark):
        held = F.char_length("text") - F.char_length(F.replace("text", F.lit(mark), F.lit("")))
        return F.round(held * 1000.0 / size, 6)
    models = F.array(*[F.struct(F.lit(name).alias("model"), F.create_map(*[
        x for cls, marks in LANG_MARKS.items() for x in (F.lit(cls), score(marks[i]))]).alias("scores"))
        for i, name in enumerate(("words", "letters"))])
    p = docs.select("doc_id", F.col("lang").alias("actual"), F.explode(models).alias("m")).select("doc_id", "actual", "m.*")
    best = F.array_sort(F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    p = p.withColumn("predicted", best[0]["k"])
    out = M.classification_metrics(p).select("model", "accuracy", "f1").join(M.multiclass_auc(p), "model")
    return _r(out, ["accuracy", "f1", "auc_roc"])


@register("ml_22", f"""
with p as {DOC_PREDS_SQL},
v as (select score as thr, count(*) filter (where actual = 1) as pos, count(*) filter (where actual <> 1) as neg
      from p group by 1),
c as (select thr, sum(pos) over (order by thr desc) as tp, sum(neg) over (order by thr desc) as fp from v),
t as (select count(*) filter (where actual = 1) as P, count(*) filter (where actual <> 1) as N from p)
select thr, round(tp / P, 6) as tpr, round(fp / N, 6) as fpr,
  round(case when tp + fp = 0 then 1.0 else tp / (tp + fp) end, 6) as precision from c, t""")
def q_ml_22(spark, d):
    r = M.roc_points(doc_preds(spark, d))
    return _r(r, ["tpr", "fpr", "precision"])


# ------------------------------------------------------------ features and splits

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("ml_02", " union all ".join(
    f"""select '{c}' as column_name, round(var_pop(coalesce({c}, (select median({c}) from lineitem))), 6) as variance,
  var_pop(coalesce({c}, (select median({c}) from lineitem))) > 0.01 as kept,
  case when var_pop(coalesce({c}, (select median({c}) from lineitem))) > 0.01 then null
    else 'variance <= 0.01' end as reason from lineitem""" for c in LI_NUM))
def q_ml_02(spark, d):
    return _r(M.variance_filter(table(spark, d, "lineitem"), LI_NUM), ["variance"])


ML03_COLS = LI_NUM + ["l_price_x2"]


@register("ml_03", f"""
with t as (select *, l_extendedprice * 2 as l_price_x2 from lineitem),
cols as (select * from (values {", ".join(f"('{c}', {i})" for i, c in enumerate(ML03_COLS))}) v(name, pos)),
pairs as ({" union all ".join(f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as r from t"
                              for i, a in enumerate(ML03_COLS) for b in ML03_COLS[i + 1:])}),
hit as (select p.col_b as column_name, arg_min(p.col_a, ca.pos) as correlated_with
        from pairs p join cols ca on ca.name = p.col_a where abs(p.r) > 0.95 group by 1)
select c.name as column_name, h.correlated_with, h.correlated_with is null as kept,
  case when h.correlated_with is not null then '|r| > 0.95 with ' || h.correlated_with end as reason
from cols c left join hit h on h.column_name = c.name""")
def q_ml_03(spark, d):
    li = table(spark, d, "lineitem").withColumn("l_price_x2", F.col("l_extendedprice") * 2)
    return M.correlation_filter(li, ML03_COLS).select("column_name", "correlated_with", "kept", "reason")


@register("ml_04", """
with e as (select quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from orders),
b as (select len(list_filter(list_distinct(e.q), lambda x: x < o_totalprice)) as x, o_orderstatus as y
      from orders, e where o_totalprice is not null and o_orderstatus is not null),
j as (select x, y, count(*) as c from b group by 1, 2),
p as (select c / sum(c) over () as pxy, sum(c) over (partition by x) / sum(c) over () as px,
  sum(c) over (partition by y) / sum(c) over () as py from j)
select 'o_totalprice' as column_name, round(sum(pxy * ln(pxy / (px * py))), 6) as mutual_info from p""")
def q_ml_04(spark, d):
    return _r(M.mutual_info(table(spark, d, "orders"), ["o_totalprice"], "o_orderstatus"), ["mutual_info"])


@register("ml_05")
def q_ml_05(spark, d):
    li = table(spark, d, "lineitem").withColumn("l_price_x2", F.col("l_extendedprice") * 2)
    return M.select_features(li, ML03_COLS, "l_returnflag")


@register("ml_06", """
select o_orderkey, case when row_number() over (order by o_orderdate, o_orderkey)
  <= cast(floor(count(*) over () * 0.8) as bigint) then 'train' else 'test' end as split from orders""")
def q_ml_06(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return M.chronological_split(o, "o_orderdate", "o_orderkey").select("o_orderkey", "split")


@register("ml_07", """
with s as (select o_orderkey, o_orderdate, round(o_totalprice, 4) as o_totalprice,
  case when row_number() over (order by o_orderdate, o_orderkey) <= cast(floor(count(*) over () * 0.8) as bigint)
    then 'train' else 'test' end as split from orders)
select * from (select * from s where split = 'train' order by o_orderdate, o_orderkey limit 10)
union all select * from (select * from s where split = 'test' order by o_orderdate, o_orderkey limit 5)""")
def q_ml_07(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    s = M.chronological_split(o, "o_orderdate", "o_orderkey")
    return M.split_preview(s, ["o_orderdate", "o_orderkey"])


@register("ml_01", """
with s as (select *, case when row_number() over (order by o_orderdate, o_orderkey)
  <= cast(floor(count(*) over () * 0.8) as bigint) then 'train' else 'test' end as split from orders),
tr as (select * from s where split = 'train'),
med as (select median(o_totalprice) as m from tr),
st as (select avg(coalesce(o_totalprice, med.m)) as mu, stddev_pop(coalesce(o_totalprice, med.m)) as sd
       from tr, med group by med.m)
select o_orderkey, round((coalesce(o_totalprice, med.m) - st.mu) / st.sd, 6) as o_totalprice,
  case when o_orderpriority = '1-URGENT' then 1.0 else 0.0 end::double as "o_orderpriority_1-URGENT",
  case when o_orderpriority = '2-HIGH' then 1.0 else 0.0 end::double as "o_orderpriority_2-HIGH",
  case when o_orderpriority = '3-MEDIUM' then 1.0 else 0.0 end::double as "o_orderpriority_3-MEDIUM",
  case when o_orderpriority = '4-NOT SPECIFIED' then 1.0 else 0.0 end::double as "o_orderpriority_4-NOT SPECIFIED",
  case when o_orderpriority = '5-LOW' then 1.0 else 0.0 end::double as "o_orderpriority_5-LOW"
from s, med, st where split = 'test'""")
def q_ml_01(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    s = M.chronological_split(o, "o_orderdate", "o_orderkey")
    tr = s.where(F.col("split") == "train")
    te = s.where(F.col("split") == "test").drop("split", "o_orderdate")
    out = M.preprocess(tr, te, ["o_totalprice"], ["o_orderpriority"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@register("ml_01_sparse", """
with s as (select *, row_number() over (order by o_orderdate, o_orderkey)
  <= cast(floor(count(*) over () * 0.8) as bigint) as train from orders),
tr as (select * from s where train),
med as (select median(o_totalprice) as m from tr),
st as (select avg(coalesce(o_totalprice, med.m)) as mu, stddev_pop(coalesce(o_totalprice, med.m)) as sd from tr, med group by med.m),
lv as (select 0 as c, o_custkey::varchar as v from tr union select 1, o_orderpriority from tr),
ix as (select c, v, row_number() over (partition by c order by v) - 1 as i, count(*) over (partition by c) as n from lv),
n0 as (select count(*) as n from ix where c = 0)
select o_orderkey, (select 1 + count(*) from ix) as size,
  array_to_string(list_sort(list_concat([0], list_concat(coalesce((select [1 + i] from ix where c = 0 and v = o_custkey::varchar), []),
    coalesce((select [1 + n0.n + i] from ix, n0 where c = 1 and v = o_orderpriority), [])))), ',') as indices,
  round((coalesce(o_totalprice, med.m) - st.mu) / st.sd, 6) as o_totalprice
from s, med, st where not train""")
def q_ml_01_sparse(spark, d):
    """The customer of an order as a category of any number of levels."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_custkey")
    s = M.chronological_split(o, "o_orderdate", "o_orderkey")
    out = M.preprocess_sparse(s.where("split = 'train'"), s.where("split = 'test'"), "o_orderkey", ["o_totalprice"],
                              ["o_custkey", "o_orderpriority"])
    return out.select("o_orderkey", "size", F.array_join("indices", ",").alias("indices"),
                      F.round(F.col("values")[0], 6).alias("o_totalprice"))


@register("ml_06_stratified", """
with r as (select doc_id, toxic, row_number() over (partition by toxic order by md5(doc_id || ':42')) as rn,
  count(*) over (partition by toxic) as n from labels)
select doc_id, toxic, case when rn <= greatest(1, least(floor(n * 0.8 + 0.5), greatest(n - 1, 1))) then 'train' else 'test' end as split
from r""")
def q_ml_06_stratified(spark, d):
    """A split that holds the share of every label."""
    return M.stratified_split(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


# ------------------------------------------------------------ clusters

@register("ml_16", """
with l as (select vec_id, label as cluster, unnest(embedding) as v, unnest(generate_series(1, len(embedding))) as pos
           from embeddings),
c as (select cluster, pos, avg(v) as c from l group by 1, 2),
g as (select pos, avg(v) as g from l group by 1),
dist as (select l.cluster, l.vec_id, sum((l.v - c.c) ^ 2) as d2 from l join c using (cluster, pos) group by 1, 2),
disp as (select cluster, avg(sqrt(d2)) as s, sum(d2) as w, count(*) as n from dist group by 1),
bt as (select c.cluster, sum((c.c - g.g) ^ 2) as b2 from c join g using (pos) group by 1),
cd as (select a.cluster as ca, b.cluster as cb, sqrt(sum((a.c - b.c) ^ 2)) as dab
       from c a join c b on a.pos = b.pos and a.cluster <> b.cluster group by 1, 2),
db as (select avg(r) as davies_bouldin from (select cd.ca, max((sa.s + sb.s) / cd.dab) as r from cd
       join disp sa on sa.cluster = cd.ca join disp sb on sb.cluster = cd.cb group by 1)),
ch as (select sum(disp.n * bt.b2) as B, sum(w) as W, sum(n) as N, count(*) as K from disp join bt using (cluster))
select round(case when K < 2 then 9999 else davies_bouldin end, 6) as davies_bouldin,
  round(case when K < 2 then 0 else (B / (K - 1)) / (W / (N - K)) end, 6) as calinski_harabasz, K as clusters
from ch, db""")
def q_ml_16(spark, d):
    s = M.segment_metrics(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return _r(s, ["davies_bouldin", "calinski_harabasz"]).withColumn("clusters", F.col("clusters").cast("long"))


# Squared distances of all pairs, averaged by cluster: what the closed form stands for.
SILHOUETTE_SQL = """d as (select a.vec_id, a.label, b.label as other, count(*) as n, sum(list_distance(
    a.embedding::double[], b.embedding::double[]) ** 2) as s
  from embeddings a join embeddings b on true group by 1, 2, 3),
o as (select vec_id, label, s / (n - 1) as a, n from d where other = label),
t as (select vec_id, min(s / n) as b from d where other <> label group by 1),
sil as (select vec_id, label, case when n = 1 or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end as silhouette
  from o join t using (vec_id))"""


@register("ml_23_silhouette", f"with {SILHOUETTE_SQL} select vec_id, label, round(silhouette, 6) as silhouette from sil")
def q_ml_23_silhouette(spark, d):
    """Silhouette of every vector, squared Euclidean, without pairs."""
    s = silhouettes(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return _r(s, ["silhouette"])


@register("ml_16_silhouette", f"""with {SILHOUETTE_SQL}
select label, count(*) as size, round(avg(silhouette), 6) as silhouette,
  round(avg(case when silhouette < 0 then 1.0 else 0.0 end), 6) as misplaced from sil group by label""")
def q_ml_16_silhouette(spark, d):
    """Silhouette by cluster."""
    s = silhouettes(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return _r(silhouette_summary(s, "label"), ["silhouette", "misplaced"])


@register("ml_23", """
select label, count(*) as size, round(avg(embedding[1]), 6) as mean_e0, round(avg(embedding[2]), 6) as mean_e1,
  round(count(*) / (select count(*) from embeddings), 6) as share
from embeddings group by 1""")
def q_ml_23(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("e0"),
                                             F.col("embedding")[1].cast("double").alias("e1"))
    p = M.cluster_profile(e, "label", ["e0", "e1"])
    return _r(p.withColumnRenamed("mean_e0", "mean_e0"), ["mean_e0", "mean_e1", "share"])


# ------------------------------------------------------------ model fits (rows-only checks)

def _li_split(spark, d):
    li = table(spark, d, "lineitem").withColumn("row_key", F.concat_ws("|", "l_orderkey", "l_linenumber",
                                                                       "l_partkey"))
    li = M.assemble(li, ["l_quantity", "l_discount", "l_tax"])
    s = M.hash_split(li, "row_key")
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


@register("ml_08")
def q_ml_08(spark, d):
    tr, te = _li_split(spark, d)
    cands = [c for c in M.regression_candidates("l_extendedprice")
             if c[0] in ("linear", "ridge_1.0", "random_forest", "gradient_boosting")]
    p = M.fit_candidates(tr, te, cands, "l_extendedprice", "row_key")
    return M.regression_metrics(p)


def _doc_features(spark, d):
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    f = docs.join(lab, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("quality"), F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        (F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / F.greatest(F.length("text"), F.lit(1)))
        .alias("alpha_share"))
    return M.assemble(f, ["n_chars", "n_lines", "alpha_share"])


@register("ml_09")
def q_ml_09(spark, d):
    f = cut_lineage(_doc_features(spark, d).select("doc_id", "quality", "features"))    # every fit reads them many times, the texts once
    s = M.hash_split(f, "doc_id")
    p = M.fit_candidates(s.where("split = 'train'"), s.where("split = 'test'"),
                         M.classification_candidates("quality"), "quality", "doc_id")
    return M.classification_metrics(p.withColumn("actual", F.col("actual").cast("int"))
                                    .withColumn("predicted", F.col("predicted").cast("int")))


@register("ml_10")
def q_ml_10(spark, d):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    e = table(spark, d, "embeddings").withColumn("features", array_to_vector("embedding"))
    rows = []
    for name, est in M.segmentation_candidates():
        pred = est.fit(e).transform(e)
        sil = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(pred)
        rows.append(pred.agg(F.countDistinct("prediction").alias("clusters"))
                    .select(F.lit(name).alias("model"), F.lit(sil).alias("silhouette_sq_euclidean"), "clusters"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@register("ml_12")
def q_ml_12(spark, d):
    """5-fold cross-validation of the linear candidate: per-fold RMSE with
    the mean and population sd of the folds."""
    import statistics
    from pyspark.ml.regression import LinearRegression
    tr, _te = _li_split(spark, d)
    scores = M.cv_fold_scores(tr, LinearRegression(labelCol="l_extendedprice"), "l_extendedprice", "row_key", k=5)
    mean, sd = statistics.fmean(scores), statistics.pstdev(scores)
    return spark.createDataFrame([("linear", i, s, mean, sd) for i, s in enumerate(scores)],
                                 "model string, fold int, rmse double, cv_mean double, cv_std double")


@register("ml_24")
def q_ml_24(spark, d):
    from pyspark.ml.regression import RandomForestRegressor
    tr, _te = _li_split(spark, d)
    m = RandomForestRegressor(labelCol="l_extendedprice", numTrees=20, seed=42).fit(tr)
    return spark.createDataFrame(M.model_summary(m, ["l_quantity", "l_discount", "l_tax"]),
                                 "feature string, weight double")


@register("ml_27")
def q_ml_27(spark, d):
    """Every numeric non-key column of lineitem is a target; linear and
    forest candidates on the remaining numerics; best model per target."""
    li = table(spark, d, "lineitem").withColumn("row_key", F.concat_ws("|", "l_orderkey", "l_linenumber",
                                                                       "l_partkey"))
    s = M.hash_split(li, "row_key")
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor
    allp = []
    for t in LI_NUM:
        feats = [c for c in LI_NUM if c != t]
        a = M.assemble(s, feats)
        cands = [("linear", LinearRegression(labelCol=t)),
                 ("random_forest", RandomForestRegressor(labelCol=t, numTrees=10, seed=42))]
        allp.append(M.fit_candidates(a.where("split = 'train'"), a.where("split = 'test'"), cands, t,
                                     "row_key", target=t))
    p = allp[0]
    for x in allp[1:]:
        p = p.unionByName(x)
    m = M.regression_metrics(p)
    w = Window.partitionBy("target").orderBy(F.desc("r2"), "model")
    return m.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("target", "model", "r2", "rmse")


@register("wn_06", f"""select target, model, round(r2, 6) as r2,
  row_number() over (partition by target order by r2 desc, model) as rank from {METRICS_SQL}""")
def q_wn_06(spark, d):
    from ..operators import relational as R
    m = metrics(spark, d).select("target", "model", F.round("r2", 6).alias("r2"))
    return R.rank_models(m, "r2", by=["target"]).withColumn("rank", F.col("rank").cast("long"))


@register("ml_13")
def q_ml_13(spark, d):
    """Grid search of the winning family (5 folds): best parameters by
    fold-mean RMSE (ML-13); fold scores of every grid point come from
    ``cv_scores``."""
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import ParamGridBuilder
    tr, _te = _li_split(spark, d)
    rf = RandomForestRegressor(labelCol="l_extendedprice", seed=42)
    grid = ParamGridBuilder().addGrid(rf.numTrees, [10, 20]).addGrid(rf.maxDepth, [3, 5]).build()
    _model, avg = M.cv_scores(tr, rf, "l_extendedprice", "row_key", k=5, grid=grid)
    rows = [(int(g[rf.numTrees]), int(g[rf.maxDepth]), float(a)) for g, a in zip(grid, avg)]
    best = min(rows, key=lambda r: (r[2], r[0], r[1]))
    return spark.createDataFrame([r + (r == best,) for r in rows],
                                 "num_trees int, max_depth int, cv_rmse double, best boolean")


@register("ml_11", """
with recursive p as (select c_custkey as id, c_acctbal / 1000 as x, cast(c_nationkey as double) as y from customer),
nb as (select a.id as a, b.id as b from p a join p b
  on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25),
core as (select a as id from nb group by a having count(*) >= 5),
e as (select a, b from nb where a in (select id from core) and b in (select id from core)),
reach as (select id, id as r from core union select reach.id, e.b from reach join e on e.a = reach.r),
lab as (select id, min(r) as label from reach group by id),
border as (select nb.a as id, min(label) as label from nb join lab on lab.id = nb.b
  where nb.a not in (select id from core) group by nb.a),
every as (select id, label from lab union all select id, label from border)
select coalesce(label, -1) as cluster, count(*) as size from p left join every using (id) group by 1""")
def q_ml_11(spark, d):
    """Density clusters of customers in (balance / 1000, nation) space,
    eps 0.5, min 5 points; cluster sizes."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"),
                                           F.col("c_nationkey").cast("double").alias("y"))
    lab = density_clusters(c, "c_custkey", ["x", "y"], eps=0.5, min_pts=5)
    return lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


@register("ml_23_pca")
def q_ml_23_pca(spark, d):
    """2-D principal-component projection of the embeddings with their
    cluster label (ML-23)."""
    return M.pca_projection(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
