"""Feature engineering, model selection and model metrics.

Metrics are aggregates over a prediction table ``(target, model, row_key,
ts, actual, predicted[, score])`` so one ``groupBy(target, model)`` scores
every candidate at once. Model fitting uses Spark ML estimators (data
parallel); the only driver loop is over candidate definitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantiles_of, rank_index, ranked_auc, value_at
from ..functions.scalars import safe_divide
from ..plans.scale import broadcast_if_small, cut_lineage, ordered_cumsum
from . import forests
from .density import density_clusters
from .profile import pearson

MAX_LEVELS = 1000


# ------------------------------------------------------------ ML-01

def preprocess(train: DataFrame, test: DataFrame, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """Fit on ``train``, apply to ``test``: median imputation and z-scaling
    with the population sd for numerics; most-frequent imputation and
    one-hot over every train level for categoricals (unseen -> all zeros).
    Statistics come from one aggregate plus the exact medians. A column per
    level suits up to ``MAX_LEVELS`` levels; :func:`preprocess_sparse` takes
    any number."""
    meds = {c: q[0] for c, q in quantiles_of(train, num, [0.5]).items()} if num else {}
    st = train.agg(*[e for c in num for e in (
        F.avg(F.coalesce(F.col(c), F.lit(meds[c]))).alias(f"m_{c}"),
        F.stddev_pop(F.coalesce(F.col(c), F.lit(meds[c]))).alias(f"s_{c}"))]).collect()[0] if num else {}
    out = [F.col(c) for c in test.columns if c not in num and c not in cat]
    for c in num:
        m, s = st[f"m_{c}"], st[f"s_{c}"] or 0.0
        filled = F.coalesce(F.col(c), F.lit(meds[c]))
        out.append(((filled - F.lit(m)) / F.lit(s if s > 0 else 1.0)).alias(c))
    for c in cat:
        lv = (train.where(F.col(c).isNotNull()).groupBy(c).count()
              .orderBy(F.desc("count"), F.asc(c)).limit(MAX_LEVELS + 1).collect())
        if len(lv) > MAX_LEVELS:
            raise ValueError(f"{c}: more than {MAX_LEVELS} levels; use preprocess_sparse")
        mode = lv[0][c] if lv else None
        v = F.coalesce(F.col(c), F.lit(mode))
        for lev in sorted(r[c] for r in lv):
            out.append(F.when(v == F.lit(lev), 1.0).otherwise(0.0).alias(f"{c}_{lev}"))
    return test.select(*out)


def preprocess_sparse(train: DataFrame, test: DataFrame, key: str, num: Sequence[str], cat: Sequence[str]) -> DataFrame:
    """:func:`preprocess` for any number of levels: (key, size, indices,
    values) of ``test``, a sparse row of features: first the scaled
    numerics, then for every categorical column its train levels in
    ascending order. The level of a row finds its index by a join with the
    table of levels, whose numbers come from the rank index; unseen levels
    have none. Keys are unique in ``test``."""
    filled = {c: q[0] for c, q in quantiles_of(train, num, [0.5]).items()} if num else {}
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(filled[c])) for c in num}
    st = train.agg(F.lit(0), *[e for i, c in enumerate(num) for e in (F.avg(x[c]).alias(f"m{i}"), F.stddev_pop(x[c]).alias(f"s{i}"))]).first()
    scaled = [(x[c] - F.lit(st[f"m{i}"])) / F.lit(st[f"s{i}"] or 1.0) for i, c in enumerate(num)]

    def cells(df: DataFrame, *more: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cat)])
        return df.select(*more, F.explode(each).alias("_e")).select(*more, "_e.*")
    counts = cut_lineage(cells(train).where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    levels = cut_lineage(rank_index(counts.select("c", "v"), ["c"]).select("c", "v", F.col("before").alias("index")))
    of = {r["c"]: r for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("levels"), F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("top"))
          .collect()}       # a row per column
    offset, first = [], len(num)
    for i in range(len(cat)):
        offset.append(first)
        first += of[i]["levels"] if i in of else 0
    starts = F.array(*[F.lit(o) for o in offset]).cast("array<long>")
    modes = F.array(*[F.lit(of[i]["top"]["v"] if i in of else None).cast("string") for i in range(len(cat))]) if cat else F.array()
    rows = test.select(F.col(key).alias("_k"), F.array(*scaled).cast("array<double>").alias("_dense"))
    found = (cells(test.withColumn("_k", F.col(key)), "_k").withColumn("v", F.coalesce("v", modes[F.col("c")]))
             .join(broadcast_if_small(levels, 500_000), ["c", "v"])
             .groupBy("_k").agg(F.sort_array(F.collect_list(F.col("index") + starts[F.col("c")])).alias("_hot")))     # one a column
    hot = F.coalesce("_hot", F.array().cast("array<long>"))
    dense = F.array(*[F.lit(i) for i in range(len(num))]).cast("array<long>")
    return rows.join(found, "_k", "left").select(
        F.col("_k").alias(key), F.lit(first).cast("long").alias("size"), F.concat(dense, hot).alias("indices"),
        F.concat("_dense", F.array_repeat(F.lit(1.0), F.size(hot))).alias("values"))


# ------------------------------------------------------------ ML-02..05

def variance_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Population variance after median fill; dropped when <= threshold."""
    meds = {c: q[0] for c, q in quantiles_of(df, cols, [0.5]).items()}
    row = df.agg(*[F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(meds[c]))).alias(f"v{i}")
                   for i, c in enumerate(cols)])
    parts = [F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("variance"))
             for i, c in enumerate(cols)]
    return (row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
            .withColumn("kept", F.col("variance") > threshold)
            .withColumn("reason", F.when(~F.col("kept"), F.lit(f"variance <= {threshold}"))))


def correlation_filter(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Drop a column when any earlier column (dropped ones included) has
    |r| > threshold with it."""
    m = pearson(df, cols, digits=12)
    pos = {c: i for i, c in enumerate(cols)}
    order = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    up = m.where(order[F.col("col_a")] < order[F.col("col_b")])
    hit = (up.where(F.abs("r") > threshold).groupBy(F.col("col_b").alias("column_name"))
           .agg(F.min_by("col_a", order[F.col("col_a")]).alias("correlated_with"),
                F.max(F.abs("r")).alias("max_abs_r")))
    allc = df.sparkSession.createDataFrame([(c, i) for c, i in pos.items()], "column_name string, pos int")
    return (allc.join(hit, "column_name", "left")
            .withColumn("kept", F.col("correlated_with").isNull())
            .withColumn("reason", F.when(~F.col("kept"), F.concat(F.lit(f"|r| > {threshold} with "),
                                                                  F.col("correlated_with"))))
            .drop("pos"))


def quantile_bins(df: DataFrame, cols: Sequence[str], bins: int) -> dict[str, Column]:
    """Bin index in [0, bins) of every column, by its exact quantile edges."""
    def place(c: str, edges: Sequence[float | None]) -> Column:
        found = F.array(*[F.lit(float(e)) for e in sorted({e for e in edges if e is not None})]).cast("array<double>")
        return F.size(F.filter(found, lambda e: e < F.col(c).cast("double")))
    return {c: place(c, edges) for c, edges in quantiles_of(df, cols, [i / bins for i in range(1, bins)]).items()}


def mutual_info(df: DataFrame, cols: Sequence[str], target: str, bins: int = 10,
                target_is_category: bool = True) -> DataFrame:
    """Plug-in mutual information (nats) between quantile-binned features
    and the target: sum p(x,y) ln(p(x,y) / (p(x) p(y))), from one joint
    count (feature, bin, class) of all features and its margins."""
    known = df.where(F.col(target).isNotNull())
    bin_of = quantile_bins(df, [*cols] if target_is_category else [*cols, target], bins)
    y = F.col(target).cast("string") if target_is_category else bin_of[target].cast("string")
    cells = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("column_name"), bin_of[c].alias("x"))) for c in cols])
    joint = (known.select(F.explode(F.array_compact(cells)).alias("c"), y.alias("y")).groupBy("c.column_name", "c.x", "y")
             .agg(F.count(F.lit(1)).alias("n")))
    total = joint.groupBy("column_name").agg(F.sum("n").alias("t"))
    by_x = joint.groupBy("column_name", "x").agg(F.sum("n").alias("nx"))
    by_y = joint.groupBy("column_name", "y").agg(F.sum("n").alias("ny"))
    j = joint.join(by_x, ["column_name", "x"]).join(by_y, ["column_name", "y"]).join(total, "column_name")
    pxy, px, py = F.col("n") / F.col("t"), F.col("nx") / F.col("t"), F.col("ny") / F.col("t")
    return j.groupBy("column_name").agg(F.sum(pxy * F.log(pxy / (px * py))).alias("mutual_info"))


def select_features(df: DataFrame, cols: Sequence[str], target: str, var_threshold: float = 0.01,
                    corr_threshold: float = 0.95) -> DataFrame:
    """Selection table: variance, correlation and mutual-information
    results side by side; selected = passes both filters. Date-part
    columns are excluded up front."""
    from .clean import DATE_PART_SUFFIXES
    use = [c for c in cols if not c.endswith(DATE_PART_SUFFIXES)]
    v = variance_filter(df, use, var_threshold).select("column_name", "variance",
                                                       F.col("kept").alias("variance_ok"))
    c = correlation_filter(df, use, corr_threshold).select("column_name", F.col("kept").alias("corr_ok"),
                                                           "correlated_with")
    mi = mutual_info(df, use, target)
    return (v.join(c, "column_name").join(mi, "column_name")
            .withColumn("selected", F.col("variance_ok") & F.col("corr_ok")))


# ------------------------------------------------------------ ML-06/07

def chronological_split(df: DataFrame, order: str, key: str, train_share: float = 0.8) -> DataFrame:
    """Adds ``split`` = train for the first ``int(n * share)`` rows by
    (order, key), test for the rest. The cut point is found with exact
    distributed order statistics, in the order of the columns' own types (a
    key may be text): no global sort, no single task. Rows without an order
    value are test rows."""
    from ..functions.scalars import epoch_micros
    typ = df.schema[order].dataType.typeName()
    o = epoch_micros(order) if typ in ("timestamp", "timestamp_ntz", "date") else F.col(order)
    x = df.withColumn("_o", o)
    n = x.count()
    k = int(n * train_share)
    if k <= 0:
        return df.withColumn("split", F.lit("test"))
    if k >= n:
        return df.withColumn("split", F.lit("train"))
    last = value_at(x, F.col("_o"), k - 1)                 # order value of the last train row
    if last is None:
        return x.withColumn("split", F.when(F.col("_o").isNotNull(), "train").otherwise("test")).drop("_o")
    v, below = F.lit(last[0]), last[1]
    tie = value_at(x.where(F.col("_o") == v), F.col(key), k - 1 - below)     # tie-break by key
    is_train = (F.col("_o") < v) | ((F.col("_o") == v) & (F.lit(True) if tie is None else F.col(key) <= F.lit(tie[0])))
    return x.withColumn("split", F.when(is_train, "train").otherwise("test")).drop("_o")


def hash_split(df: DataFrame, key: str, train_share: float = 0.8, seed: int = 42,
               stratify: str | None = None) -> DataFrame:
    """Reproducible random (or per-label) split by a hash of the key and
    seed; no shuffle, stable under recomputation."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed), *( [F.col(stratify)] if stratify else [])),
               F.lit(10_000))
    return df.withColumn("split", F.when(h < int(train_share * 10_000), "train").otherwise("test"))


def stratified_split(df: DataFrame, key: str, label: str, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``split`` so that every label has its share in train: the first
    ``floor(n * train_share + 0.5)`` of its rows in the order of a hash of
    the key, at least one and, of two rows or more, not all. Rows that
    repeat a key stay together, a null label is a label. A label with any
    share of the rows is split over partitions."""
    x = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).withColumn(
        "_l", F.coalesce(F.col(label).cast("string"), F.lit("\0")))
    index = cut_lineage(rank_index(x.select("_l", "_h"), ["_l"], "_h"))
    size = F.col("_size")
    most = F.greatest(F.lit(1), F.least(F.floor(size * train_share + 0.5), F.greatest(size - 1, F.lit(1))))
    sizes = index.groupBy("_l").agg(F.sum("n").alias("_size"))
    cut = index.join(sizes, "_l").where(F.col("before") < most).groupBy("_l").agg(F.max("_h").alias("_cut"))
    return (x.join(broadcast_if_small(cut, 100_000), "_l")
            .withColumn("split", F.when(F.col("_h") <= F.col("_cut"), "train").otherwise("test")).drop("_h", "_l", "_cut"))


def split_preview(df: DataFrame, order: Sequence[str], n_train: int = 10, n_test: int = 5,
                  digits: int = 4) -> DataFrame:
    dbl = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    r = df.select(*[F.round(c, digits).alias(c) if c in dbl else F.col(c) for c in df.columns])
    tr = r.where(F.col("split") == "train").orderBy(*order).limit(n_train)
    te = r.where(F.col("split") == "test").orderBy(*order).limit(n_test)
    return tr.unionByName(te)


# ------------------------------------------------------------ ML-14..22 metrics

def _safe_pred(c: str = "predicted") -> Column:
    p = F.col(c).cast("double")
    return F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), 0.0).otherwise(p)


def regression_metrics(preds: DataFrame, by: Sequence[str] = ("target", "model")) -> DataFrame:
    """RMSE, MAE, MAPE over non-zero actuals (0 when none), R2, MAPE flag
    (> 200 extreme, > 100 high) and negative-R2 warning, per group. NaN or
    infinite predictions count as 0. One aggregate over all groups."""
    a = F.col("actual").cast("double")
    e = a - _safe_pred()
    g = preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.coalesce(F.avg(F.when(a != 0, F.abs(e / a))) * 100, F.lit(0.0)).alias("mape"),
        F.sum(e * e).alias("_ssr"), F.var_pop(a).alias("_var"))
    r2 = F.when(F.col("_var") > 0, 1 - F.col("_ssr") / (F.col("_var") * F.col("n"))) \
        .otherwise(F.when(F.col("_ssr") == 0, 1.0).otherwise(0.0))
    return (g.withColumn("r2", r2).drop("_ssr", "_var")
            .withColumn("mape_flag", F.when(F.col("mape") > 200, "extreme")
                        .when(F.col("mape") > 100, "high").otherwise("normal"))
            .withColumn("r2_warning", F.col("r2") < 0))


def classification_metrics(preds: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 (0 when
    undefined) from confusion counts; binary AUC from average ranks of the
    score (rank-sum statistic)."""
    conf = preds.groupBy(*by, "actual", "predicted").count()
    per_class_true = conf.groupBy(*by, F.col("actual").alias("cls")).agg(F.sum("count").alias("support"))
    per_class_pred = conf.groupBy(*by, F.col("predicted").alias("cls")).agg(F.sum("count").alias("pred_n"))
    tp = conf.where(F.col("actual") == F.col("predicted")).select(*by, F.col("actual").alias("cls"),
                                                                 F.col("count").alias("tp"))
    pc = (per_class_true.join(per_class_pred, [*by, "cls"], "full_outer").join(tp, [*by, "cls"], "left")
          .fillna(0, ["support", "pred_n", "tp"]))
    prec = safe_divide(F.col("tp"), F.col("pred_n"), 0.0)
    rec = safe_divide(F.col("tp"), F.col("support"), 0.0)
    f1 = safe_divide(2 * prec * rec, prec + rec, 0.0)
    return pc.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(prec * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(rec * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))


def binary_auc(preds: DataFrame, label: str = "actual", score: str = "score", model: str | None = None) -> DataFrame:
    """ROC AUC = (rank sum of positives - P(P+1)/2) / (P N), ties averaged;
    one row, or one per value of the column ``model``, all in one pass."""
    rows = preds.select(F.col(model).alias("_g") if model else F.lit(0).alias("_g"), F.col(score).alias("score"),
                        F.col(label).cast("int").alias("_label"))
    out = ranked_auc(rows, ["_g"], F.col("_label") == 1)
    return out.select(*([F.col("_g").alias(model)] if model else []), F.col("auc").alias("auc_roc"))


def multiclass_auc(preds: DataFrame, scores: str = "scores", label: str = "actual", by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, auc_roc): one-versus-rest AUC of every class, weighted by the
    rows of the class. ``scores`` maps each class to a score. All models and
    classes are ranked at once; 0 if a class that occurs has no AUC (no
    score, or no row of another class)."""
    cells = preds.select(*by, F.col(label).cast("string").alias("_label"), F.explode(scores).alias("class", "score"))
    per_class = ranked_auc(cells, [*by, "class"], F.col("_label") == F.col("class"))
    support = preds.groupBy(*by, F.col(label).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    j = support.join(per_class, [*by, "class"], "left")
    return j.groupBy(*by).agg(F.when(F.count_if(F.col("auc").isNull()) > 0, F.lit(0.0)).otherwise(
        F.sum(F.col("auc") * F.col("rows")) / F.sum("rows")).alias("auc_roc"))


def confusion(preds: DataFrame, labels: Sequence) -> DataFrame:
    """Confusion matrix: one row per actual class, one column per predicted
    class (labels given, so the pivot needs no extra pass)."""
    return (preds.groupBy("actual").pivot("predicted", list(labels)).count().fillna(0))


def roc_points(preds: DataFrame, label: str = "actual", score: str = "score") -> DataFrame:
    """ROC and precision-recall points at every distinct score threshold
    (predict positive when score >= threshold), from score-ordered value
    counts with a distributed running sum (descending via negated score)."""
    vc = (preds.groupBy(F.col(score).cast("double").alias("thr"))
          .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
          .withColumn("_neg_thr", -F.col("thr")))
    tot = preds.agg(F.count_if(F.col(label) == 1).alias("P"), F.count_if(F.col(label) != 1).alias("N"))
    cs = ordered_cumsum(vc, "_neg_thr", ["pos", "neg"]).crossJoin(tot)   # tot is one row
    return cs.select("thr", (F.col("pos_upto") / F.col("P")).alias("tpr"),
                     (F.col("neg_upto") / F.col("N")).alias("fpr"),
                     safe_divide(F.col("pos_upto"), F.col("pos_upto") + F.col("neg_upto"), 1.0)
                     .alias("precision"))


def residuals(preds: DataFrame) -> DataFrame:
    return preds.withColumn("residual", F.col("actual") - _safe_pred())


def composite_score(metrics: DataFrame) -> DataFrame:
    """.35/(1+RMSE) + .25/(1+MAPE/100) + .25 max(0,R2) + .15/(1+cv_std)."""
    cv = F.coalesce(F.col("cv_std"), F.lit(0.0)) if "cv_std" in metrics.columns else F.lit(0.0)
    return metrics.withColumn("composite", F.round(
        0.35 / (1 + F.col("rmse")) + 0.25 / (1 + F.col("mape") / 100)
        + 0.25 * F.greatest(F.lit(0.0), F.col("r2")) + 0.15 / (1 + cv), 6))


def prediction_anomalies(preds: DataFrame, stats: DataFrame, keys=("target", "model"),
                         limit: int = 20) -> DataFrame:
    """Predictions outside [min - 2 sd, max + 2 sd] of the training target
    (``stats(target, t_min, t_max, t_sd)``), first ``limit`` by time per
    model. ``stats`` has one row per target (broadcast)."""
    j = preds.join(F.broadcast(stats), "target")
    out = j.where((F.col("predicted") < F.col("t_min") - 2 * F.col("t_sd"))
                  | (F.col("predicted") > F.col("t_max") + 2 * F.col("t_sd")))
    w = Window.partitionBy(*keys).orderBy("ts", "row_key")
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


# Leaderboard metrics and whether higher is better.
METRIC_DIRECTION = {"rmse": False, "mae": False, "mape": False, "r2": True, "cv_mean": False,
                    "composite": True}


def leaderboards(metrics: DataFrame, keys=("target",)) -> DataFrame:
    """Per metric and target: rank of each model in the metric's direction
    (ties by model name), best / worst model and the spread."""
    ms = [m for m in METRIC_DIRECTION if m in metrics.columns]
    stack = F.expr("stack({}, {})".format(len(ms), ", ".join(f"'{m}', cast({m} as double)" for m in ms)))
    long = metrics.select(*keys, "model", stack.alias("metric", "value"))
    hib = F.create_map(*[x for m in ms for x in (F.lit(m), F.lit(METRIC_DIRECTION[m]))])
    sort_v = F.when(hib[F.col("metric")], -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy(*keys, "metric").orderBy(sort_v, "model")
    wa = Window.partitionBy(*keys, "metric")
    return (long.withColumn("rank", F.row_number().over(w))
            .withColumn("best_model", F.first("model").over(w.rowsBetween(Window.unboundedPreceding,
                                                                          Window.unboundedFollowing)))
            .withColumn("spread", F.max("value").over(wa) - F.min("value").over(wa)))


def metric_drift(base: DataFrame, new: DataFrame, keys=("target", "model"),
                 metrics=("rmse", "mae", "mape", "r2"), flag_pct: float = 5.0) -> DataFrame:
    """abs(new - base) / abs(base) x 100 per metric (0 when |base| <= 1e-6),
    flagged above ``flag_pct``; long form (target, model, metric)."""
    def stack(df: DataFrame, name: str) -> DataFrame:
        pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
        return df.select(*keys, F.expr(f"stack({len(metrics)}, {pairs})").alias("metric", name))
    j = stack(base, "base").join(stack(new, "new"), [*keys, "metric"])
    d = F.when(F.abs("base") <= 1e-6, 0.0).otherwise(F.abs(F.col("new") - F.col("base")) / F.abs("base") * 100)
    return j.withColumn("drift_pct", d).withColumn("drifted", F.col("drift_pct") > flag_pct)


def scale_check(preds: DataFrame, by=("target", "model")) -> DataFrame:
    """Flag when |mean(pred) - mean(actual)| > 3 sd(actual)."""
    g = preds.groupBy(*by).agg(F.avg("predicted").alias("mean_pred"), F.avg("actual").alias("mean_actual"),
                               F.stddev_samp("actual").alias("sd_actual"))
    return g.withColumn("scale_mismatch",
                        F.abs(F.col("mean_pred") - F.col("mean_actual")) > 3 * F.col("sd_actual"))


def self_check(metrics: DataFrame, drift: DataFrame | None = None, n_models_min: int = 3) -> DataFrame:
    """Rule findings over a metric table (and drift): fewer than 3 models,
    MAPE > 200, R2 < 0, NaN metrics, drift > 50%. Severity: error for NaN /
    no models, major for MAPE and R2, minor for model count and drift."""
    m = metrics
    per = m.select("target", "model", F.explode(F.array_compact(F.array(
        F.when(F.col("mape") > 200, F.struct(F.lit("mape_over_200").alias("finding"),
                                              F.lit("major").alias("severity"))),
        F.when(F.col("r2") < 0, F.struct(F.lit("negative_r2").alias("finding"), F.lit("major").alias("severity"))),
        F.when(F.isnan("rmse") | F.col("rmse").isNull(),
               F.struct(F.lit("nan_metric").alias("finding"), F.lit("error").alias("severity")))))).alias("f"))
    per = per.select("target", "model", "f.finding", "f.severity")
    cnt = (m.groupBy("target").agg(F.countDistinct("model").alias("k"))
           .where(F.col("k") < n_models_min)
           .select("target", F.lit(None).cast("string").alias("model"), F.lit("few_models").alias("finding"),
                   F.lit("minor").alias("severity")))
    out = per.unionByName(cnt)
    if drift is not None:
        out = out.unionByName(drift.where(F.col("drift_pct") > 50).select(
            "target", "model", F.concat(F.lit("drift_"), F.col("metric")).alias("finding"),
            F.lit("minor").alias("severity")))
    return out


def insights(metrics: DataFrame) -> DataFrame:
    """Labels only: confidence by R2 (> .8 High, > .5 Moderate, else Low),
    reliability by MAPE (< 10 High, < 20 Moderate, else Low), stability by
    cv_std (< .05 High, < .1 Moderate, else Low)."""
    out = metrics.withColumn("confidence", F.when(F.col("r2") > 0.8, "High").when(F.col("r2") > 0.5, "Moderate")
                             .otherwise("Low"))
    out = out.withColumn("reliability", F.when(F.col("mape") < 10, "High").when(F.col("mape") < 20, "Moderate")
                         .otherwise("Low"))
    if "cv_std" in metrics.columns:
        out = out.withColumn("stability", F.when(F.col("cv_std") < 0.05, "High")
                             .when(F.col("cv_std") < 0.1, "Moderate").otherwise("Low"))
    return out


# ------------------------------------------------------------ ML-16 / ML-23 clusters

def segment_metrics(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz (Euclidean) from centroid and
    dispersion aggregates over the long (cluster, dim, value) form; fewer
    than 2 clusters -> (9999, 0). Label -1 is noise: it takes part in the
    sums as a group of its own but is not counted as a cluster."""
    long = df.select(F.col(label).alias("cluster"), F.col(vec).alias("_v"), F.col(key).alias("_rid"))
    lv = long.select("cluster", "_rid", F.posexplode("_v").alias("pos", "v")).withColumn(
        "v", F.col("v").cast("double"))
    cent = lv.groupBy("cluster", "pos").agg(F.avg("v").alias("c"), F.count(F.lit(1)).alias("n_c"))
    gc = lv.groupBy("pos").agg(F.avg("v").alias("g"))
    # per-point distance to its centroid
    dist = (lv.join(cent.select("cluster", "pos", "c"), ["cluster", "pos"])
            .groupBy("cluster", "_rid").agg(F.sum((F.col("v") - F.col("c")) ** 2).alias("d2")))
    disp = dist.groupBy("cluster").agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"),
                                       F.count(F.lit(1)).alias("n"))
    between = (cent.join(gc, "pos").groupBy("cluster")
               .agg(F.sum((F.col("c") - F.col("g")) ** 2).alias("b2")))
    a = cent.select(F.col("cluster").alias("ca"), "pos", F.col("c").alias("xa"))
    b = cent.select(F.col("cluster").alias("cb"), "pos", F.col("c").alias("xb"))
    cdist = (a.join(b, "pos").where(F.col("ca") != F.col("cb"))      # clusters x clusters x dims
             .groupBy("ca", "cb").agg(F.sqrt(F.sum((F.col("xa") - F.col("xb")) ** 2)).alias("dab")))
    sa = disp.select(F.col("cluster").alias("ca"), F.col("s").alias("sa"))
    sb = disp.select(F.col("cluster").alias("cb"), F.col("s").alias("sb"))
    db = (cdist.join(sa, "ca").join(sb, "cb")
          .groupBy("ca").agg(F.max((F.col("sa") + F.col("sb")) / F.col("dab")).alias("r"))
          .agg(F.avg("r").alias("davies_bouldin")))
    ch = (disp.join(between, "cluster")
          .agg(F.sum(F.col("n") * F.col("b2")).alias("B"), F.sum("w").alias("W"),
               F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"),
               F.count_if(F.col("cluster").cast("string") != "-1").alias("real"))
          .select(F.when(F.col("real") < 2, 0.0).otherwise((F.col("B") / (F.col("K") - 1))
                                                          / (F.col("W") / (F.col("N") - F.col("K"))))
                  .alias("calinski_harabasz"), "real"))
    return ch.crossJoin(db).select(F.when(F.col("real") < 2, 9999.0).otherwise(F.col("davies_bouldin"))
                                   .alias("davies_bouldin"), "calinski_harabasz",
                                   F.col("real").alias("clusters"))


def cluster_profile(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Cluster sizes, share and mean of each profile column."""
    tot = df.count()
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("size"),
                                 *[F.avg(c).alias(f"mean_{c}") for c in cols]) \
        .withColumn("share", F.col("size") / F.lit(tot))


# ------------------------------------------------------------ ML-08..13, 24 (Spark ML)

def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def regression_candidates(label: str):
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    c = [("linear", LinearRegression(labelCol=label))]
    c += [(f"ridge_{a}", LinearRegression(labelCol=label, regParam=a, elasticNetParam=0.0))
          for a in (0.01, 0.1, 1.0, 10.0, 100.0)]
    c += [("random_forest", RandomForestRegressor(labelCol=label, numTrees=50, seed=42)),
          ("gradient_boosting", GBTRegressor(labelCol=label, maxIter=30, seed=42))]
    return c


def classification_candidates(label: str):
    from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                           RandomForestClassifier)
    return [("logistic", LogisticRegression(labelCol=label, maxIter=100)),
            ("random_forest", RandomForestClassifier(labelCol=label, numTrees=50, seed=42)),
            ("linear_svc", OneVsRest(classifier=LinearSVC(maxIter=50), labelCol=label)),
            ("gradient_boosting", GBTClassifier(labelCol=label, maxIter=30, seed=42))]


def segmentation_candidates(features: str = "features"):
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
    return [("kmeans_3", KMeans(k=3, seed=42, featuresCol=features)),
            ("kmeans_5", KMeans(k=5, seed=42, featuresCol=features)),
            ("gaussian_mixture_4", GaussianMixture(k=4, seed=42, featuresCol=features)),
            ("bisecting_4", BisectingKMeans(k=4, seed=42, featuresCol=features))]


def fit_candidates(train: DataFrame, test: DataFrame, candidates, label: str, row_key: str,
                   target: str | None = None) -> DataFrame:
    """Fit each candidate on ``train`` and predict ``test``; returns the
    long prediction table ``(target, model, row_key, actual, predicted)``.
    Each fit is a distributed Spark ML job; only the loop over candidate
    definitions runs on the driver. The test rows are read once, with a
    prediction of each model. Forests and boosted trees of many rows are
    fitted on sums per cell, all from one pass (``forests``)."""
    trees = [est for _, est in candidates if forests.suits(est)]
    grid = forests.grid_of(train, max(e.getMaxBins() for e in trees)) if trees else None
    on_cells = iter(forests.fit_all(trees, train, grid, label, row_key) if grid else [])
    p, found = test.select(F.col(row_key).alias("row_key"), F.col(label).cast("double").alias("actual"), "features"), []
    if grid:
        p = grid.with_cell(p)       # once for all models on cells
    keep = p.columns
    for i, (name, est) in enumerate(candidates):
        model = next(on_cells) if grid and forests.suits(est) else est.fit(train)
        p = (model.transform(p).withColumn(f"_p{i}", F.col("prediction").cast("double"))
             .select(*keep, *[f"_p{j}" for j in range(i + 1)]))
        found.append(F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").alias("predicted")))
    return (p.select("row_key", "actual", F.explode(F.array(*found)).alias("_m"))
            .select(F.lit(target or label).alias("target"), "_m.model", "row_key", "actual", "_m.predicted"))


def cv_scores(train: DataFrame, estimator, label: str, key: str, k: int = 5, metric: str = "rmse",
              grid=None, parallelism: int = 4):
    """k-fold scores with a hash fold column (reproducible); returns
    (fitted model, mean metric of every grid point). RMSE of forests of many
    rows comes from sums per cell, folds and grid points from one pass
    (``forests``); all else from Spark ML's CrossValidator."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    folded = train.withColumn("_fold", F.pmod(F.xxhash64(F.col(key), F.lit(42)), F.lit(k)).cast("int"))
    points = [estimator.copy(m) for m in grid or ParamGridBuilder().build()]
    if metric == "rmse" and all(forests.suits(e) and hasattr(e, "getNumTrees") and e.getSeed() == points[0].getSeed()
                                for e in points):
        cells = forests.grid_of(folded, max(e.getMaxBins() for e in points), points[0].getFeaturesCol())
        if cells:
            model = forests.cv_forests(folded, "_fold", k, points, cells, label, key, parallelism)
            return model, model.avgMetrics
    ev = (RegressionEvaluator(labelCol=label, metricName=metric) if metric in ("rmse", "mae", "r2")
          else MulticlassClassificationEvaluator(labelCol=label, metricName="weightedFMeasure"))
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=grid or ParamGridBuilder().build(),
                        evaluator=ev, foldCol="_fold", numFolds=k, parallelism=parallelism,
                        collectSubModels=False)
    model = cv.fit(folded)
    return model, model.avgMetrics


def model_summary(model, features: Sequence[str], top: int = 10):
    """(feature, weight) rows: tree importances or |coefficients|, top 10."""
    if hasattr(model, "featureImportances"):
        w = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficients"):
        w = [abs(x) for x in model.coefficients.toArray().tolist()]
    else:
        w = [0.0] * len(features)
    rows = sorted(zip(features, w), key=lambda t: -t[1])[:top]
    return rows


def dbscan(df: DataFrame, key: str, x: str, y: str, eps: float = 0.5, min_pts: int = 5) -> DataFrame:
    """ML-11 in two dimensions."""
    return density_clusters(df, key, [x, y], eps, min_pts)


def cv_fold_scores(train: DataFrame, estimator, label: str, key: str, k: int = 5, metric: str = "rmse",
                   seed: int = 42) -> list[float]:
    """ML-12 per-fold scores: fold = hash of the key; each fold is scored
    by a model fitted on the other folds (k distributed fits). Mean and
    population sd of the returned list are the CV summary."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    folded = train.withColumn("_fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))
    ev = (RegressionEvaluator(labelCol=label, metricName=metric) if metric in ("rmse", "mae", "r2")
          else MulticlassClassificationEvaluator(labelCol=label, metricName="weightedFMeasure"))
    scores = []
    for f in range(k):
        model = estimator.fit(folded.where(F.col("_fold") != f))
        scores.append(float(ev.evaluate(model.transform(folded.where(F.col("_fold") == f)))))
    return scores


def pca_projection(df: DataFrame, key: str, vec: str, label: str | None = None, k: int = 2) -> DataFrame:
    """ML-23 2-D view: project vectors on the top ``k`` principal components
    (Spark ML PCA; component signs are arbitrary)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    keep = [key] + ([label] if label else [])
    v = df.select(*keep, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    out = model.transform(v).select(*keep, vector_to_array("_p").alias("_p"))
    return out.select(*keep, *[F.col("_p")[i].alias(f"pc{i + 1}") for i in range(k)])
