"""Joins, aggregates, windows and set operations.

All of it is plain DataFrame algebra: Catalyst chooses the join strategy
(broadcast only behind :func:`broadcast_if_small`), aggregates run with
map-side partial aggregation, windows are always partitioned by a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import row_hash, safe_divide, surrogate_key
from ..plans.scale import broadcast_if_small, broadcast_many, salt_column


def _cols(cols):
    return [cols] if isinstance(cols, str) else list(cols)


# ---------------------------------------------------------------- joins (2.5)

def obt(fact: DataFrame, dims: Sequence[tuple[DataFrame, str | Sequence[str], str | None]],
        how: str = "inner") -> DataFrame:
    """One-big-table: join ``fact`` to each dimension in order.

    ``dims`` holds ``(dim, join_keys, current_flag)``; when ``current_flag``
    names a boolean column only current rows of that dimension join.
    Each dimension is broadcast only when its row count is proven small,
    otherwise the join is planned as a shuffle join.
    """
    ds = broadcast_many([dim.where(F.col(cur)) if cur else dim for dim, _k, cur in dims])
    out = fact
    for d, (_dim, keys, _cur) in zip(ds, dims):
        out = out.join(d, on=_cols(keys), how=how)
    return out


def enrich(fact: DataFrame, dims: Sequence[tuple[DataFrame, str | Sequence[str]]]) -> DataFrame:
    """Left enrichment: every fact row survives, dimension fields may be null."""
    ds = broadcast_many([dim for dim, _k in dims])
    out = fact
    for d, (_dim, keys) in zip(ds, dims):
        out = out.join(d, on=_cols(keys), how="left")
    return out


def join_small(large: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = 2_000_000) -> DataFrame:
    """Broadcast hash join when ``small`` is proven below ``max_rows``."""
    return large.join(broadcast_if_small(small, max_rows), on=_cols(on), how=how)


def join_large(a: DataFrame, b: DataFrame, on, n_partitions: int | None = None,
               how: str = "inner") -> DataFrame:
    """Large-large join: both sides hash-partitioned on the key into the same
    number of partitions, sort-merge preferred. The explicit repartition is
    the one exchange each side needs; the join adds none."""
    keys = _cols(on)
    if n_partitions:
        a = a.repartition(n_partitions, *keys)
        b = b.repartition(n_partitions, *keys)
    return a.hint("merge").join(b, on=keys, how=how)


def salted_join(big: DataFrame, small: DataFrame, on, salts: int = 16,
                how: str = "inner") -> DataFrame:
    """Join that spreads each key of ``big`` over ``salts`` tasks.

    The big side gets a deterministic salt from its row content; the small
    side is replicated once per salt. The result equals the plain join.
    Joins that return unmatched rows of the small side are refused: its
    replicas would each be unmatched.
    """
    if how.lower().replace("_", "") not in ("inner", "left", "leftouter", "leftsemi", "semi", "leftanti", "anti"):
        raise ValueError(f"salted_join does not support how={how!r}")
    keys = _cols(on)
    b = big.withColumn("_salt", salt_column(salts, *big.columns))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, on=keys + ["_salt"], how=how).drop("_salt")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent (anti join; ``NOT IN``
    would return nothing once the parent holds a null)."""
    p = parent.select(F.col(parent_key).alias("_pk")).where(F.col("_pk").isNotNull())
    return (child.where(F.col(child_key).isNotNull())
            .join(p, F.col(child_key) == F.col("_pk"), "left_anti"))


def new_rows(stage: DataFrame, target: DataFrame, keys) -> DataFrame:
    """Insert-if-absent: stage rows whose key (null-safe) is not in target."""
    ks = _cols(keys)
    t = target.select(*[F.col(k).alias(f"_t_{k}") for k in ks]).distinct()
    cond = None
    for k in ks:
        c = F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        cond = c if cond is None else cond & c
    return stage.join(t, cond, "left_anti")


def changed_rows(stage: DataFrame, current: DataFrame, key, cols: Sequence[str]) -> DataFrame:
    """Stage rows that are new or whose attribute hash differs from the
    current row; adds ``change_type`` in (new, changed)."""
    ks = _cols(key)
    cur = current.select(*[F.col(k).alias(f"_c_{k}") for k in ks],
                         row_hash(*cols).alias("_c_hash"))
    cond = None
    for k in ks:
        c = F.col(k) == F.col(f"_c_{k}")
        cond = c if cond is None else cond & c
    j = stage.withColumn("_s_hash", row_hash(*cols)).join(cur, cond, "left")
    out = j.where(F.col(f"_c_{ks[0]}").isNull() | (F.col("_s_hash") != F.col("_c_hash")))
    out = out.withColumn("change_type", F.when(F.col(f"_c_{ks[0]}").isNull(), "new")
                         .otherwise("changed"))
    return out.drop("_s_hash", "_c_hash", *[f"_c_{k}" for k in ks])


def serve(batch_view: DataFrame, speed_view: DataFrame, keys, aggs: dict[str, str]) -> DataFrame:
    """Serving layer: union batch and speed partials and re-aggregate.
    ``aggs`` maps column -> merge function (sum, max, min)."""
    u = batch_view.unionByName(speed_view)
    return u.groupBy(*_cols(keys)).agg(*[getattr(F, f)(c).alias(c) for c, f in aggs.items()])


def traverse(start: DataFrame, edges: DataFrame, path: Sequence[str],
             names: DataFrame) -> DataFrame:
    """Follow edge types level by level from each start node.

    ``start(start_id)``, ``edges(src, type, dst)``, ``names(node_id, name)``.
    Returns long rows ``(start_id, level, name)``, one per distinct name
    reached at that level; long form keeps a hub with millions of
    neighbours spread over tasks instead of one collected array.
    """
    frontier = start.select("start_id", F.col("start_id").alias("node"))
    levels = []
    for i, etype in enumerate(path, start=1):
        e = edges.where(F.col("type") == etype).select(F.col("src").alias("node"),
                                                       F.col("dst").alias("next"))
        frontier = (frontier.join(e, "node").select("start_id", F.col("next").alias("node"))
                    .distinct())
        levels.append(frontier.withColumn("level", F.lit(i)))
    reached = levels[0]
    for lv in levels[1:]:
        reached = reached.unionByName(lv)
    n = names.select(F.col("node_id").alias("node"), "name")
    return reached.join(n, "node").select("start_id", "level", "name").distinct()


# -------------------------------------------------------------- aggregates (2.6)

def daily_user_events(df: DataFrame, user="user_id", etype="event_type", ts="ts",
                      amount="value") -> DataFrame:
    """Batch daily view per user, type and day: count, sum, latest time."""
    return (df.groupBy(user, etype, F.to_date(ts).alias("event_date"))
            .agg(F.count(F.lit(1)).alias("event_count"),
                 F.sum(amount).alias("total_revenue"),
                 F.max(ts).alias("last_event")))


def daily_user_metrics(df: DataFrame, user="user_id", ts="ts", session="session_id",
                       etype="event_type", amount="value", paying="purchase") -> DataFrame:
    """Gold metrics per user and day: events, distinct sessions, revenue of
    paying events, last activity."""
    return (df.groupBy(user, F.to_date(ts).alias("event_date"))
            .agg(F.count(F.lit(1)).alias("total_events"),
                 F.countDistinct(session).alias("sessions"),
                 F.sum(F.when(F.col(etype) == paying, F.col(amount)).otherwise(F.lit(0.0)))
                 .alias("revenue"),
                 F.max(ts).alias("last_activity")))


def value_counts(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Top-``n`` values by count desc, ties by value asc (top-k plan)."""
    return (df.groupBy(F.col(col).cast("string").alias("value")).count()
            .orderBy(F.desc("count"), F.asc("value")).limit(n))


def null_summary(df: DataFrame, cols: Sequence[str] | None = None, over: float = 0.5) -> DataFrame:
    """Null count per column in one aggregate pass, returned long."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_z{i}") for i, c in enumerate(cols)])
    stack = F.expr("stack({}, {})".format(
        len(cols), ", ".join(f"'{c}', _z{i}" for i, c in enumerate(cols))))
    long = row.select("_n", stack.alias("column_name", "null_count"))
    return (long.select("column_name", F.col("null_count").cast("long").alias("null_count"),
                        F.col("_n").cast("long").alias("total"))
            .withColumn("null_pct", F.round(safe_divide(F.col("null_count") * 100.0,
                                                        F.col("total")), 6))
            .withColumn("over_threshold", F.col("null_count") > F.col("total") * over))


def group_stats(df: DataFrame, by, col: str) -> DataFrame:
    """Mean and distribution of ``col`` per group; the quartiles are exact
    and computed by bracketing, so a huge group is never one buffer."""
    from ..functions.quantiles import grouped_quantiles
    ks = _cols(by)
    base = (df.groupBy(*ks).agg(F.count(col).alias("n"), F.avg(col).alias("mean"),
                                F.min(col).alias("min"), F.max(col).alias("max")))
    q = grouped_quantiles(df, ks, col, [0.25, 0.5, 0.75], ["p25", "median", "p75"])
    return base.join(q, ks, "left")


def usage_heavy_hitters(log: DataFrame, as_of: str, min_bytes: float = 1e10,
                        min_runs: int = 10, days: int = 7) -> DataFrame:
    """Statements scanning more than ``min_bytes`` in the last ``days`` days,
    run more than ``min_runs`` times; saving estimated at 70% of credits.
    ``log(query_text, bytes_scanned, credits_used, start_time)``."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return (log.where((F.col("bytes_scanned") > min_bytes) & (F.col("start_time") > since))
            .groupBy("query_text")
            .agg(F.count(F.lit(1)).alias("execution_count"),
                 F.avg("bytes_scanned").alias("avg_bytes"),
                 F.sum("credits_used").alias("total_credits"))
            .where(F.col("execution_count") > min_runs)
            .withColumn("potential_savings", F.col("total_credits") * 0.7))


def dearest_statements(log: DataFrame, as_of: str, k: int = 20, days: int = 7) -> DataFrame:
    """The ``k`` statements of the last ``days`` days with the most credits
    (a top-k plan)."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return (log.where(F.col("start_time") > since)
            .orderBy(F.desc("credits_used"), F.asc("start_time"), F.asc("query_text")).limit(k))


def storage_findings(tables: DataFrame, as_of: str) -> DataFrame:
    """Idle (>90 days unread, >1 GB; cost GB x 0.023) and unpartitioned
    (>10 GB; saving 10% of GB) tables.
    ``tables(table_name, bytes, last_accessed, partition_column)``."""
    cut = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(90))
    gb = F.col("bytes") / 1e9
    idle = (tables.where((F.col("last_accessed") < cut) & (F.col("bytes") > 1e9))
            .select("table_name", F.lit("idle").alias("finding"),
                    (gb * 0.023).alias("current_cost"), (gb * 0.023).alias("potential_savings")))
    unpart = (tables.where(F.col("partition_column").isNull() & (F.col("bytes") > 10e9))
              .select("table_name", F.lit("unpartitioned").alias("finding"),
                      F.lit(0.0).alias("current_cost"), (gb * 0.1).alias("potential_savings")))
    return idle.unionByName(unpart)


def idle_compute(metering: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Warehouses averaging < 1 running query on a size above Small:
    weekly cost = 7 x mean credits, saving 50%.
    ``metering(warehouse_name, warehouse_size, avg_running_queries,
    credits_used, start_time)``."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    g = (metering.where(F.col("start_time") > since)
         .groupBy("warehouse_name", "warehouse_size")
         .agg(F.avg("avg_running_queries").alias("avg_queries"),
              F.avg("credits_used").alias("avg_credits")))
    return (g.where((F.col("avg_queries") < 1) & ~F.col("warehouse_size").isin("X-Small", "Small"))
            .withColumn("current_cost", F.col("avg_credits") * 7)
            .withColumn("potential_savings", F.col("avg_credits") * 7 * 0.5))


def saving_summary(findings: DataFrame) -> DataFrame:
    """Totals over findings ``(category, current_cost, potential_savings)``."""
    return findings.agg(
        F.sum("current_cost").alias("total_current_cost"),
        F.sum("potential_savings").alias("total_potential_savings"),
        F.count(F.lit(1)).alias("recommendations"),
    ).withColumn("savings_percentage",
                 safe_divide(F.col("total_potential_savings") * 100, F.col("total_current_cost")))


def alerts(runs: DataFrame, as_of: str) -> DataFrame:
    """Alert rules over a run log ``(pipeline, ts, status, duration_s, rows,
    quality_score)``: freshness > 24 h (critical), latest quality < 0.95
    (warning), any failure in the last hour (critical), p95 duration over
    the last hour > 3600 s (warning), rows in 24 h < 1000 (warning)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    h1 = now - F.make_dt_interval(F.lit(0), F.lit(1))
    h24 = now - F.make_dt_interval(F.lit(1))
    from ..functions.quantiles import grouped_quantiles
    r = runs.where(F.col("ts") <= now)
    m = (r.groupBy("pipeline").agg(
        F.max(F.when(F.col("status") == "success", F.col("ts"))).alias("last_success"),
        F.max_by("quality_score", F.struct("ts", "quality_score")).alias("latest_quality"),
        F.count_if((F.col("status") == "failure") & (F.col("ts") > h1)).alias("failures_1h"),
        F.sum(F.when(F.col("ts") > h24, F.col("rows")).otherwise(F.lit(0))).alias("rows_24h")))
    p95 = grouped_quantiles(r.where(F.col("ts") > h1), ["pipeline"], "duration_s", [0.95], ["p95_1h"])
    m = m.join(p95, "pipeline", "left")
    fresh_h = (F.unix_micros(F.to_utc_timestamp(now, "UTC")) -
               F.unix_micros(F.to_utc_timestamp(F.col("last_success"), "UTC"))) / 3.6e9
    rules = [
        ("DataFreshnessAlert", "critical", fresh_h, F.col("last_success").isNull() | (fresh_h > 24)),
        ("DataQualityDegraded", "warning", F.col("latest_quality"), F.col("latest_quality") < 0.95),
        ("PipelineFailure", "critical", F.col("failures_1h").cast("double"), F.col("failures_1h") > 0),
        ("PipelineSlowdown", "warning", F.col("p95_1h"), F.col("p95_1h") > 3600),
        ("LowRowCount", "warning", F.col("rows_24h").cast("double"), F.col("rows_24h") < 1000),
    ]
    fired = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(name).alias("alert"), F.lit(sev).alias("severity"),
                              val.cast("double").alias("value")))
        for name, sev, val, cond in rules]))
    return (m.select("pipeline", F.explode(fired).alias("a"))
            .select("pipeline", "a.alert", "a.severity", "a.value"))


# ----------------------------------------------------------------- windows (2.7)

def _w(keys, order) -> Window:
    return Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))


def lag_features(df: DataFrame, keys, order, cols: Sequence[str], lags=(1, 3),
                 backfill: bool = True) -> DataFrame:
    """``{c}_lag{k}`` per series; the head (no row k steps back) is
    back-filled with the series' first lagged value, as a reverse-running
    ``last(ignorenulls)`` (O(n) per series, no unbounded-following frame)."""
    w = _w(keys, order)
    out = df
    for c in cols:
        for k in lags:
            out = out.withColumn(f"{c}_lag{k}", F.lag(c, k).over(w))
    if backfill:
        rev = Window.partitionBy(*_cols(keys)).orderBy(*[F.col(o).desc() for o in _cols(order)]) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for c in cols:
            for k in lags:
                name = f"{c}_lag{k}"
                out = out.withColumn(name, F.last(name, ignorenulls=True).over(rev))
    return out


def rolling_mean(df: DataFrame, keys, order, cols: Sequence[str], sizes=(3, 6)) -> DataFrame:
    """Trailing mean over the last ``k`` rows, shorter at the head."""
    out = df
    for c in cols:
        for k in sizes:
            out = out.withColumn(f"{c}_roll{k}",
                                 F.avg(c).over(_w(keys, order).rowsBetween(-(k - 1), 0)))
    return out


def log_diff(df: DataFrame, keys, order, col: str) -> DataFrame:
    """Seasonal-or-first difference: lag 12 when the series has at least 24
    points, else 1; log difference unless any value <= 0; head is 0."""
    part = Window.partitionBy(*_cols(keys))
    w = _w(keys, order)
    n = F.count(F.lit(1)).over(part)
    mn = F.min(col).over(part)
    lagged = F.when(n >= 24, F.lag(col, 12).over(w)).otherwise(F.lag(col, 1).over(w))
    d = F.when(mn > 0, F.ln(F.col(col)) - F.ln(lagged)).otherwise(F.col(col) - lagged)
    return df.withColumn(f"{col}_diff", F.coalesce(d, F.lit(0.0)))


def sudden_changes(pred: DataFrame, keys, order, col: str, train_std: Column | float,
                   k: float = 3.0, bucket: Column | None = None) -> DataFrame:
    """Rows where |y[i] - y[i-1]| exceeds ``k`` x the training std."""
    out = windowed_with_halo(pred, keys, order, bucket, 1, lambda d, w: d.withColumn(
        "jump", F.abs(F.col(col) - F.lag(col, 1).over(w))))
    return out.where(F.col("jump") > F.lit(k) * (train_std if isinstance(train_std, Column)
                                                 else F.lit(train_std)))


def trend_profile(df: DataFrame, keys, order, col: str) -> DataFrame:
    """Mean of second half vs first half (±10% → upward/downward/flat),
    volatility from cv = std/|mean| (>0.5 high, >0.2 moderate, else low),
    overall change % from first to last value."""
    w = _w(keys, order)
    part = Window.partitionBy(*_cols(keys))
    t = (df.withColumn("_i", F.row_number().over(w))
         .withColumn("_n", F.count(F.lit(1)).over(part)))
    half = F.floor(F.col("_n") / 2)
    g = t.groupBy(*_cols(keys)).agg(
        F.avg(F.when(F.col("_i") <= half, F.col(col))).alias("first_half_mean"),
        F.avg(F.when(F.col("_i") > half, F.col(col))).alias("second_half_mean"),
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min_by(col, "_i").alias("first_value"), F.max_by(col, "_i").alias("last_value"))
    ratio = safe_divide(F.col("second_half_mean") - F.col("first_half_mean"),
                        F.abs(F.col("first_half_mean")))
    cv = safe_divide(F.col("std"), F.abs(F.col("mean")))
    return (g.withColumn("trend", F.when(ratio > 0.1, "upward").when(ratio < -0.1, "downward")
                         .otherwise("flat"))
            .withColumn("volatility", F.when(cv > 0.5, "high").when(cv > 0.2, "moderate")
                        .otherwise("low"))
            .withColumn("change_pct", safe_divide((F.col("last_value") - F.col("first_value")) * 100,
                                                  F.abs(F.col("first_value")))))


def rank_models(results: DataFrame, score: str, name: str = "model", by=None,
                ascending: bool = False) -> DataFrame:
    """Rank candidates by primary score (desc by default), ties by name."""
    o = F.col(score).asc() if ascending else F.col(score).desc()
    w = Window.partitionBy(*_cols(by)) if by else Window.partitionBy(F.lit(0))
    return results.withColumn("rank", F.row_number().over(w.orderBy(o, F.col(name))))


def latest_per_key(df: DataFrame, key, order) -> DataFrame:
    """Latest row per key: an aggregate ``max_by`` over a struct of the row
    (partial aggregation, so a hot key never sorts in one task)."""
    ks = _cols(key)
    os_ = _cols(order)
    rest = [c for c in df.columns if c not in ks]
    packed = F.struct(*[F.col(c) for c in os_], F.struct(*rest).alias("_row"))
    return (df.groupBy(*ks).agg(F.max(packed).alias("_m"))
            .select(*ks, *[F.col(f"_m._row.{c}").alias(c) for c in rest]))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Sort and cut; planned as TakeOrderedAndProject (per-task top-k)."""
    return df.orderBy(*order).limit(k)


def rolling_mape(df: DataFrame, keys, order, actual: str, pred: str, k: int,
                 bucket: Column | None = None) -> DataFrame:
    """Mean of |error / actual| x 100 over the trailing ``k`` rows (actual 0
    rows excluded from the mean)."""
    e = F.when(F.col(actual) != 0, F.abs((F.col(actual) - F.col(pred)) / F.col(actual)) * 100)
    return windowed_with_halo(df, keys, order, bucket, k - 1 if k > 1 else 1, lambda d, w: d.withColumn(
        "rolling_mape", F.avg(e).over(w.rowsBetween(-(k - 1), 0))))


# ------------------------------------------------------------ set operations (2.8)

def concat(*dfs: DataFrame, allow_missing: bool = True) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=allow_missing)
    return out


def append_records(df: DataFrame, new: DataFrame, key_cols: Sequence[str], as_of: str) -> DataFrame:
    """Append with a replayable id (hash of the record) and timestamps."""
    stamped = (new.withColumn("id", surrogate_key(*key_cols))
               .withColumn("created_at", F.lit(as_of).cast("timestamp_ntz"))
               .withColumn("updated_at", F.lit(as_of).cast("timestamp_ntz")))
    return df.unionByName(stamped, allowMissingColumns=True)


def merge_dedupe(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of several result sets, one row per key (first by key order of
    the inputs: earlier frames win)."""
    tagged = [d.withColumn("_src", F.lit(i)) for i, d in enumerate(dfs)]
    u = concat(*tagged)
    return latest_per_key(u.withColumn("_ord", -F.col("_src")), key, ["_ord"]).drop("_src", "_ord")


def patch_merge(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Incoming non-null fields overwrite, others keep; new keys inserted."""
    cols = [c for c in base.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") if c in patch.columns
                            else F.lit(None).alias(f"_p_{c}") for c in cols])
    j = base.join(p, key, "full_outer")
    return j.select(key, *[F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) for c in cols])


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys`` (anti join)."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


# ------------------------------------------------- bucketed windows for hot keys

def key_is_hot(df: DataFrame, keys, factor: float = 2.0) -> bool:
    """True when the largest key holds more rows than ``factor`` average
    shuffle partitions: then one task per key would be the bottleneck.
    One aggregate (partial counts per key, then a max)."""
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.groupBy(*_cols(keys)).count().agg(F.max("count").alias("m"), F.sum("count").alias("n")).collect()[0]
    if not r["n"]:
        return False
    return r["m"] > factor * r["n"] / n_parts



def with_halo(df: DataFrame, keys, order, bucket: Column, k: int) -> DataFrame:
    """Rows grouped into (keys, ``_b``) buckets, each bucket prefixed with
    the ``k`` rows that precede it in key order (flag ``_halo``).

    ``bucket`` must not decrease along ``order`` (e.g. the day of the
    first order column). Windows partitioned by (keys, ``_b``) then see
    every row they need for lags / frames of up to ``k`` rows back, so a
    key with a third of all rows is spread over many buckets instead of
    one task. The halo comes from a table of at most ``k`` tail rows per
    bucket, indexed per key (bounded by buckets x k, not by rows), and is
    fetched with an equi-join on (keys, tail index)."""
    ks, os_ = _cols(keys), _cols(order)
    x = df.withColumn("_b", bucket)
    desc = Window.partitionBy(*ks, "_b").orderBy(*[F.col(o).desc() for o in os_])
    tails = x.withColumn("_rd", F.row_number().over(desc)).where(F.col("_rd") <= k).drop("_rd")
    tails = tails.withColumn("_ti", F.row_number().over(Window.partitionBy(*ks).orderBy(*os_)))
    per_b = tails.groupBy(*ks, "_b").agg(F.count(F.lit(1)).alias("_nt"))
    per_b = per_b.withColumn("_last", F.coalesce(F.sum("_nt").over(
        Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    req = (per_b.where(F.col("_last") > 0)
           .select(*ks, F.col("_b").alias("_target"),
                   F.explode(F.sequence(F.greatest(F.col("_last") - k + 1, F.lit(1)), F.col("_last"))).alias("_ti")))
    halo = (tails.join(req, [*ks, "_ti"]).drop("_ti", "_b").withColumnRenamed("_target", "_b")
            .withColumn("_halo", F.lit(True)))
    return x.withColumn("_halo", F.lit(False)).unionByName(halo.select(*x.columns, "_halo"))


def _bfill_across_buckets(df: DataFrame, keys, order, cols: Sequence[str]) -> DataFrame:
    """Back-fill nulls with the next non-null value in key order, when the
    rows are already split into ``_b`` buckets: inside a bucket a
    reverse-running last(ignorenulls); past the bucket end the first
    non-null of the following buckets (per-bucket table, bounded)."""
    ks, os_ = _cols(keys), _cols(order)
    rev = Window.partitionBy(*ks, "_b").orderBy(*[F.col(o).desc() for o in os_]) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = df.groupBy(*ks, "_b").agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*os_))).alias(f"_f_{c}") for c in cols])
    nb = Window.partitionBy(*ks).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    nxt = firsts.select(*ks, "_b", *[F.last(f"_f_{c}", ignorenulls=True).over(nb).alias(f"_n_{c}") for c in cols])
    out = df.join(nxt, [*ks, "_b"], "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(rev), F.col(f"_n_{c}")))
    return out.drop(*[f"_n_{c}" for c in cols])


def lag_features_bucketed(df: DataFrame, keys, order, cols: Sequence[str], bucket: Column,
                          lags=(1, 3), backfill: bool = True, force: bool = False) -> DataFrame:
    """:func:`lag_features` for hot keys: identical result, computed per
    (key, bucket) with a halo of ``max(lags)`` rows. Without a hot key
    (see :func:`key_is_hot`) the plain per-key window is used."""
    if not force and not key_is_hot(df, keys):
        return lag_features(df, keys, order, cols, lags, backfill)
    k = max(lags)
    h = with_halo(df, keys, order, bucket, k)
    w = Window.partitionBy(*_cols(keys), "_b").orderBy(*_cols(order))
    for c in cols:
        for lg in lags:
            h = h.withColumn(f"{c}_lag{lg}", F.lag(c, lg).over(w))
    h = h.where(~F.col("_halo")).drop("_halo")
    if backfill:
        h = _bfill_across_buckets(h, keys, order, [f"{c}_lag{lg}" for c in cols for lg in lags])
    return h.drop("_b")


def rolling_mean_bucketed(df: DataFrame, keys, order, cols: Sequence[str], bucket: Column,
                          sizes=(3, 6), force: bool = False) -> DataFrame:
    """:func:`rolling_mean` for hot keys (halo of ``max(sizes) - 1`` rows);
    plain per-key windows when no key is hot."""
    if not force and not key_is_hot(df, keys):
        return rolling_mean(df, keys, order, cols, sizes)
    k = max(sizes) - 1
    h = with_halo(df, keys, order, bucket, max(k, 1))
    w = Window.partitionBy(*_cols(keys), "_b").orderBy(*_cols(order))
    for c in cols:
        for s in sizes:
            h = h.withColumn(f"{c}_roll{s}", F.avg(c).over(w.rowsBetween(-(s - 1), 0)))
    return h.where(~F.col("_halo")).drop("_halo", "_b")


def _ffill_across_buckets(df: DataFrame, keys, order, cols: Sequence[str]) -> DataFrame:
    """Forward-fill nulls with the previous non-null value in key order over
    ``_b`` buckets: running last(ignorenulls) inside the bucket, else the
    last non-null of earlier buckets (per-bucket table, bounded)."""
    ks, os_ = _cols(keys), _cols(order)
    fwd = Window.partitionBy(*ks, "_b").orderBy(*os_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = df.groupBy(*ks, "_b").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*os_))).alias(f"_l_{c}") for c in cols])
    pb = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prv = lasts.select(*ks, "_b", *[F.last(f"_l_{c}", ignorenulls=True).over(pb).alias(f"_p_{c}") for c in cols])
    out = df.join(prv, [*ks, "_b"], "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(fwd), F.col(f"_p_{c}")))
    return out.drop(*[f"_p_{c}" for c in cols])


def fill_gaps_bucketed(df: DataFrame, keys, order, cols: Sequence[str], bucket: Column,
                       force: bool = False) -> DataFrame:
    """Forward then backward fill per ordered series, per (key, bucket);
    plain per-key windows when no key is hot."""
    if not force and not key_is_hot(df, keys):
        from .clean import fill_gaps
        return fill_gaps(df, keys, order, cols)
    x = df.withColumn("_b", bucket)
    x = _ffill_across_buckets(x, keys, order, cols)
    x = _bfill_across_buckets(x, keys, order, cols)
    return x.drop("_b")


def windowed_with_halo(df: DataFrame, keys, order, bucket: Column | None, k: int, build,
                       force: bool = False) -> DataFrame:
    """Apply ``build(frame, window) -> frame`` with a key-ordered window;
    with a ``bucket`` and a hot key the window is per (key, bucket) over a
    ``k``-row halo and the halo rows are dropped afterwards."""
    if bucket is None or (not force and not key_is_hot(df, keys)):
        return build(df, _w(keys, order))
    h = with_halo(df, keys, order, bucket, k)
    out = build(h, Window.partitionBy(*_cols(keys), "_b").orderBy(*_cols(order)))
    return out.where(~F.col("_halo")).drop("_halo", "_b")
