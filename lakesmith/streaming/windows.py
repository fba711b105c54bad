"""Event-time windows, sessions, late data and dedupe.

Each operator works on a streaming DataFrame (watermarked, stateful) and
has a batch twin with identical results for closed windows, which is what
the SQL oracle checks. ``withWatermark`` rejects TIMESTAMP_NTZ, so event
time is cast to TIMESTAMP first (:func:`event_time`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros_between


def event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    """TIMESTAMP view of an event-time column (NTZ cast in the session
    zone; run sessions in UTC so wall clock = instant)."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def _window_cols(w: str = "window") -> list[Column]:
    return [F.col(f"{w}.start").cast("timestamp_ntz").alias("window_start"),
            F.col(f"{w}.end").cast("timestamp_ntz").alias("window_end")]


# ------------------------------------------------------------------ ST-01

def tumbling_counts(stream: DataFrame, ts: str = "event_time", size: str = "1 minute",
                    watermark: str | None = "5 minutes", keys=("user_id", "event_type")) -> DataFrame:
    """Count per tumbling window and keys; with a watermark, state of
    windows older than the watermark is dropped (update/append modes)."""
    s = stream.withWatermark(ts, watermark) if watermark else stream
    g = s.groupBy(F.window(ts, size).alias("window"), *keys).agg(F.count(F.lit(1)).alias("event_count"))
    return g.select(*_window_cols(), *keys, "event_count")


# ------------------------------------------------------------------ ST-02

def sliding_counts(stream: DataFrame, ts: str = "event_time", size: str = "5 minutes",
                   slide: str = "1 minute", watermark: str | None = "10 minutes",
                   keys=("event_type",)) -> DataFrame:
    """Count per sliding window (each event lands in size/slide windows)."""
    s = stream.withWatermark(ts, watermark) if watermark else stream
    g = s.groupBy(F.window(ts, size, slide).alias("window"), *keys).agg(F.count(F.lit(1)).alias("count"))
    return g.select(*_window_cols(), *keys, "count")


# ------------------------------------------------------------------ ST-03

def sessionize_stream(stream: DataFrame, ts: str = "event_time", key: str = "user_id",
                      gap: str = "30 minutes", watermark: str | None = "30 minutes",
                      value: str = "value") -> DataFrame:
    """Streaming sessions: ``session_window``; a session is emitted once the
    watermark passes its end (append mode)."""
    s = stream.withWatermark(ts, watermark) if watermark else stream
    g = s.groupBy(key, F.session_window(ts, gap).alias("session")).agg(
        F.count(F.lit(1)).alias("event_count"), F.sum(value).alias("total_value"))
    return g.select(key, F.col("session.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("session.end").cast("timestamp_ntz").alias("session_end"),
                    "event_count", "total_value")


def sessionize(df: DataFrame, ts: str = "ts", key: str = "user_id", gap_seconds: int = 1800,
               value: str = "value", bucket: str = "1 hour", tiebreak: str | None = "event_id",
               force_buckets: bool = False) -> DataFrame:
    """Batch sessions, exact, without sorting any user's whole history in
    one task: events are cut into (key, time bucket) groups; each group is
    sorted on its own, the previous event of a group's first row comes from
    the per-bucket maxima (one row per key and bucket), and session numbers
    are a per-bucket count plus an offset from earlier buckets. A gap of
    exactly ``gap_seconds`` continues the session (as ``session_window``)."""
    from ..operators.relational import key_is_hot
    order = [ts] + ([tiebreak] if tiebreak else [])
    gap = F.lit(gap_seconds * 1_000_000)
    if not force_buckets and not key_is_hot(df, key):
        # no hot key: one sort per user, lag and running count in one pass
        w = Window.partitionBy(key).orderBy(*order)
        prev = F.lag(ts).over(w)
        x = (df.withColumn("_start", prev.isNull() | (micros_between(prev, F.col(ts)) > gap))
             .withColumn("session_no", F.sum(F.col("_start").cast("int")).over(
                 w.rowsBetween(Window.unboundedPreceding, 0))))
        return _session_rows(x, key, ts, value, gap_seconds)
    b = df.withColumn("_b", F.date_trunc(_unit(bucket), F.col(ts)))
    wb = Window.partitionBy(key, "_b").orderBy(*order)
    per_bucket = b.groupBy(key, "_b").agg(F.max(ts).alias("_bmax"))
    wk = Window.partitionBy(key).orderBy("_b")       # one row per key and bucket
    per_bucket = per_bucket.withColumn("_prev_max", F.lag("_bmax").over(wk))
    x = (b.join(per_bucket.select(key, "_b", "_prev_max"), [key, "_b"])
         .withColumn("_prev", F.coalesce(F.lag(ts).over(wb), F.col("_prev_max"))))
    secs = micros_between(F.col("_prev"), F.col(ts))
    x = x.withColumn("_start", F.col("_prev").isNull() | (secs > gap))
    starts = x.groupBy(key, "_b").agg(F.count_if("_start").alias("_n_starts"))
    starts = starts.withColumn("_off", F.coalesce(F.sum("_n_starts").over(
        wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = (x.join(starts.select(key, "_b", "_off"), [key, "_b"])
         .withColumn("session_no", F.col("_off") + F.sum(F.col("_start").cast("int")).over(
             wb.rowsBetween(Window.unboundedPreceding, 0))))
    return _session_rows(x, key, ts, value, gap_seconds)


def _session_rows(x: DataFrame, key: str, ts: str, value: str, gap_seconds: int) -> DataFrame:
    return (x.groupBy(key, "session_no")
            .agg(F.min(ts).alias("session_start"),
                 (F.max(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(gap_seconds)))
                 .alias("session_end"),
                 F.count(F.lit(1)).alias("event_count"), F.sum(value).alias("total_value")))


def _unit(bucket: str) -> str:
    return {"1 hour": "hour", "1 day": "day", "1 minute": "minute"}.get(bucket, "hour")


# ------------------------------------------------------------------ ST-04

def late_rows(df: DataFrame, ts: str, arrival: str, threshold_seconds: int,
              n_buckets: int | None = None) -> DataFrame:
    """Rows that arrive after the watermark passed them: watermark = max
    event time of all rows that arrived earlier, minus the threshold.

    The running maximum over arrival order is computed without a global
    sort: arrival order is cut into range buckets, each bucket's maximum
    is taken (one row per bucket), the maximum of earlier buckets is a
    window over those few rows, and inside a bucket a running maximum."""
    n_buckets = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = sorted(set(df.agg(F.percentile_approx(arrival, probs, 10_000)).collect()[0][0] or []))
    arr = F.array(*[F.lit(v) for v in bounds]) if bounds else F.array().cast("array<long>")
    b = df.withColumn("_bk", F.size(F.filter(arr, lambda v: v < F.col(arrival))))
    per = b.groupBy("_bk").agg(F.max(ts).alias("_m"))
    per = per.withColumn("_before", F.max("_m").over(
        Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)))  # <= n_buckets rows
    w = Window.partitionBy("_bk").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    x = (b.join(F.broadcast(per.select("_bk", "_before")), "_bk")
         .withColumn("_seen", F.greatest(F.max(ts).over(w), F.col("_before"))))
    wm = F.col("_seen") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(threshold_seconds))
    return (x.withColumn("watermark", wm)
            .withColumn("is_late", F.coalesce(F.col(ts) < wm, F.lit(False)))
            .drop("_bk", "_before", "_seen"))


# ------------------------------------------------------------------ ST-06

def stream_dedupe(stream: DataFrame, key: str = "event_id", ts: str = "event_time",
                  watermark: str = "10 minutes") -> DataFrame:
    """Drop repeated keys seen within the watermark delay (bounded state)."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def dropped_by_watermark(query) -> int:
    """ST-04 for a running stream: rows its stateful operators dropped as
    later than the watermark, summed over the recent progress reports."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators") or []:
            total += int(op.get("numRowsDroppedByWatermark", 0))
    return total
