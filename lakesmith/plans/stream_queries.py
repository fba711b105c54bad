"""Registered streaming queries in batch form (ST). The streaming forms of
the same operators are checked against these in tests (stream = batch)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import rules as Q
from ..session import scratch_root
from ..sources.tables import table
from ..streaming import sinks as K
from ..streaming import stateful as X
from ..streaming import windows as S
from .registry import register


@register("st_01", """
select date_trunc('minute', ts) as window_start, date_trunc('minute', ts) + interval 1 minute as window_end,
  user_id, event_type, count(*) as event_count
from events group by 1, 2, 3, 4""")
def q_st_01(spark, d):
    return S.tumbling_counts(table(spark, d, "events"), ts="ts", watermark=None)


@register("st_02", """
with k as (select unnest([0, 1, 2, 3, 4]) as k)
select date_trunc('minute', ts) - k * interval 1 minute as window_start,
  date_trunc('minute', ts) - k * interval 1 minute + interval 5 minute as window_end,
  event_type, count(*) as count
from events, k group by 1, 2, 3""")
def q_st_02(spark, d):
    return S.sliding_counts(table(spark, d, "events"), ts="ts", watermark=None)


@register("st_03", """
with x as (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events),
y as (select *, sum(case when prev is null or ts - prev > interval 30 minute then 1 else 0 end)
  over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as sn from x)
select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as event_count,
  round(sum(value), 6) as total_value
from y group by user_id, sn""")
def q_st_03(spark, d):
    s = S.sessionize(table(spark, d, "events"), gap_seconds=1800)
    return s.select("user_id", "session_start", "session_end", "event_count",
                    F.round("total_value", 6).alias("total_value"))


ARRIVAL_SQL = "((event_id * 7919) % 100003) * 10000000 + event_id"


@register("st_04", f"""
with a as (select event_id, ts, {ARRIVAL_SQL} as arrival from events),
w as (select event_id, ts, max(ts) over (order by arrival rows between unbounded preceding and 1 preceding)
  - interval 10 minute as watermark from a)
select event_id, watermark, coalesce(ts < watermark, false) as is_late from w""")
def q_st_04(spark, d):
    ev = table(spark, d, "events").withColumn(
        "arrival", (F.col("event_id") * 7919) % 100003 * 10000000 + F.col("event_id"))
    return S.late_rows(ev, "ts", "arrival", 600).select("event_id", "watermark", "is_late")


def _scratch(spark, name):
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _events_stream(spark, d):
    """The events file as a stream (file sources take a directory or glob)."""
    ev = table(spark, d, "events")
    return spark.readStream.schema(ev.schema).parquet(f"{d.rstrip('/')}/events*.parquet")


@register("st_06", "select distinct event_id, user_id, ts, value from events")
def q_st_06(spark, d):
    """Every event arrives twice; the stream keeps one of each."""
    twice = S.event_time(_events_stream(spark, d).unionByName(_events_stream(spark, d)))
    out, ckpt = _scratch(spark, "dedupe"), _scratch(spark, "dedupe-ckpt")
    X.run_available(S.stream_dedupe(twice).select("event_id", "user_id", "ts", "value"), out, ckpt)
    return spark.read.parquet(out)


# ------------------------------------------------------- keyed state with timers

# A run is a quarter of the month; every tenth event arrives one run late.
RUN_SQL = "cast(least((day(ts) - 1) // 8, 3) + case when event_id % 10 = 0 then 1 else 0 end as int)"


@register("st_03_timeout", f"""
with a as (select *, {RUN_SQL} as run from events),
m as (select run, max(ts) as top from a group by run),
w as (select run, max(top) over (order by run rows between unbounded preceding and 1 preceding) - interval 10 minute as wm from m),
k as (select a.* from a join w using (run) where wm is null or ts >= wm),
x as (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from k),
y as (select *, sum(case when prev is null or ts - prev > interval 30 minute then 1 else 0 end)
  over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as sn from x),
s as (select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as event_count,
  round(sum(value), 6) as total_value from y group by user_id, sn)
select * from s where session_end < (select max(ts) - interval 10 minute from events)""")
def q_st_03_timeout(spark, d):
    """Sessions emitted by their timers, in append mode: the events arrive
    in five runs, late ones are dropped by the watermark, and sessions that
    are still open at the end are not in the result."""
    ev = table(spark, d, "events").withColumn(
        "run", F.expr("cast(least((day(ts) - 1) div 8, 3) + if(event_id % 10 = 0, 1, 0) as int)"))
    src, out, ckpt = (_scratch(spark, n) for n in ("arrivals", "sessions", "sessions-ckpt"))
    with X.with_state_store(spark):
        for run in range(5):
            ev.where(F.col("run") == run).drop("run").write.mode("append").parquet(src)
            stream = spark.readStream.schema(ev.drop("run").schema).parquet(src)
            X.run_available(X.sessions_on_timeout(S.event_time(stream)), out, ckpt)
    return spark.read.parquet(out).withColumn("total_value", F.round("total_value", 6))


@register("st_08_retry", """
with c as (select c_custkey, c_custkey % 6 as m, c_acctbal < 0 as bad, r from customer, range(4) t(r))
select c_custkey, cast(timestamp '2024-01-01' + r * interval 1 day as timestamp) as arrived,
  cast(case when not bad or m = 0 then 0 when r < m then r + 1 when r = m then m else 0 end as int) as attempt,
  case when not bad or r > m or m = 0 then 'passed' when r = m then 'released' when r = 2 then 'dead' else 'retry' end as status,
  case when bad and r < m then 'value_range:c_acctbal' else '' end as failed_rules
from c where not (bad and m > 3 and r = 3)""")
def q_st_08_retry(spark, d):
    """Customers arrive four times; one with a negative balance is mended
    after ``c_custkey % 6`` arrivals. The third failed attempt is the last."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    rule = Q.RowRule("value_range", "c_acctbal", F.col("c_acctbal") < 0, applies=F.col("c_acctbal").isNotNull())
    src, out, ckpt = (_scratch(spark, n) for n in ("arrivals", "retries", "retries-ckpt"))
    arrivals = c.withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    with X.with_state_store(spark):
        for r in range(4):
            now = F.when((F.col("c_acctbal") < 0) & (F.col("c_custkey") % 6 <= r), F.lit(0.0)).otherwise(F.col("c_acctbal"))
            (arrivals.select("c_custkey", now.cast(arrivals.schema["c_acctbal"].dataType).alias("c_acctbal"),
                             (F.col("event_time") + F.make_dt_interval(F.lit(r))).alias("event_time"))
             .write.mode("append").parquet(src))
            stream = spark.readStream.schema(arrivals.schema).parquet(src)
            X.run_available(X.quarantine_with_retries(stream, [rule], "c_custkey"), out, ckpt)
    return spark.read.parquet(out)


# ---------------------------------------------------------------- sinks driven batch by batch


@register("st_05", "select event_id, user_id, event_type, value from events")
def q_st_05(spark, d):
    """Idempotent micro-batch upsert: events arrive in two batches, the
    second batch is replayed; the table holds every event once."""
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    root = _scratch(spark, "upsert")
    fn = K.upsert_batch_fn(root, "event_id")
    fn(ev.where(F.col("ts") < cut).drop("ts"), 0)
    fn(ev.where(F.col("ts") >= cut).drop("ts"), 1)
    fn(ev.where(F.col("ts") >= cut).drop("ts"), 1)          # replay after a restart
    return K.VersionedTable(spark, root).read().select("event_id", "user_id", "event_type", "value")


@register("st_07", """
with t as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where false),
c as (select 'c' as op, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate as change_ts
        from orders where o_orderdate >= timestamp '1998-01-01'
      union all select 'u', o_orderkey, o_custkey, o_orderstatus, o_totalprice * 1.1, timestamp '2002-01-01'
        from orders where o_orderstatus = 'P'
      union all select 'd', o_orderkey, o_custkey, o_orderstatus, o_totalprice, timestamp '2002-01-02'
        from orders where o_orderpriority = '5-LOW' and o_orderstatus = 'F'),
l as (select * from (select *, row_number() over (partition by o_orderkey order by change_ts desc) as rn from c)
      where rn = 1)
select o_orderkey, o_custkey, o_orderstatus, o_totalprice from l where op in ('c', 'r', 'u')""")
def q_st_07(spark, d):
    """Streaming CDC to a table: the change events of WH-11 arrive in two
    micro-batches (creates, then updates and deletes)."""
    from .warehouse_queries import CDC_COLS, cdc_changes
    ch = cdc_changes(spark, d)
    root = _scratch(spark, "cdc")
    fn = K.cdc_batch_fn(root, "o_orderkey", "change_ts", CDC_COLS)
    fn(ch.where(F.col("op") == "c"), 0)
    fn(ch.where(F.col("op") != "c"), 1)
    return K.VersionedTable(spark, root).read().select(*CDC_COLS)


@register("st_08", """
select c_custkey, case when c_custkey % 7 = 0 or c_acctbal < 0 then true else false end as quarantined
from customer""")
def q_st_08(spark, d):
    """Streaming quarantine: each micro-batch is split into good rows and
    quarantined rows with their failed rules (two sinks)."""
    c = table(spark, d, "customer")
    seeded = c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_name")).alias("c_name"),
                      "c_acctbal")
    rules = [Q.not_null_rule("c_name"),
             Q.RowRule("value_range", "c_acctbal", F.col("c_acctbal") < 0, applies=F.col("c_acctbal").isNotNull())]
    good, bad = _scratch(spark, "good"), _scratch(spark, "bad")
    fn = K.quarantine_batch_fn(good, bad, rules)
    fn(seeded.where(F.col("c_custkey") < 750), 0)
    fn(seeded.where(F.col("c_custkey") >= 750), 1)
    g = spark.read.parquet(good).select("c_custkey", F.lit(False).alias("quarantined"))
    b = spark.read.parquet(bad).select("c_custkey", F.lit(True).alias("quarantined"))
    return g.unionByName(b)


@register("st_09", "select user_id, event_type, count(*) as event_count from events group by 1, 2")
def q_st_09(spark, d):
    """Lambda views: batch view before the cut, speed layer streamed from
    the cut on (file stream, availableNow), served together."""
    ev = table(spark, d, "events")
    root, ckpt = _scratch(spark, "lambda"), _scratch(spark, "lambda-ckpt")
    stream = _events_stream(spark, d)
    q = K.start_lambda_views(stream, ev, root, ckpt, "2024-01-20")
    q.awaitTermination()
    return K.serve_views(spark, root)
