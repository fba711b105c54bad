"""Registered queries for joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import relational as R
from ..sources.tables import table
from .registry import register

ALLOWED_SILVER = ["click", "view", "purchase"]


def silver_events(spark, d):
    """Bronze events -> silver: required user, allowed types, dedupe by id,
    session = hour of the event."""
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    s = C.silver_filter(ev, ["user_id"], {"event_type": ALLOWED_SILVER})
    # one row per event id, chosen deterministically (a retried task picks the same row)
    s = R.latest_per_key(s, "event_id", ["ts"])
    return s.withColumn("session_id", F.date_trunc("hour", "ts"))


# ---- AG-02 (flagship) -------------------------------------------------------------
@register("ag_02", """
select user_id, cast(ts as date) as event_date, count(*) as total_events,
       count(distinct date_trunc('hour', ts)) as sessions,
       round(sum(case when event_type = 'purchase' then value else 0 end), 6) as revenue,
       max(ts) as last_activity
from (select distinct on (event_id) * from events
      where user_id is not null and event_type in ('click', 'view', 'purchase'))
group by 1, 2""")
def q_ag_02(spark, d):
    g = R.daily_user_metrics(silver_events(spark, d))
    return g.withColumn("revenue", F.round("revenue", 6))


@register("ag_01", """
select user_id, event_type, cast(ts as date) as event_date, count(*) as event_count,
  round(sum(value), 6) as total_revenue, max(ts) as last_event
from events group by 1, 2, 3""")
def q_ag_01(spark, d):
    g = R.daily_user_events(table(spark, d, "events"))
    return g.withColumn("total_revenue", F.round("total_revenue", 6))


@register("ag_03", """select cast(p_name as varchar) as value, count(*) as count from part
group by 1 order by count desc, value asc limit 10""")
def q_ag_03(spark, d):
    return R.value_counts(table(spark, d, "part"), "p_name", 10)


SEEDED_CUSTOMER_SQL = """(select c_custkey, c_nationkey,
  case when c_custkey % 7 = 0 then null else c_acctbal end as c_acctbal,
  case when c_custkey % 3 <> 0 then null else c_name end as c_name,
  case when c_custkey % 2 = 0 then null else c_mktsegment end as c_mktsegment
  from customer)"""


def seeded_customer(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", "c_nationkey",
                    F.when(k % 7 == 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(k % 3 != 0, None).otherwise(F.col("c_name")).alias("c_name"),
                    F.when(k % 2 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


@register("ag_04", f"""
with s as {SEEDED_CUSTOMER_SQL}, z as (
  select 'c_custkey' as column_name, count(*) filter (where c_custkey is null) as null_count, count(*) as total from s
  union all select 'c_nationkey', count(*) filter (where c_nationkey is null), count(*) from s
  union all select 'c_acctbal', count(*) filter (where c_acctbal is null), count(*) from s
  union all select 'c_name', count(*) filter (where c_name is null), count(*) from s
  union all select 'c_mktsegment', count(*) filter (where c_mktsegment is null), count(*) from s)
select column_name, null_count, total,
  round(case when total = 0 then 0 else null_count * 100.0 / total end, 6) as null_pct,
  null_count > total * 0.5 as over_threshold
from z""")
def q_ag_04(spark, d):
    return R.null_summary(seeded_customer(spark, d))


@register("ag_05", """
select o_orderpriority, count(o_totalprice) as n, round(avg(o_totalprice), 6) as mean,
  min(o_totalprice) as min, max(o_totalprice) as max,
  round(quantile_cont(o_totalprice, 0.25), 6) as p25, round(quantile_cont(o_totalprice, 0.5), 6) as median,
  round(quantile_cont(o_totalprice, 0.75), 6) as p75
from orders group by 1""")
def q_ag_05(spark, d):
    g = R.group_stats(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    for c in ("mean", "p25", "median", "p75"):
        g = g.withColumn(c, F.round(c, 6))
    return g


def usage_log(spark, d):
    """Events read as a statement log: statement = type and user bucket,
    bytes = value x 1e9, credits = value / 100."""
    ev = table(spark, d, "events")
    return ev.select(F.concat("event_type", F.lit("#"), (F.col("user_id") % 20).cast("string"))
                     .alias("query_text"),
                     (F.col("value") * 1e9).alias("bytes_scanned"),
                     (F.col("value") / 100).alias("credits_used"),
                     F.col("ts").alias("start_time"))


USAGE_LOG_SQL = """(select event_type || '#' || cast(user_id % 20 as varchar) as query_text,
  value * 1e9 as bytes_scanned, value / 100 as credits_used, ts as start_time from events)"""

AS_OF = "2024-01-31 00:00:00"


@register("ag_06", f"""
select query_text, count(*) as execution_count, round(avg(bytes_scanned), 6) as avg_bytes,
  round(sum(credits_used), 6) as total_credits, round(sum(credits_used) * 0.7, 6) as potential_savings
from {USAGE_LOG_SQL}
where bytes_scanned > 1e10 and start_time > timestamp '{AS_OF}' - interval 7 day
group by 1 having count(*) > 10""")
def q_ag_06(spark, d):
    h = R.usage_heavy_hitters(usage_log(spark, d), AS_OF)
    for c in ("avg_bytes", "total_credits", "potential_savings"):
        h = h.withColumn(c, F.round(c, 6))
    return h


def metering(spark, d):
    """Events read as warehouse metering: warehouse = event type, size from
    the user, running queries = value / 60, credits = value."""
    ev = table(spark, d, "events")
    sizes = F.array(*[F.lit(s) for s in ("X-Small", "Small", "Medium", "Large")])
    return ev.select(F.col("event_type").alias("warehouse_name"),
                     F.element_at(sizes, (F.col("user_id") % 4 + 1).cast("int")).alias("warehouse_size"),
                     (F.col("value") / 60).alias("avg_running_queries"),
                     F.col("value").alias("credits_used"), F.col("ts").alias("start_time"))


METERING_SQL = """(select event_type as warehouse_name,
  ['X-Small', 'Small', 'Medium', 'Large'][cast(user_id % 4 + 1 as integer)] as warehouse_size,
  value / 60 as avg_running_queries, value as credits_used, ts as start_time from events)"""

IDLE_SQL = f"""(select warehouse_name, warehouse_size, avg(avg_running_queries) as avg_queries,
  avg(credits_used) as avg_credits, avg(credits_used) * 7 as current_cost,
  avg(credits_used) * 7 * 0.5 as potential_savings
from {METERING_SQL} where start_time > timestamp '{AS_OF}' - interval 7 day
group by 1, 2 having avg(avg_running_queries) < 1 and warehouse_size not in ('X-Small', 'Small'))"""


@register("ag_08", f"""select warehouse_name, warehouse_size, round(avg_queries, 6) as avg_queries,
  round(avg_credits, 6) as avg_credits, round(current_cost, 6) as current_cost,
  round(potential_savings, 6) as potential_savings from {IDLE_SQL}""")
def q_ag_08(spark, d):
    r = R.idle_compute(metering(spark, d), AS_OF)
    for c in ("avg_queries", "avg_credits", "current_cost", "potential_savings"):
        r = r.withColumn(c, F.round(c, 6))
    return r


@register("ag_09", f"""
with f as (
  select 'query' as category, sum(credits_used) as current_cost, sum(credits_used) * 0.7 as potential_savings
  from {USAGE_LOG_SQL} where bytes_scanned > 1e10 and start_time > timestamp '{AS_OF}' - interval 7 day
  group by query_text having count(*) > 10
  union all select 'compute', current_cost, potential_savings from {IDLE_SQL})
select round(sum(current_cost), 6) as total_current_cost,
  round(sum(potential_savings), 6) as total_potential_savings, count(*) as recommendations,
  round(case when sum(current_cost) = 0 then 0 else sum(potential_savings) * 100 / sum(current_cost) end, 6)
    as savings_percentage
from f""")
def q_ag_09(spark, d):
    q = R.usage_heavy_hitters(usage_log(spark, d), AS_OF).select(
        F.lit("query").alias("category"), F.col("total_credits").alias("current_cost"),
        "potential_savings")
    c = R.idle_compute(metering(spark, d), AS_OF).select(
        F.lit("compute").alias("category"), "current_cost", "potential_savings")
    s = R.saving_summary(q.unionByName(c))
    for col in ("total_current_cost", "total_potential_savings", "savings_percentage"):
        s = s.withColumn(col, F.round(col, 6))
    return s


def run_log(spark, d):
    """Events read as a pipeline run log."""
    ev = table(spark, d, "events")
    return ev.select(F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("pipeline"),
                     "ts",
                     F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"),
                     (F.col("value") * 100).alias("duration_s"),
                     F.col("value").cast("long").alias("rows"),
                     (1 - F.col("value") / 1000).alias("quality_score"))


ALERT_AS_OF = "2024-01-30 12:00:00"


@register("ag_10", f"""
with r as (select 'p' || cast(user_id % 5 as varchar) as pipeline, ts,
    case when event_type = 'error' then 'failure' else 'success' end as status,
    value * 100 as duration_s, cast(trunc(value) as bigint) as rows, 1 - value / 1000 as quality_score
  from events where ts <= timestamp '{ALERT_AS_OF}'),
m as (select pipeline,
    max(ts) filter (where status = 'success') as last_success,
    arg_max(quality_score, ts) as latest_quality,
    count(*) filter (where status = 'failure' and ts > timestamp '{ALERT_AS_OF}' - interval 1 hour) as failures_1h,
    quantile_cont(duration_s, 0.95) filter (where ts > timestamp '{ALERT_AS_OF}' - interval 1 hour) as p95_1h,
    sum(case when ts > timestamp '{ALERT_AS_OF}' - interval 1 day then rows else 0 end) as rows_24h
  from r group by 1),
a as (
  select pipeline, 'DataFreshnessAlert' as alert, 'critical' as severity,
    date_diff('microsecond', last_success, timestamp '{ALERT_AS_OF}') / 3.6e9 as value
    from m where last_success is null or date_diff('microsecond', last_success, timestamp '{ALERT_AS_OF}') / 3.6e9 > 24
  union all select pipeline, 'DataQualityDegraded', 'warning', latest_quality from m where latest_quality < 0.95
  union all select pipeline, 'PipelineFailure', 'critical', failures_1h from m where failures_1h > 0
  union all select pipeline, 'PipelineSlowdown', 'warning', p95_1h from m where p95_1h > 3600
  union all select pipeline, 'LowRowCount', 'warning', rows_24h from m where rows_24h < 1000)
select pipeline, alert, severity, round(cast(value as double), 6) as value from a""")
def q_ag_10(spark, d):
    a = R.alerts(run_log(spark, d), ALERT_AS_OF)
    return a.withColumn("value", F.round("value", 6))


# ------------------------------------------------------------------ joins

@register("jn_01", """
select l.l_orderkey, l.l_linenumber, l.l_extendedprice, o.o_orderdate, c.c_name, n.n_name,
  r.r_name, p.p_name, s.s_name
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey join part p on l.l_partkey = p.p_partkey
join supplier s on l.l_suppkey = s.s_suppkey""")
def q_jn_01(spark, d):
    t = lambda n: table(spark, d, n)
    fact = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                "l_extendedprice")
    dims = [
        (t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"),
         "l_orderkey", None),
        (t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"),
         "o_custkey", None),
        (t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"),
         "c_nationkey", None),
        (t("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey", None),
        (t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", None),
        (t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", None),
    ]
    return R.obt(fact, dims).select("l_orderkey", "l_linenumber", "l_extendedprice", "o_orderdate",
                                    "c_name", "n_name", "r_name", "p_name", "s_name")


@register("jn_02", """
select o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_name, c.c_mktsegment
from orders o left join (select * from customer where c_mktsegment <> 'BUILDING') c
  on o.o_custkey = c.c_custkey""")
def q_jn_02(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = (table(spark, d, "customer").where(F.col("c_mktsegment") != "BUILDING")
         .select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"))
    return R.enrich(o, [(c, "o_custkey")])


@register("jn_03", """
select l.l_orderkey, l.l_linenumber, s.s_name, n.n_name
from lineitem l join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey""")
def q_jn_03(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name",
                                           F.col("s_nationkey"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return R.join_small(R.join_small(li, s, "l_suppkey"), n, "s_nationkey") \
        .select("l_orderkey", "l_linenumber", "s_name", "n_name")


@register("jn_04", """
select o.o_orderkey, l.l_linenumber, o.o_orderdate, l.l_quantity
from orders o join lineitem l on o.o_orderkey = l.l_orderkey""")
def q_jn_04(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber",
                                            "l_quantity")
    return R.join_large(o, li, "o_orderkey", int(spark.conf.get("spark.sql.shuffle.partitions")))


HOT_EVENTS_SQL = """(select event_id, ts, case when user_id < 50 then 0 else user_id end as hot_user
  from events)"""


@register("jn_05", f"""
with e as {HOT_EVENTS_SQL},
u as (select hot_user, min(ts) as first_seen, count(*) as n_events from e group by 1)
select e.event_id, e.hot_user, u.first_seen, u.n_events from e join u using (hot_user)""")
def q_jn_05(spark, d):
    ev = table(spark, d, "events")
    e = ev.select("event_id", "ts", F.when(F.col("user_id") < 50, 0)
                  .otherwise(F.col("user_id")).alias("hot_user"))
    users = e.groupBy("hot_user").agg(F.min("ts").alias("first_seen"),
                                      F.count(F.lit(1)).alias("n_events"))
    return R.salted_join(e.select("event_id", "hot_user"), users, "hot_user", salts=8)


@register("jn_06", """
select o_orderkey, o_custkey from orders o
where o_custkey is not null and not exists (
  select 1 from customer c where c.c_mktsegment <> 'BUILDING' and c.c_custkey = o.o_custkey)""")
def q_jn_06(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").where(F.col("c_mktsegment") != "BUILDING")
    return R.orphans(o, "o_custkey", c, "c_custkey")


@register("jn_07", """
select * from customer s where not exists (
  select 1 from customer t where t.c_acctbal > 0 and t.c_custkey is not distinct from s.c_custkey)""")
def q_jn_07(spark, d):
    c = table(spark, d, "customer")
    return R.new_rows(c, c.where(F.col("c_acctbal") > 0), "c_custkey")


@register("jn_08", """
with cur as (select * from customer where c_mktsegment <> 'BUILDING'),
st as (select c_custkey, c_name, c_nationkey,
  case when c_nationkey = 3 then c_acctbal + 1 else c_acctbal end as c_acctbal, c_mktsegment
  from customer)
select st.*, case when cur.c_custkey is null then 'new' else 'changed' end as change_type
from st left join cur on st.c_custkey = cur.c_custkey
where cur.c_custkey is null or st.c_name is distinct from cur.c_name
  or st.c_nationkey is distinct from cur.c_nationkey or st.c_acctbal is distinct from cur.c_acctbal
  or st.c_mktsegment is distinct from cur.c_mktsegment""")
def q_jn_08(spark, d):
    c = table(spark, d, "customer")
    cur = c.where(F.col("c_mktsegment") != "BUILDING")
    st = c.withColumn("c_acctbal", F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 1)
                      .otherwise(F.col("c_acctbal")))
    return R.changed_rows(st, cur, "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@register("jn_09", """
select user_id, event_type, count(*) as event_count, round(sum(value), 6) as total_value,
  max(ts) as last_event
from events group by 1, 2""")
def q_jn_09(spark, d):
    ev = table(spark, d, "events")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")

    def view(df):
        return df.groupBy("user_id", "event_type").agg(
            F.count(F.lit(1)).alias("event_count"), F.sum("value").alias("total_value"),
            F.max("ts").alias("last_event"))
    s = R.serve(view(ev.where(F.col("ts") < cut)), view(ev.where(F.col("ts") >= cut)),
                ["user_id", "event_type"],
                {"event_count": "sum", "total_value": "sum", "last_event": "max"})
    return s.withColumn("total_value", F.round("total_value", 6))


def graph_tables(spark, d):
    """region -> nation -> customer -> orders as a typed property graph."""
    t = lambda n: table(spark, d, n)
    sid = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (t("nation").select(sid("r", "n_regionkey").alias("src"), F.lit("HAS_NATION").alias("type"),
                                sid("n", "n_nationkey").alias("dst"))
             .unionByName(t("customer").select(sid("n", "c_nationkey").alias("src"),
                                               F.lit("HAS_CUSTOMER").alias("type"),
                                               sid("c", "c_custkey").alias("dst")))
             .unionByName(t("orders").select(sid("c", "o_custkey").alias("src"),
                                             F.lit("PLACED").alias("type"),
                                             sid("o", "o_orderkey").alias("dst"))))
    names = (t("region").select(sid("r", "r_regionkey").alias("node_id"), F.col("r_name").alias("name"))
             .unionByName(t("nation").select(sid("n", "n_nationkey").alias("node_id"),
                                             F.col("n_name").alias("name")))
             .unionByName(t("customer").select(sid("c", "c_custkey").alias("node_id"),
                                               F.col("c_name").alias("name")))
             .unionByName(t("orders").select(sid("o", "o_orderkey").alias("node_id"),
                                             F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string"))
                                             .alias("name"))))
    return edges, names


@register("jn_10", """
select distinct 'r' || cast(r.r_regionkey as varchar) as start_id, 1 as level, n.n_name as name
  from region r join nation n on n.n_regionkey = r.r_regionkey
union all
select distinct 'r' || cast(r.r_regionkey as varchar), 2, c.c_name
  from region r join nation n on n.n_regionkey = r.r_regionkey join customer c on c.c_nationkey = n.n_nationkey
union all
select distinct 'r' || cast(r.r_regionkey as varchar), 3, 'Order#' || cast(o.o_orderkey as varchar)
  from region r join nation n on n.n_regionkey = r.r_regionkey join customer c on c.c_nationkey = n.n_nationkey
  join orders o on o.o_custkey = c.c_custkey""")
def q_jn_10(spark, d):
    edges, names = graph_tables(spark, d)
    start = table(spark, d, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start_id"))
    return R.traverse(start, edges, ["HAS_NATION", "HAS_CUSTOMER", "PLACED"], names)


# ---------------------------------------------------------------- windows

@register("wn_01", """
with l as (select event_id, user_id, ts, value,
  lag(value, 1) over (partition by user_id order by ts, event_id) as l1,
  lag(value, 3) over (partition by user_id order by ts, event_id) as l3 from events)
select event_id, user_id, value,
  first_value(l1 ignore nulls) over (partition by user_id order by ts, event_id
    rows between current row and unbounded following) as value_lag1,
  first_value(l3 ignore nulls) over (partition by user_id order by ts, event_id
    rows between current row and unbounded following) as value_lag3
from l""")
def q_wn_01(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    # per (user, day) buckets with a 3-row halo: a hot user is not one task
    return R.lag_features_bucketed(ev, "user_id", ["ts", "event_id"], ["value"],
                                   F.to_date("ts")).drop("ts")


@register("wn_02", """
select event_id, user_id,
  round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) as value_roll3,
  round(avg(value) over (partition by user_id order by ts, event_id rows between 5 preceding and current row), 6) as value_roll6
from events""")
def q_wn_02(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    r = R.rolling_mean_bucketed(ev, "user_id", ["ts", "event_id"], ["value"], F.to_date("ts"))
    return r.select("event_id", "user_id", F.round("value_roll3", 6).alias("value_roll3"),
                    F.round("value_roll6", 6).alias("value_roll6"))


def monthly_totals(spark, d):
    o = table(spark, d, "orders")
    return (o.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
                      .alias("month"))
            .agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders")))


MONTHLY_SQL = """(select o_orderpriority, date_trunc('month', o_orderdate) as month,
  sum(o_totalprice) as total, count(*) as n_orders from orders group by 1, 2)"""


@register("wn_03", f"""
with m as {MONTHLY_SQL},
x as (select *, count(*) over (partition by o_orderpriority) as n,
  min(total) over (partition by o_orderpriority) as mn,
  lag(total, 12) over (partition by o_orderpriority order by month) as l12,
  lag(total, 1) over (partition by o_orderpriority order by month) as l1 from m)
select o_orderpriority, month, round(total, 6) as total,
  round(coalesce(case when mn > 0 then ln(total) - ln(case when n >= 24 then l12 else l1 end)
    else total - case when n >= 24 then l12 else l1 end end, 0), 6) as total_diff
from x""")
def q_wn_03(spark, d):
    m = monthly_totals(spark, d).drop("n_orders")
    r = R.log_diff(m, "o_orderpriority", "month", "total")
    return r.select("o_orderpriority", "month", F.round("total", 6).alias("total"),
                    F.round("total_diff", 6).alias("total_diff"))


@register("wn_04", """
with s as (select stddev_samp(value) as sd from events),
j as (select event_id, user_id, value,
  abs(value - lag(value) over (partition by user_id order by ts, event_id)) as jump from events)
select event_id, user_id, value, round(jump, 6) as jump from j, s where jump > 3 * s.sd""")
def q_wn_04(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    sd = ev.agg(F.stddev_samp("value")).collect()[0][0]
    r = R.sudden_changes(ev, "user_id", ["ts", "event_id"], "value", sd, bucket=F.to_date("ts"))
    return r.select("event_id", "user_id", "value", F.round("jump", 6).alias("jump"))


@register("wn_05", f"""
with m as {MONTHLY_SQL},
t as (select *, row_number() over (partition by o_orderpriority order by month) as i,
  count(*) over (partition by o_orderpriority) as n from m),
g as (select o_orderpriority,
  avg(total) filter (where i <= floor(n / 2)) as first_half_mean,
  avg(total) filter (where i > floor(n / 2)) as second_half_mean,
  avg(total) as mean, stddev_samp(total) as std,
  arg_min(total, i) as start_value, arg_max(total, i) as end_value from t group by 1),
r as (select *, case when first_half_mean is null or first_half_mean = 0 then 0
    else (second_half_mean - first_half_mean) / abs(first_half_mean) end as ratio,
  case when mean is null or mean = 0 then 0 else std / abs(mean) end as cv from g)
select o_orderpriority, round(first_half_mean, 6) as first_half_mean,
  round(second_half_mean, 6) as second_half_mean, round(mean, 6) as mean, round(std, 6) as std,
  round(start_value, 6) as start_value, round(end_value, 6) as end_value,
  case when ratio > 0.1 then 'upward' when ratio < -0.1 then 'downward' else 'flat' end as trend,
  case when cv > 0.5 then 'high' when cv > 0.2 then 'moderate' else 'low' end as volatility,
  round(case when start_value = 0 then 0 else (end_value - start_value) * 100 / abs(start_value) end, 6)
    as change_pct
from r""")
def q_wn_05(spark, d):
    t = R.trend_profile(monthly_totals(spark, d), "o_orderpriority", "month", "total")
    t = t.withColumnRenamed("first_value", "start_value").withColumnRenamed("last_value", "end_value")
    for c in ("first_half_mean", "second_half_mean", "mean", "std", "start_value", "end_value",
              "change_pct"):
        t = t.withColumn(c, F.round(c, 6))
    return t


@register("wn_07", """
select user_id, event_id, ts, event_type, value, props from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
where rn = 1""")
def q_wn_07(spark, d):
    return R.latest_per_key(table(spark, d, "events"), "user_id", ["ts", "event_id"])


@register("wn_08", """select o_orderkey, o_totalprice, o_orderdate from orders
order by o_totalprice desc, o_orderkey asc limit 20""")
def q_wn_08(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return R.top_k(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


@register("wn_09", """
with p as (select event_id, user_id, ts, value,
  lag(value) over (partition by user_id order by ts, event_id) as pred from events)
select event_id, user_id, round(avg(case when value <> 0 then abs((value - pred) / value) * 100 end)
  over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 6) as rolling_mape
from p""")
def q_wn_09(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    day = F.to_date("ts")
    p = R.windowed_with_halo(ev, "user_id", ["ts", "event_id"], day, 1,
                             lambda x, w: x.withColumn("pred", F.lag("value").over(w)))
    r = R.rolling_mape(p, "user_id", ["ts", "event_id"], "value", "pred", 5, bucket=day)
    return r.select("event_id", "user_id", F.round("rolling_mape", 6).alias("rolling_mape"))


# ------------------------------------------------------------- set operations

@register("set_01", "select * from events")
def q_set_01(spark, d):
    ev = table(spark, d, "events")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    return R.concat(ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut))


@register("set_02", """
select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, null as id,
  cast(null as timestamp) as created_at, cast(null as timestamp) as updated_at
from customer where c_acctbal > 0
union all
select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
  md5(concat_ws('|', coalesce(cast(c_custkey as varchar), chr(0)))) as id,
  timestamp '2024-02-01 00:00:00', timestamp '2024-02-01 00:00:00'
from customer where c_acctbal <= 0""")
def q_set_02(spark, d):
    c = table(spark, d, "customer")
    return R.append_records(c.where(F.col("c_acctbal") > 0), c.where(F.col("c_acctbal") <= 0),
                            ["c_custkey"], "2024-02-01 00:00:00")


@register("set_03", """
select id, text from (
  select *, row_number() over (partition by id order by src) as rn from (
    select item_id as id, text, 0 as src from benchmark
    union all select doc_id, text, 1 from documents))
where rn = 1""")
def q_set_03(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.merge_dedupe([b, docs], "id")


@register("set_04", """
with p as (select c_custkey, null as c_name, c_acctbal * 2 as c_acctbal from customer where c_nationkey = 5)
select c.c_custkey, coalesce(p.c_name, c.c_name) as c_name, c.c_nationkey,
  coalesce(p.c_acctbal, c.c_acctbal) as c_acctbal, c.c_mktsegment
from customer c full outer join p on c.c_custkey = p.c_custkey""")
def q_set_04(spark, d):
    c = table(spark, d, "customer")
    patch = c.where(F.col("c_nationkey") == 5).select(
        "c_custkey", F.lit(None).cast("string").alias("c_name"),
        (F.col("c_acctbal") * 2).alias("c_acctbal"))
    return R.patch_merge(c, patch, "c_custkey")


@register("set_05", """
select * from customer c where not exists (
  select 1 from orders o where o.o_totalprice > 400000 and o.o_custkey = c.c_custkey)""")
def q_set_05(spark, d):
    c = table(spark, d, "customer")
    keys = (table(spark, d, "orders").where(F.col("o_totalprice") > 400000)
            .select(F.col("o_custkey").alias("c_custkey")))
    return R.delete_keys(c, keys, "c_custkey")


def doc_tables(spark, d):
    """Table metadata derived from the documents: one table per source,
    its bytes (characters x 1e6), last access (2024-01-01 minus a thirtieth
    of the mean document length, in days) and a partition column on the
    larger tables (over 125,000 characters)."""
    docs = table(spark, d, "documents")
    g = docs.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.avg("n_chars").alias("mean_chars"))
    return g.select(F.col("source").alias("table_name"), (F.col("chars") * 1e6).alias("bytes"),
                    (F.lit("2024-01-01").cast("timestamp_ntz")
                     - F.make_dt_interval(F.floor(F.col("mean_chars") / 30).cast("int"))).alias("last_accessed"),
                    F.when(F.col("chars") > 125000, F.lit("ds")).alias("partition_column"))


@register("ag_07", """
with t as (select source as table_name, sum(n_chars) * 1e6 as bytes,
    timestamp '2024-01-01' - to_days(cast(floor(avg(n_chars) / 30) as integer)) as last_accessed,
    case when sum(n_chars) > 125000 then 'ds' end as partition_column
  from documents group by 1)
select table_name, 'idle' as finding, round(bytes / 1e9 * 0.023, 6) as current_cost,
  round(bytes / 1e9 * 0.023, 6) as potential_savings
from t where last_accessed < timestamp '2024-02-01' - interval 90 day and bytes > 1e9
union all
select table_name, 'unpartitioned', 0.0, round(bytes / 1e9 * 0.1, 6) from t
where partition_column is null and bytes > 10e9""")
def q_ag_07(spark, d):
    f = R.storage_findings(doc_tables(spark, d), "2024-02-01 00:00:00")
    return f.select("table_name", "finding", F.round("current_cost", 6).alias("current_cost"),
                    F.round("potential_savings", 6).alias("potential_savings"))


@register("ag_06_top", f"""select query_text, bytes_scanned, round(credits_used, 6) as credits_used, start_time
from {USAGE_LOG_SQL} where start_time > timestamp '{AS_OF}' - interval 7 day
order by credits_used desc, start_time, query_text limit 20""")
def q_ag_06_top(spark, d):
    t = R.dearest_statements(usage_log(spark, d), AS_OF, 20)
    return t.withColumn("credits_used", F.round("credits_used", 6))
