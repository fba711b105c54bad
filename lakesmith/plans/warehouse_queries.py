"""Registered warehouse-modelling queries (WH)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import surrogate_key
from ..operators import warehouse as W
from ..session import scratch_root
from ..sources.tables import table
from .registry import register

CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
V1 = "2024-01-01"
V2 = "2024-02-01"


def cust_v1(spark, d):
    return table(spark, d, "customer").where(F.col("c_mktsegment") != "BUILDING").select(*CUST_COLS)


def cust_v2(spark, d):
    c = table(spark, d, "customer")
    return c.withColumn("c_acctbal", F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 1)
                        .otherwise(F.col("c_acctbal"))).select(*CUST_COLS)


V1_SQL = "(select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_mktsegment <> 'BUILDING')"
V2_SQL = """(select c_custkey, c_name, c_nationkey,
  case when c_nationkey = 3 then c_acctbal + 1 else c_acctbal end as c_acctbal, c_mktsegment from customer)"""
DIFF_SQL = " or ".join(f"d.{c} is distinct from s.{c}" for c in CUST_COLS[1:])


@register("wh_01", """
with r as (select cast(min(o_orderdate) as date) as lo, cast(max(o_orderdate) as date) as hi from orders),
g as (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as d from r)
select cast(strftime(d, '%Y%m%d') as integer) as date_key, d as full_date,
  cast(dayofweek(d) as integer) as day_of_week, cast(day(d) as integer) as day_of_month,
  cast(dayofyear(d) as integer) as day_of_year, dayname(d) as day_name, dayofweek(d) in (0, 6) as is_weekend,
  false as is_holiday, cast(week(d) as integer) as week_of_year,
  cast(date_trunc('week', d) as date) as week_start_date,
  cast(date_trunc('week', d) + interval 6 day as date) as week_end_date,
  cast(month(d) as integer) as month_number, monthname(d) as month_name,
  cast(date_trunc('month', d) as date) as month_start_date, last_day(d) as month_end_date,
  cast(quarter(d) as integer) as quarter_number, 'Q' || quarter(d) as quarter_name,
  cast(year(d) as integer) as year_number,
  cast(case when month(d) >= 7 then year(d) + 1 else year(d) end as integer) as fiscal_year,
  cast(case when month(d) >= 7 then ceil((month(d) - 6) / 3.0) else ceil((month(d) + 6) / 3.0) end as integer)
    as fiscal_quarter,
  d = date '1998-06-15' as is_current_day,
  d >= cast(date_trunc('week', date '1998-06-15') as date)
    and d < cast(date_trunc('week', date '1998-06-15') as date) + 7 as is_current_week,
  date_trunc('month', d) = date_trunc('month', date '1998-06-15') as is_current_month,
  date_trunc('quarter', d) = date_trunc('quarter', date '1998-06-15') as is_current_quarter,
  year(d) = year(date '1998-06-15') as is_current_year
from g""")
def q_wh_01(spark, d):
    o = table(spark, d, "orders")
    days = o.agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi")) \
        .select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("d"))
    return W.dim_from_dates(days, "1998-06-15")


def stage_small(spark, d):
    c = table(spark, d, "customer").where(F.col("c_acctbal") < 3000)
    return c.withColumn("c_acctbal", F.col("c_acctbal") + 1).select(*CUST_COLS)


STAGE_SMALL_SQL = """(select c_custkey, c_name, c_nationkey, c_acctbal + 1 as c_acctbal, c_mktsegment
  from customer where c_acctbal < 3000)"""


@register("wh_02", f"""
select 1 as scd_type, coalesce(s.c_custkey, d.c_custkey) as c_custkey,
  {", ".join(f"case when s.c_custkey is not null then s.{c} else d.{c} end as {c}" for c in CUST_COLS[1:])}
from {V1_SQL} d full outer join {STAGE_SMALL_SQL} s on d.c_custkey = s.c_custkey
union all
select 0, coalesce(d.c_custkey, s.c_custkey),
  {", ".join(f"case when d.c_custkey is not null then d.{c} else s.{c} end" for c in CUST_COLS[1:])}
from {V1_SQL} d full outer join {STAGE_SMALL_SQL} s on d.c_custkey = s.c_custkey""")
def q_wh_02(spark, d):
    dim, st = cust_v1(spark, d), stage_small(spark, d)
    one = W.scd1_merge(dim, st, "c_custkey").select(F.lit(1).alias("scd_type"), *CUST_COLS)
    zero = W.scd0_merge(dim, st, "c_custkey").select(F.lit(0).alias("scd_type"), *CUST_COLS)
    return one.unionByName(zero)


SCD2_SQL = f"""(
with d as (select *, date '{V1}' as effective_from, date '9999-12-31' as effective_to, true as is_current
           from {V1_SQL}),
s as {V2_SQL},
j as (select d.*, {", ".join(f"s.{c} as s_{c}" for c in CUST_COLS)},
  (d.c_custkey is not null and s.c_custkey is not null and ({DIFF_SQL})) as changed
  from d full outer join s on d.c_custkey = s.c_custkey)
select {", ".join(CUST_COLS)}, effective_from, effective_to, is_current from j
  where c_custkey is not null and not coalesce(changed, false)
union all
select {", ".join(CUST_COLS)}, effective_from, date '{V2}', false from j where changed
union all
select {", ".join(f"s_{c}" for c in CUST_COLS)}, date '{V2}', date '9999-12-31', true from j
  where changed or c_custkey is null)"""


def scd2_frame(spark, d):
    return W.scd2_merge(W.scd2_init(cust_v1(spark, d), V1), cust_v2(spark, d), "c_custkey",
                        CUST_COLS[1:], V2)


@register("wh_03", f"select * from {SCD2_SQL}")
def q_wh_03(spark, d):
    return scd2_frame(spark, d)


@register("wh_04", f"""
with d as (select *, cast(null as varchar) as previous_c_mktsegment, cast(null as date) as c_mktsegment_changed_at
           from {V1_SQL}),
s as (select c_custkey, case when c_nationkey = 7 then 'AUTOMOBILE' else c_mktsegment end as c_mktsegment
      from customer)
select coalesce(d.c_custkey, s.c_custkey) as c_custkey, d.c_name, d.c_nationkey, d.c_acctbal,
  case when d.c_custkey is null or (s.c_custkey is not null and d.c_mktsegment is distinct from s.c_mktsegment)
    then s.c_mktsegment else d.c_mktsegment end as c_mktsegment,
  case when d.c_custkey is not null and s.c_custkey is not null and d.c_mktsegment is distinct from s.c_mktsegment
    then d.c_mktsegment else d.previous_c_mktsegment end as previous_c_mktsegment,
  case when d.c_custkey is not null and s.c_custkey is not null and d.c_mktsegment is distinct from s.c_mktsegment
    then date '{V2}' else d.c_mktsegment_changed_at end as c_mktsegment_changed_at
from d full outer join s on d.c_custkey = s.c_custkey""")
def q_wh_04(spark, d):
    dim = (cust_v1(spark, d).withColumn("previous_c_mktsegment", F.lit(None).cast("string"))
           .withColumn("c_mktsegment_changed_at", F.lit(None).cast("date")))
    c = table(spark, d, "customer")
    st = c.select("c_custkey", F.when(F.col("c_nationkey") == 7, "AUTOMOBILE")
                  .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return W.scd3_merge(dim, st, "c_custkey", "c_mktsegment", V2)


BAND_SQL = ("case when c_acctbal < 0 then 'negative' when c_acctbal < 3000 then 'low' "
            "when c_acctbal < 7000 then 'mid' else 'high' end")


@register("wh_05", f"""
select c_custkey, c_name, c_nationkey,
  md5(concat_ws('|', coalesce({BAND_SQL}, chr(0)), coalesce(c_mktsegment, chr(0)))) as profile_key
from customer""")
def q_wh_05(spark, d):
    c = table(spark, d, "customer").select(*CUST_COLS)
    band = (F.when(F.col("c_acctbal") < 0, "negative").when(F.col("c_acctbal") < 3000, "low")
            .when(F.col("c_acctbal") < 7000, "mid").otherwise("high"))
    main, _profile = W.scd4_split(c, "c_custkey", {"balance_band": band,
                                                   "segment_band": F.col("c_mktsegment")})
    return main.drop("c_acctbal", "c_mktsegment")


@register("wh_06", f"""
with s as {SCD2_SQL}
select s.c_custkey, s.c_name, s.c_nationkey, s.c_acctbal as historical_c_acctbal, s.c_mktsegment,
  s.effective_from, s.effective_to, s.is_current,
  lag(s.c_acctbal) over (partition by s.c_custkey order by s.effective_from) as previous_c_acctbal,
  c.c_acctbal as current_c_acctbal
from s left join (select c_custkey, c_acctbal from s where is_current) c on s.c_custkey = c.c_custkey""")
def q_wh_06(spark, d):
    return W.scd6_view(scd2_frame(spark, d), "c_custkey", "c_acctbal")


@register("wh_07", f"""
select md5(cast(c_custkey as varchar)) as hub_key, c_custkey, date '{V1}' as load_date, 'crm' as record_source
  from {V1_SQL}
union all
select md5(cast(c_custkey as varchar)), c_custkey, date '{V2}', 'web' from customer
  where c_custkey not in (select c_custkey from {V1_SQL})""")
def q_wh_07(spark, d):
    v1 = cust_v1(spark, d)
    hub = v1.select(F.md5(F.col("c_custkey").cast("string")).alias("hub_key"), "c_custkey",
                    F.lit(V1).cast("date").alias("load_date"), F.lit("crm").alias("record_source"))
    return W.hub_load(hub, table(spark, d, "customer"), "c_custkey", "web", V2)


HASH_SQL = ("md5(concat_ws('|', coalesce(cast({p}c_name as varchar), chr(0)), "
            "coalesce(cast({p}c_acctbal as varchar), chr(0))))")


@register("wh_08", f"""
with sat as (select md5(cast(c_custkey as varchar)) as hub_key, c_name, c_acctbal,
    {HASH_SQL.format(p='')} as hash_diff, date '{V1}' as load_date, cast(null as date) as load_end_date,
    'crm' as record_source from {V1_SQL}),
st as (select md5(cast(c_custkey as varchar)) as hub_key, c_name, c_acctbal, {HASH_SQL.format(p='')} as hash_diff
    from {V2_SQL}),
ch as (select st.*, sat.hash_diff as cur from st left join sat on st.hub_key = sat.hub_key
    where sat.hash_diff is null or sat.hash_diff <> st.hash_diff)
select s.hub_key, s.c_name, s.c_acctbal, s.hash_diff, s.load_date,
  case when s.hub_key in (select hub_key from ch where cur is not null) then date '{V2}' else s.load_end_date end
    as load_end_date, s.record_source from sat s
union all
select hub_key, c_name, c_acctbal, hash_diff, date '{V2}', cast(null as date), 'crm' from ch""")
def q_wh_08(spark, d):
    v1 = cust_v1(spark, d)
    from ..functions.scalars import row_hash
    sat = v1.select(F.md5(F.col("c_custkey").cast("string")).alias("hub_key"), "c_name", "c_acctbal",
                    row_hash("c_name", "c_acctbal").alias("hash_diff"),
                    F.lit(V1).cast("date").alias("load_date"), F.lit(None).cast("date").alias("load_end_date"),
                    F.lit("crm").alias("record_source"))
    return W.sat_load(sat, cust_v2(spark, d), "c_custkey", ["c_name", "c_acctbal"], "crm", V2)


@register("wh_09", f"""
select md5(concat_ws('|', coalesce(cast(o_custkey as varchar), chr(0)), coalesce(cast(o_orderkey as varchar), chr(0))))
  as link_key, o_custkey, o_orderkey, date '{V1}' as load_date, 'erp' as record_source
from orders where o_orderdate < timestamp '1998-01-01'
union all
select md5(concat_ws('|', coalesce(cast(o_custkey as varchar), chr(0)), coalesce(cast(o_orderkey as varchar), chr(0)))),
  o_custkey, o_orderkey, date '{V2}', 'erp' from orders where o_orderdate >= timestamp '1998-01-01'""")
def q_wh_09(spark, d):
    o = table(spark, d, "orders")
    old = o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    link = old.select(surrogate_key("o_custkey", "o_orderkey").alias("link_key"), "o_custkey", "o_orderkey",
                      F.lit(V1).cast("date").alias("load_date"), F.lit("erp").alias("record_source"))
    return W.link_load(link, o, ["o_custkey", "o_orderkey"], "erp", V2)


ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


@register("wh_10", """
with t as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate from orders
           where o_orderdate < timestamp '1999-01-01'),
s as (select o_orderkey, o_custkey, 'F' as o_orderstatus, o_totalprice * 1.01 as o_totalprice, o_orderdate
      from orders where o_orderdate >= timestamp '1998-07-01')
select * from t where o_orderkey not in (select o_orderkey from s)
union all select * from s""")
def q_wh_10(spark, d):
    o = table(spark, d, "orders").select(*ORD_COLS)
    t = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    s = (o.where(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp_ntz"))
         .withColumn("o_orderstatus", F.lit("F")).withColumn("o_totalprice", F.col("o_totalprice") * 1.01))
    return W.merge_upsert(t, s, "o_orderkey", ["o_orderdate"])


CDC_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def cdc_changes(spark, d):
    o = table(spark, d, "orders")
    c = o.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        F.lit("c").alias("op"), *CDC_COLS, F.col("o_orderdate").alias("change_ts"))
    u = o.where(F.col("o_orderstatus") == "P").select(
        F.lit("u").alias("op"), "o_orderkey", "o_custkey", "o_orderstatus",
        (F.col("o_totalprice") * 1.1).alias("o_totalprice"),
        F.lit("2002-01-01").cast("timestamp_ntz").alias("change_ts"))
    dl = o.where((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F")).select(
        F.lit("d").alias("op"), *CDC_COLS, F.lit("2002-01-02").cast("timestamp_ntz").alias("change_ts"))
    return c.unionByName(u).unionByName(dl)


CDC_SQL = """(select 'c' as op, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate as change_ts
    from orders where o_orderdate >= timestamp '1998-01-01'
  union all select 'u', o_orderkey, o_custkey, o_orderstatus, o_totalprice * 1.1, timestamp '2002-01-01'
    from orders where o_orderstatus = 'P'
  union all select 'd', o_orderkey, o_custkey, o_orderstatus, o_totalprice, timestamp '2002-01-02'
    from orders where o_orderpriority = '5-LOW' and o_orderstatus = 'F')"""


@register("wh_11", f"""
with t as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders
           where o_orderdate < timestamp '1998-01-01'),
l as (select * from (select *, row_number() over (partition by o_orderkey order by change_ts desc) as rn
      from {CDC_SQL}) where rn = 1)
select * from t where o_orderkey not in (select o_orderkey from l)
union all select o_orderkey, o_custkey, o_orderstatus, o_totalprice from l where op in ('c', 'r', 'u')""")
def q_wh_11(spark, d):
    o = table(spark, d, "orders")
    t = o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).select(*CDC_COLS)
    return W.apply_cdc(t, cdc_changes(spark, d), "o_orderkey", "change_ts")


def _sk_sql(c):
    return f"md5(concat_ws('|', coalesce(cast({c} as varchar), chr(0))))"


@register("wh_12", f"""
select l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
  {_sk_sql('o.o_custkey')} as customer_sk, {_sk_sql('l.l_partkey')} as part_sk,
  {_sk_sql('l.l_suppkey')} as supplier_sk, cast(strftime(o.o_orderdate, '%Y%m%d') as integer) as o_orderdate_key
from lineitem l join orders o on l.l_orderkey = o.o_orderkey""")
def q_wh_12(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                            "l_quantity", "l_extendedprice")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    fact = li.join(o, "l_orderkey")
    return W.build_star(fact, {"customer_sk": ("customer", ["o_custkey"]),
                               "part_sk": ("part", ["l_partkey"]),
                               "supplier_sk": ("supplier", ["l_suppkey"])}, ["o_orderdate"])


@register("wh_13", """
select user_id, cast(ts as date) as event_date, count(*) as total_events,
       count(distinct date_trunc('hour', ts)) as sessions,
       round(sum(case when event_type = 'purchase' then value else 0 end), 6) as revenue,
       max(ts) as last_activity
from (select distinct on (event_id) * from events
      where user_id is not null and event_type in ('click', 'view', 'purchase'))
group by 1, 2""")
def q_wh_13(spark, d):
    g = W.medallion(table(spark, d, "events"), None, "2024-02-01 00:00:00")
    return g.withColumn("revenue", F.round("revenue", 6))


ADV_COLS = ["l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_orderkey"]
ADV_SIZE = 50 * 1024 ** 3


@register("wh_14", f"""
with s as (select count(*) as n,
  {", ".join(f"count(distinct {c}) as d_{c}, count(*) filter (where {c} is null) as z_{c}" for c in ADV_COLS)}
  from lineitem),
c as (
  select 'l_shipdate' as column_name, 'range' as partition_type, cast(null as integer) as num_partitions,
    {ADV_SIZE} / 365 / 1048576 as partition_size_mb, d_l_shipdate as cardinality from s
    where z_l_shipdate * 100.0 / n <= 20
  {"".join(f'''union all select '{c}', case when d_{c} <= 100 then 'list' else 'hash' end,
    cast(case when d_{c} <= 100 then d_{c} else pow(2, floor(log2(greatest(1, floor({ADV_SIZE} / 134217728))) + 0.5)) end as integer),
    {ADV_SIZE} / (case when d_{c} <= 100 then d_{c} else pow(2, floor(log2(greatest(1, floor({ADV_SIZE} / 134217728))) + 0.5)) end) / 1048576,
    d_{c} from s where z_{c} * 100.0 / n <= 20 and d_{c} > 0 and d_{c} <= 10000
  ''' for c in ADV_COLS if c != "l_shipdate")})
select column_name, partition_type, num_partitions, round(partition_size_mb, 6) as partition_size_mb,
  cast(cardinality as bigint) as cardinality
from c order by partition_size_mb limit 3""")
def q_wh_14(spark, d):
    a = W.partition_advice(table(spark, d, "lineitem").select(*ADV_COLS), ADV_SIZE)
    return a.withColumn("partition_size_mb", F.round("partition_size_mb", 6))


@register("wh_14_sketch", " union all ".join(f"""
select '{c}' as column_name, count(*) as rows, count(*) filter (where {c} is null) as nulls,
  {"'range'" if c == "l_shipdate" else f"case when count(distinct {c}) <= 100 then 'list' when count(distinct {c}) <= 10000 then 'hash' end"}
  as partition_type from lineitem""" for c in ADV_COLS))
def q_wh_14_sketch(spark, d):
    """Advice from sketches that are kept per ship month and merged."""
    path = f"{scratch_root(spark)}/sketches-{uuid.uuid4().hex}"
    li = table(spark, d, "lineitem")
    W.column_sketches(li, ADV_COLS, F.date_format("l_shipdate", "yyyy-MM")).write.parquet(path)
    a = W.sketched_advice(spark.read.parquet(path), ADV_SIZE)
    return a.select("column_name", "rows", "nulls", "partition_type")


@register("wh_15", """
with s as (select user_id, count(*) as c from events group by 1)
select count(*) as groups, max(c) as max_group, min(c) as min_group, median(c) as median_group,
  round(max(c) / median(c), 6) as skew_ratio, max(c) / median(c) > 5 as skewed from s""")
def q_wh_15(spark, d):
    k = W.key_skew(table(spark, d, "events"), "user_id")
    return k.withColumn("skew_ratio", F.round("skew_ratio", 6))
