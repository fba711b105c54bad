"""Registered queries for cleaning, casting and filters (CLN, FLT, SRC-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import safe_divide, surrogate_key
from ..operators import clean as C
from ..sources.tables import table
from .registry import register


def seeded_orders(spark, d):
    """Orders with nulls seeded the same way as in the SQL twins."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(k % 11 == 0, None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 5 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


SEEDED_ORDERS_SQL = """(select o_orderkey, o_custkey,
  case when o_orderkey % 11 = 0 then null else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice,
  case when o_orderkey % 5 = 0 then null else o_orderpriority end as o_orderpriority
  from orders)"""


@register("cln_01", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def q_cln_01(spark, d):
    messy = table(spark, d, "customer").toDF("C CustKey", "C-Name!", "c__NationKey",
                                             "  C AcctBal ", "c_mktsegment")
    return C.normalize_columns(messy)


@register("cln_02", """
select c_custkey, c_name,
  case when c_custkey % 9 in (0, 1, 2) then null else c_mktsegment end as c_mktsegment
from customer""")
def q_cln_02(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    padded = c.select(
        "c_custkey", F.concat(F.lit("  "), F.col("c_name"), F.lit("\t")).alias("c_name"),
        F.when(k % 9 == 0, "nan").when(k % 9 == 1, " None ").when(k % 9 == 2, "   ")
        .otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return C.clean_strings(padded)


@register("cln_03", """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  o_orderpriority from orders""")
def q_cln_03(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return C.detect_and_parse_dates(o)


@register("cln_04", """select cast(l_orderkey as integer) as l_orderkey, l_linenumber,
  cast(l_quantity as bigint) as l_quantity, l_discount from lineitem""")
def q_cln_04(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return C.downcast_numeric(li)


@register("cln_05", """
with s as (select
  case when c_custkey % 7 = 0 then null else c_custkey end as c_custkey,
  case when c_custkey % 7 = 0 then null else c_name end as c_name,
  case when c_custkey % 7 = 0 then null else c_acctbal end as c_acctbal
  from customer)
select * from s where not (c_custkey is null and c_name is null and c_acctbal is null)""")
def q_cln_05(spark, d):
    c = table(spark, d, "customer")
    z = F.col("c_custkey") % 7 == 0
    s = c.select(*[F.when(z, None).otherwise(F.col(n)).alias(n)
                   for n in ("c_custkey", "c_name", "c_acctbal")])
    return C.drop_empty_rows(s)


@register("cln_06", "select distinct l_orderkey, l_linenumber from lineitem")
def q_cln_06(spark, d):
    return C.drop_duplicate_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@register("cln_07", f"""
with s as {SEEDED_ORDERS_SQL},
d as (select * from s where o_orderstatus is not null),
med as (select median(o_totalprice) as m from d),
mo as (select o_orderpriority as m from d where o_orderpriority is not null
       group by 1 order by count(*) desc, 1 limit 1)
select o_orderkey, o_custkey, o_orderstatus,
  coalesce(o_totalprice, (select m from med)) as o_totalprice,
  coalesce(o_orderpriority, (select m from mo)) as o_orderpriority
from d""")
def q_cln_07(spark, d):
    return C.handle_nulls(seeded_orders(spark, d),
                          {"o_orderstatus": "drop", "o_totalprice": "median",
                           "o_orderpriority": "mode"})


@register("cln_08", """
with f as (select c_mktsegment,
  cast(row_number() over (order by count(*) desc, c_mktsegment) - 1 as integer) as c_mktsegment_code
  from customer group by 1)
select c.c_custkey, c.c_mktsegment, f.c_mktsegment_code
from customer c left join f using (c_mktsegment)""")
def q_cln_08(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return C.encode_category(c, "c_mktsegment")


def _audit_steps(spark, d):
    s = seeded_orders(spark, d)
    s1 = s.na.drop(subset=["o_orderstatus"])
    s2 = s1.select("o_custkey", "o_orderstatus", "o_orderpriority").dropDuplicates()
    return [("raw", s), ("drop_missing_status", s1), ("distinct_customer_status", s2)]


@register("cln_09", f"""
with s as {SEEDED_ORDERS_SQL},
s1 as (select * from s where o_orderstatus is not null),
s2 as (select distinct o_custkey, o_orderstatus, o_orderpriority from s1),
u as (
  select 0 as step_no, 'raw' as step, count(*) as rows_after,
    cast(count(*) filter (where o_orderkey is null) + count(*) filter (where o_custkey is null)
     + count(*) filter (where o_orderstatus is null) + count(*) filter (where o_totalprice is null)
     + count(*) filter (where o_orderpriority is null) as bigint) as nulls_after from s
  union all
  select 1, 'drop_missing_status', count(*),
    cast(count(*) filter (where o_orderkey is null) + count(*) filter (where o_custkey is null)
     + count(*) filter (where o_orderstatus is null) + count(*) filter (where o_totalprice is null)
     + count(*) filter (where o_orderpriority is null) as bigint) from s1
  union all
  select 2, 'distinct_customer_status', count(*),
    cast(count(*) filter (where o_custkey is null) + count(*) filter (where o_orderstatus is null)
     + count(*) filter (where o_orderpriority is null) as bigint) from s2)
select step_no, step, rows_after, nulls_after,
  coalesce(lag(rows_after) over (order by step_no), rows_after) as rows_before,
  coalesce(lag(nulls_after) over (order by step_no), nulls_after) as nulls_before,
  coalesce(lag(rows_after) over (order by step_no), rows_after) - rows_after as dropped
from u""")
def q_cln_09(spark, d):
    return C.cleaning_audit(_audit_steps(spark, d))


@register("cln_10", """
select o_orderkey as order_id, o_custkey as customer_id, upper(o_orderstatus) as order_status,
  cast(cast(o_totalprice as decimal(12, 2)) as double) as total_amount, o_orderdate as order_date
from orders""")
def q_cln_10(spark, d):
    spec = {"order_id": ("o_orderkey", None), "customer_id": ("o_custkey", None),
            "order_status": ("o_orderstatus", None),
            "total_amount": ("o_totalprice", "decimal(12,2)"),
            "order_date": ("o_orderdate", None)}
    st = C.stage(table(spark, d, "orders"), spec, upper=["o_orderstatus"])
    # decimal(12,2) is the staged type; exported as double for the comparison
    return st.withColumn("total_amount", F.col("total_amount").cast("double"))


@register("cln_11", """
select o_orderkey, cast(year(o_orderdate) as integer) as o_orderdate_year,
  cast(month(o_orderdate) as integer) as o_orderdate_month,
  cast(day(o_orderdate) as integer) as o_orderdate_day,
  cast(isodow(o_orderdate) - 1 as integer) as o_orderdate_dow
from orders""")
def q_cln_11(spark, d):
    return C.add_date_parts(table(spark, d, "orders").select("o_orderkey", "o_orderdate"),
                            ["o_orderdate"])


@register("cln_12", "select o_orderkey, o_totalprice from orders")
def q_cln_12(spark, d):
    parts = C.add_date_parts(table(spark, d, "orders").select("o_orderkey", "o_totalprice",
                                                              "o_orderdate"), ["o_orderdate"])
    return C.drop_date_parts(parts)


@register("cln_13", """
select o_custkey,
  round(case when count(*) filter (where o_orderstatus = 'P') = 0 then 0
        else sum(o_totalprice) / count(*) filter (where o_orderstatus = 'P') end, 6) as value_per_pending
from orders group by 1""")
def q_cln_13(spark, d):
    o = table(spark, d, "orders")
    g = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"),
                                   F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return g.select("o_custkey", F.round(safe_divide("s", "p", 0.0), 6).alias("value_per_pending"))


@register("cln_14", """
select c_custkey, md5(concat_ws('|', coalesce(cast(c_custkey as varchar), chr(0)),
  coalesce(case when c_custkey % 5 = 0 then null else c_name end, chr(0)))) as sk
from customer""")
def q_cln_14(spark, d):
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_name"))
    return c.select("c_custkey", surrogate_key(F.col("c_custkey"), name).alias("sk"))


@register("cln_15", """select o_orderkey as order_id, o_totalprice as amount,
  0 as discount_amount, o_orderstatus as status from orders""")
def q_cln_15(spark, d):
    return C.compat_view(table(spark, d, "orders"),
                         {"order_id": "o_orderkey", "amount": "o_totalprice",
                          "discount_amount": "o_discount", "status": "o_orderstatus"},
                         {"discount_amount": 0})


@register("cln_16", """select o_orderkey, o_custkey, o_totalprice,
  case when o_orderdate >= timestamp '1998-01-01' then o_orderpriority end as o_orderpriority
from orders""")
def q_cln_16(spark, d):
    o = table(spark, d, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    old = o.where(F.col("o_orderdate") < cut).select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.where(F.col("o_orderdate") >= cut).select("o_orderkey", "o_custkey", "o_totalprice",
                                                      "o_orderpriority")
    return C.evolve(new, old, "append_new_columns")


@register("cln_17", """select l_orderkey, l_linenumber,
  round(l_quantity * l_extendedprice, 6) as gross_amount,
  round(l_quantity * l_extendedprice * (1 - coalesce(l_discount * 100, 0) / 100), 6) as net_amount
from lineitem""")
def q_cln_17(spark, d):
    li = table(spark, d, "lineitem").withColumn("disc_pct", F.col("l_discount") * 100)
    a = C.with_amounts(li, "l_quantity", "l_extendedprice", "disc_pct")
    return a.select("l_orderkey", "l_linenumber", F.round("gross_amount", 6).alias("gross_amount"),
                    F.round("net_amount", 6).alias("net_amount"))


@register("cln_18", """
with s as (select event_id, user_id, ts,
  case when event_id % 4 = 0 then null else value end as value from events)
select event_id, user_id, coalesce(
  last_value(value ignore nulls) over (partition by user_id order by ts, event_id
    rows between unbounded preceding and current row),
  first_value(value ignore nulls) over (partition by user_id order by ts, event_id
    rows between current row and unbounded following)) as value
from s""")
def q_cln_18(spark, d):
    ev = table(spark, d, "events")
    s = ev.select("event_id", "user_id", "ts",
                  F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("value")).alias("value"))
    from ..operators.relational import fill_gaps_bucketed
    return fill_gaps_bucketed(s, "user_id", ["ts", "event_id"], ["value"], F.to_date("ts")).drop("ts")


# ------------------------------------------------------------------- filters

@register("flt_01", """select * from events
where user_id is not null and event_type in ('click', 'view', 'purchase')""")
def q_flt_01(spark, d):
    return C.silver_filter(table(spark, d, "events"), ["user_id"],
                           {"event_type": ["click", "view", "purchase"]})


@register("flt_02", """select * from part
where lower(coalesce(cast(p_name as varchar), '')) like '%ring%'
  and lower(coalesce(cast(p_brand as varchar), '')) like '%#1%'""")
def q_flt_02(spark, d):
    return C.filter_contains(table(spark, d, "part"), {"p_name": "RING", "p_type": None,
                                                      "p_brand": "#1"})


@register("flt_03", "select * from customer where c_custkey = 42")
def q_flt_03(spark, d):
    return C.get_by_id(table(spark, d, "customer"), "c_custkey", 42)


@register("flt_04", """select * from orders where o_orderdate >
  coalesce((select max(o_orderdate) from orders where o_orderdate < timestamp '2000-01-01'),
           timestamp '1900-01-01')""")
def q_flt_04(spark, d):
    o = table(spark, d, "orders")
    target = o.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return C.incremental_filter(o, target, "o_orderdate")


@register("flt_05", """select * from orders
where o_orderdate >= timestamp '1997-05-28' and o_orderdate < timestamp '1997-05-29'""")
def q_flt_05(spark, d):
    return C.for_date(table(spark, d, "orders"), "o_orderdate", "1997-05-28")


@register("flt_06", """select * from events
where ts >= timestamp '2024-01-31 00:00:00' - interval 3 day and ts <= timestamp '2024-01-31 00:00:00'""")
def q_flt_06(spark, d):
    return C.recent(table(spark, d, "events"), "ts", 3, "2024-01-31 00:00:00")


@register("flt_07", """
with h as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) as host
           from pages)
select page_id, url from h
where (host = 'example.net' or host like '%.example.net' or host = 'example.org' or host like '%.example.org')
  and not (host = 'm.ththth.example.net' or host like '%.m.ththth.example.net')""")
def q_flt_07(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return C.filter_domains(p, "url", include=["example.net", "example.org"],
                            exclude=["m.ththth.example.net"])


@register("src_07", """select event_id, user_id, timestamp '2024-02-01 00:00:00' as ingested_at,
  'events.parquet' as source_name from events""")
def q_src_07(spark, d):
    ev = C.with_ingest_metadata(table(spark, d, "events"), as_of="2024-02-01 00:00:00")
    return ev.select("event_id", "user_id",
                     F.col("_ingested_at").cast("timestamp_ntz").alias("ingested_at"),
                     F.regexp_extract("_source_file", r"([^/]+)$", 1).alias("source_name"))
