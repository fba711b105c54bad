"""Registered source and sink queries (SRC, SNK). Writes go below the
session's shared checkpoint folder, each run to a fresh directory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.documents import JSON_LIST_KEYS
from ..session import scratch_root
from ..sources import readers as RD
from ..sources import sinks as SK
from ..sources.tables import table
from .registry import register


def _scratch(spark, name):
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@register("src_01", "select cast(r_regionkey as varchar) as r_regionkey, r_name from region")
def q_src_01(spark, d):
    p = _scratch(spark, "region_csv")
    table(spark, d, "region").write.option("header", True).csv(p)
    return RD.read_csv(spark, p, infer=False)


@register("src_02", """
select c_custkey, case when c_custkey % 9 <> 0 then c_name end as c_name,
  case when c_custkey % 4 = 0 then 'n/a' else cast(c_nationkey as varchar) end as nation,
  case when c_nationkey = 3 then c_custkey % 2 = 0 end as vip from customer""")
def q_src_02(spark, d):
    """Customers as JSON files whose wrappers differ: arrays, objects with
    one of four list keys (and other keys beside it), single objects; some
    records lack a field, and one field is a number or a text."""
    c = table(spark, d, "customer")
    nation = F.when(F.col("c_custkey") % 4 == 0, F.lit('"n/a"')).otherwise(F.col("c_nationkey").cast("string"))
    record = F.concat(
        F.lit('{"c_custkey":'), F.col("c_custkey"),
        F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit(',"c_name":"'), F.col("c_name"), F.lit('"'))).otherwise(""),
        F.when(F.col("c_nationkey") == 3, F.concat(F.lit(',"vip":'), (F.col("c_custkey") % 2 == 0).cast("string"))).otherwise(""),
        F.lit(',"nation":'), nation, F.lit("}"))
    kind = F.when(F.col("c_nationkey") == 5, 5).otherwise(F.pmod(F.col("c_nationkey"), F.lit(5)))
    # at most 500 records a document
    part = F.when(kind == 5, F.col("c_custkey")).otherwise(F.floor(F.col("c_custkey") / 500))
    docs = c.groupBy(kind.alias("kind"), F.concat_ws("-", "c_nationkey", part).alias("doc")).agg(
        F.array_join(F.collect_list(record), ",").alias("records"))
    lists = F.concat(F.lit("["), F.col("records"), F.lit("]"))
    value = F.when(F.col("kind") == 5, F.col("records")).when(F.col("kind") == 4, lists)
    for k, name in enumerate(JSON_LIST_KEYS):
        value = value.when(F.col("kind") == k, F.concat(F.lit(f'{{"total": 1, "{name}": '), lists, F.lit(', "next": null}')))
    p = _scratch(spark, "customer_docs")
    docs.select("doc", value.alias("value")).repartition("doc").write.partitionBy("doc").text(p)
    return RD.read_json_doc(spark, p)


@register("src_03", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def q_src_03(spark, d):
    p = _scratch(spark, "events_jsonl")
    ev = table(spark, d, "events")
    ev.select(F.to_json(F.struct("event_id", F.from_json("props", "k bigint").alias("props"))).alias("value")) \
        .write.text(p)
    r = RD.read_jsonl(spark, p, "event_id bigint, props struct<k: bigint>")
    return r.select("event_id", F.col("props.k").alias("k"))


@register("src_04", "select * from orders")
def q_src_04(spark, d):
    return RD.read_any(spark, f"{d.rstrip('/')}/orders.parquet")


@register("src_06", "select * from events where ts >= timestamp '2024-01-25 00:00:00'")
def q_src_06(spark, d):
    return RD.replay_from(spark, table(spark, d, "events"), "ts", "2024-01-25 00:00:00")


@register("src_08", "select event_id, ts, user_id, event_type, value from events")
def q_src_08(spark, d):
    ev = table(spark, d, "events")
    msgs = RD.to_messages(ev.select("event_id", "ts", "user_id", "event_type", "value"))
    return RD.parse_messages(msgs, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")


@register("snk_01", "select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders")
def q_snk_01(spark, d):
    p = _scratch(spark, "orders_by_status")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    SK.write_table(o, p, "overwrite", partition_by=["o_orderstatus"], cluster_by=["o_custkey"])
    return spark.read.parquet(p).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@register("snk_02", "select 'customer' as table_name, count(*) as rows_loaded, count(*) as rows_verified from customer")
def q_snk_02(spark, d):
    p = _scratch(spark, "customer")
    return SK.load_table(table(spark, d, "customer"), p, "replace", name="customer")


@register("snk_03", """select o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m') as month from orders""")
def q_snk_03(spark, d):
    p = _scratch(spark, "orders_by_month")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice",
                                         F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    SK.overwrite_partitions(o, p, ["month"])
    SK.overwrite_partitions(o, p, ["month"])          # loaded twice: same result
    return spark.read.option("basePath", p).parquet(p).select("o_orderkey", "o_totalprice",
                                                               F.col("month").cast("string").alias("month"))


@register("snk_06", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def q_snk_06(spark, d):
    root = _scratch(spark, "lineitem_stage")
    SK.stage_parquet(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), root)
    return SK.read_staged(spark, root)


@register("snk_08", """select o_orderkey, o_totalprice, cast(o_orderdate as date) as ds from orders
where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1998-04-01'""")
def q_snk_08(spark, d):
    p = _scratch(spark, "orders_backfill")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    SK.backfill(spark, o, "o_orderdate", "1998-01-01", "1998-03-31", p,
                transform=lambda df: df.drop("o_orderdate"))
    return spark.read.parquet(p).select("o_orderkey", "o_totalprice", F.col("ds").cast("date").alias("ds"))


@register("snk_04", """select o.o_orderkey, o.o_custkey, l.l_linenumber, l.l_quantity
from orders o join lineitem l on o.o_orderkey = l.l_orderkey""")
def q_snk_04(spark, d):
    """Orders and lineitem written bucketed and sorted on the order key;
    the join of the two tables plans without an exchange."""
    tag = uuid.uuid4().hex[:12]
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    SK.write_bucketed(o, f"bk_orders_{tag}", 8, ["o_orderkey"], path=_scratch(spark, "bk_orders"))
    SK.write_bucketed(li, f"bk_lineitem_{tag}", 8, ["o_orderkey"], path=_scratch(spark, "bk_lineitem"))
    return spark.table(f"bk_orders_{tag}").join(spark.table(f"bk_lineitem_{tag}"), "o_orderkey")


@register("snk_07")
def q_snk_07(spark, d):
    """Machine-readable quality report of orders: dataset info, score,
    summary, one row per check, one per column profile."""
    from ..operators import profile as P
    from ..operators import rules as Q
    from .profile_queries import orders_as_text
    from .rule_queries import TYPE_SPEC
    o = orders_as_text(spark, d)
    prof = P.profile_columns(o)
    res = Q.evaluate_row_rules(o, [Q.type_rule(c, t) for c, t in TYPE_SPEC])
    score = Q.quality_score(prof, res)
    return SK.quality_report({"table": "orders", "columns": len(o.columns)}, score, res, prof)


@register("wh_16", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def q_wh_16(spark, d):
    """Partition sizing: the table's size in MB sets the partition count
    (coalesce to shrink, repartition to grow); the rows are unchanged."""
    from ..operators import warehouse as W
    src = table(spark, d, "lineitem")
    # stored size from the file metadata Spark exposes (any file system)
    size_mb = (src.select("_metadata.file_path", "_metadata.file_size").distinct()
               .agg(F.sum("file_size")).collect()[0][0] or 0) / 1e6
    li = src.select("l_orderkey", "l_linenumber", "l_quantity")
    return W.resize(li, size_mb, target_mb=1.0)


@register("wh_17", """
select 'medallion_gold' as job, 'START' as event_type, cast(null as bigint) as row_count
union all
select 'medallion_gold', 'COMPLETE', count(*) from (
  select user_id, cast(ts as date) from (select distinct on (event_id) * from events
    where user_id is not null and event_type in ('click', 'view', 'purchase')) group by 1, 2)""")
def q_wh_17(spark, d):
    """Run lineage of a medallion run: START and COMPLETE events with the
    observed output row count, appended to a Parquet lineage table."""
    from ..operators import warehouse as W
    lin, out = _scratch(spark, "lineage"), _scratch(spark, "gold")
    W.with_lineage("medallion_gold", [f"{d}/events.parquet"], [out],
                   lambda: W.medallion(table(spark, d, "events"), None, "2024-02-01 00:00:00"), lin)
    return spark.read.parquet(lin).select("job", "event_type", "row_count")
