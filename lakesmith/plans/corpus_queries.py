"""Registered corpus and insight queries (COR, INS). Page URLs stand in for
repository paths: their path part is a file path, the page size its bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import insight as I
from ..sources.tables import table
from .registry import register

PATH_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)', 1)"


def page_files(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)", 1)
                    .alias("path"), F.length("html").cast("long").alias("size"))


def _role_sql(stem: str) -> str:
    parts = []
    for role, pat in K.ROLE_PATTERNS:
        cond = (f"{stem} in ({', '.join(repr(e) for e in K.ENTRY_POINTS)})" if pat is None
                else f"regexp_matches({stem}, '(?i){pat}')")
        parts.append(f"when {cond} then '{role}'")
    return "case " + " ".join(parts) + " else 'Source' end"


STEM_SQL = (f"lower(regexp_replace(list_last(string_split(regexp_replace({PATH_SQL}, '^/+', ''), '/')), "
            f"'\\.[^.]*$', ''))")


@register("cor_03", f"select page_id, {PATH_SQL} as path, {_role_sql(STEM_SQL)} as role from pages")
def q_cor_03(spark, d):
    return K.classify_files(page_files(spark, d)).select("page_id", "path", "role")


@register("cor_05", f"""
with f as (select string_split(regexp_replace({PATH_SQL}, '^/+', ''), '/') as parts, cast(length(html) as bigint) as sz
           from pages),
g as (select array_to_string(parts[1:i], '/') as dir, sz from f,
      unnest(generate_series(1, least(len(parts) - 1, 4))) as t(i) where len(parts) > 1)
select dir, count(*) as files, cast(sum(sz) as bigint) as bytes, len(string_split(dir, '/')) as depth from g group by 1""")
def q_cor_05(spark, d):
    t = K.tree_sizes(page_files(spark, d))
    return t.select("dir", "files", "bytes", F.col("depth").cast("long").alias("depth"))


@register("ins_01", """
with g as (select date_trunc('quarter', o.o_orderdate) as quarter, c.c_mktsegment, sum(o.o_totalprice) as value
           from orders o join customer c on o.o_custkey = c.c_custkey group by 1, 2),
c as (select *, value - lag(value) over (partition by c_mktsegment order by quarter) as change from g),
t as (select quarter, sum(change) as total_change from c where change is not null group by 1),
r as (select c.quarter, c.c_mktsegment, c.value, c.change, t.total_change,
  case when t.total_change = 0 or t.total_change is null then null else c.change / t.total_change end as share_of_change,
  row_number() over (partition by c.quarter order by abs(c.change) desc, c.c_mktsegment) as rank
  from c join t using (quarter) where c.change is not null)
select quarter, c_mktsegment, round(value, 6) as value, round(change, 6) as change, round(total_change, 6) as total_change,
  round(share_of_change, 6) as share_of_change, rank from r where rank <= 3""")
def q_ins_01(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .select(F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("quarter"), "c_mktsegment",
                 "o_totalprice"))
    r = I.period_change(j, "quarter", "o_totalprice", "c_mktsegment")
    for col in ("value", "change", "total_change", "share_of_change"):
        r = r.withColumn(col, F.round(col, 6))
    return r.select("quarter", "c_mktsegment", "value", "change", "total_change", "share_of_change",
                    F.col("rank").cast("long").alias("rank"))


@register("ins_02", """
with a as (select cast(o_orderdate as date) as day, count(*) as orders, sum(o_totalprice) as order_value
           from orders group by 1),
b as (select cast(l_shipdate as date) as day, sum(l_quantity) as shipped_qty from lineitem group by 1),
j as (select * from a join b using (day))
select 'orders' as metric_a, 'shipped_qty' as metric_b, round(corr(orders, shipped_qty), 6) as r, count(*) as days from j
union all
select 'order_value', 'shipped_qty', round(corr(order_value, shipped_qty), 6), count(*) from j""")
def q_ins_02(spark, d):
    a = (table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
         .agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("order_value")))
    b = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.sum("l_quantity").alias("shipped_qty"))
    r = I.cross_source_corr(a, b, "day", ["orders", "order_value"], ["shipped_qty"])
    return r.withColumn("r", F.round("r", 6))


# A file table derived from the documents: one file per document, the
# extension chosen by the document's language (fixed mapping below).
LANG_EXT = {"en": ".py", "fr": ".js", "de": ".go", "es": ".md"}


def doc_files(spark, d):
    docs = table(spark, d, "documents")
    ext = F.coalesce(F.element_at(F.create_map(*[x for k, v in LANG_EXT.items() for x in (F.lit(k), F.lit(v))]),
                                   F.col("lang")), F.lit(".txt"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    return docs.select(path.alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size"))


DOC_FILES_SQL = ("(select source || '/' || lang || '/doc_' || cast(doc_id as varchar) || "
                 "coalesce(case lang " + " ".join(f"when '{k}' then '{v}'" for k, v in LANG_EXT.items()) +
                 " end, '.txt') as path, text as content, n_chars as size from documents)")
LANG_CASE = ("case " + " ".join(f"when lower(regexp_extract(path, '(\\.[^./]+)$', 1)) = '{k}' then '{v}'"
                                for k, v in K.LANG_MAP.items()) + " end")


@register("cor_01", f"""
select language, count(*) as count from (select {LANG_CASE} as language from {DOC_FILES_SQL})
where language is not null group by 1 order by count desc, language limit 15""")
def q_cor_01(spark, d):
    return K.language_counts(doc_files(spark, d))


@register("cor_02")
def q_cor_02(spark, d):
    """Top 30 files by importance score among files up to 16 KB."""
    return K.rank_files(doc_files(spark, d))


@register("cor_04")
def q_cor_04(spark, d):
    """Per-language totals of lines and symbols with the primary language."""
    return K.corpus_totals(K.corpus_symbols(doc_files(spark, d)))
