"""Registered text, vector and evidence queries (TXT, VEC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as X
from ..sources.tables import table
from .registry import register


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _text_sql(col: str) -> str:
    t = f"regexp_replace({col}, '(?is)<script\\b.*?</script>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<style\\b.*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for ent, ch in X.HTML_ENTITIES:
        t = f"replace({t}, {_q(ent)}, {_q(ch)})"
    return f"trim(regexp_replace({t}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


PAGES_TEXT_SQL = f"(select page_id, url, {_text_sql('html')} as text from pages)"


def pages_text(spark, d):
    ok, _failed = X.extract_text(table(spark, d, "pages"))
    return ok


@register("txt_01", f"select page_id, url, text, cast(length(text) as integer) as n_chars from {PAGES_TEXT_SQL} where length(text) > 0")
def q_txt_01(spark, d):
    return pages_text(spark, d).select("page_id", "url", "text", "n_chars")


QUERY = "the que und"


@register("txt_02", f"""
with t as (select page_id, regexp_extract_all(lower(text), '\\p{{L}}+') as toks from {PAGES_TEXT_SQL} where length(text) > 0),
n as (select count(*) as n from t),
s as (select page_id, len(toks) as n_tok, unnest(toks) as term from t),
h as (select page_id, term, n_tok, count(*) as c from s where term in ('que', 'the', 'und') group by all),
df as (select term, count(distinct page_id) as df from h group by 1)
select page_id, round(sum(c / n_tok * ln(n.n / df.df)), 6) as score
from h join df using (term), n group by page_id order by score desc, page_id limit 10""")
def q_txt_02(spark, d):
    r = X.search(pages_text(spark, d), QUERY, k=10)
    return r.withColumn("score", F.round("score", 6))


@register("txt_03", f"""select page_id, substr(text, 1, 500) || case when length(text) > 500 then '...' else '' end
  as snippet from {PAGES_TEXT_SQL} where length(text) > 0""")
def q_txt_03(spark, d):
    return pages_text(spark, d).select("page_id", X.snippet("text", 500).alias("snippet"))


@register("txt_04", """select page_id, coalesce(
  nullif(regexp_extract(html, '(?:wistia\\.com/medias/|wistia_embed/|hashedId["\\s:]+["\\s])([a-z0-9]{10})', 1), ''),
  nullif(regexp_extract(html, 'medias/([a-z0-9]{10})', 1), '')) as media_id from pages""")
def q_txt_04(spark, d):
    return table(spark, d, "pages").select("page_id", X.embedded_media_id("html").alias("media_id"))


@register("txt_05", """
select conv_id, cast(sum(case when regexp_replace(text, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') = '' then 0
    else len(regexp_split_to_array(regexp_replace(text, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'),
      '[ \\t\\n\\r\\f]+')) end) as bigint) as word_count,
  count(*) as turns, substr(string_agg(text, chr(10) order by turn), 1, 200) as preview
from conversations group by 1""")
def q_txt_05(spark, d):
    return X.transcript_stats(table(spark, d, "conversations"))


COS_SQL = """list_cosine_similarity(cast(embedding as double[]), cast(q as double[]))"""


@register("vec_01", f"""
with qv as (select embedding as q from embeddings where vec_id = 0)
select vec_id, round({COS_SQL}, 6) as score from embeddings, qv order by {COS_SQL} desc, vec_id limit 5""")
def q_vec_01(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") == 0).select("embedding").collect()[0][0]      # one vector
    return X.cosine_topk(e, q, 5).withColumn("score", F.round("score", 6))


def label_centroids(spark, d):
    e = table(spark, d, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("pos", "v"))
    c = long.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return (c.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
            .select(F.col("label").cast("long").alias("query_id"),
                    F.transform("s", lambda x: x["v"]).alias("embedding")))


@register("vec_02", f"""
with l as (select label, unnest(embedding) as v, unnest(generate_series(1, len(embedding))) as pos from embeddings),
c as (select label, pos, avg(v) as v from l group by 1, 2),
q as (select cast(label as bigint) as query_id, list(v order by pos) as q from c group by 1),
s as (select q.query_id, e.vec_id, {COS_SQL} as score from q, embeddings e),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where score > 0.3)
select query_id, vec_id, round(score, 6) as score, rank from r where rank <= 5""")
def q_vec_02(spark, d):
    r = X.cosine_join(label_centroids(spark, d), table(spark, d, "embeddings"), k=5, min_score=0.3)
    return r.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@register("vec_03", """
with h as (select doc_id, sha256(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f]+', ' ', 'g'))) as h from documents),
g as (select h, min(doc_id) as representative, count(*) as copies from h group by 1)
select doc_id, representative, copies from h join g using (h) where copies > 1""")
def q_vec_03(spark, d):
    return X.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


@register("vec_04", """
with top as (select c_custkey from customer order by c_acctbal desc, c_custkey limit 5),
f as (select 'nation' as section, n.n_name as item from top join customer c using (c_custkey)
        join nation n on n.n_nationkey = c.c_nationkey
      union select 'orders', 'Order#' || cast(o.o_orderkey as varchar) from top join orders o on o.o_custkey = top.c_custkey),
r as (select *, row_number() over (partition by section order by item) as rn from (select distinct section, item from f))
select section, list_sort(list(item)) as items from r where rn <= 5 group by 1""")
def q_vec_04(spark, d):
    c = table(spark, d, "customer")
    top = c.orderBy(F.desc("c_acctbal"), F.asc("c_custkey")).limit(5).select("c_custkey")
    n = table(spark, d, "nation")
    facts = (c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.lit("nation").alias("section"),
                                                              F.col("n_name").alias("item"))
             .unionByName(table(spark, d, "orders").select(
                 F.col("o_custkey").alias("c_custkey"), F.lit("orders").alias("section"),
                 F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("item"))))
    return X.merge_evidence(top, facts, "c_custkey", 5)


@register("vec_03_near")
def q_vec_03_near(spark, d):
    """VEC-03 near part: documents whose word 3-shingle sets have Jaccard
    >= 0.8 collapse to the smallest doc id (exact candidates by prefix
    filtering, exact verification, components by label propagation)."""
    return X.near_duplicates(table(spark, d, "documents"), "doc_id", "text", threshold=0.8)


@register("txt_01_failed", f"select page_id, 'empty content' as error from {PAGES_TEXT_SQL} where length(text) = 0")
def q_txt_01_failed(spark, d):
    """TXT-01 failure list: pages whose extracted text is empty."""
    _ok, failed = X.extract_text(table(spark, d, "pages"))
    return failed


@register("vec_03_vectors", """
with u as (select vec_id, list_transform(cast(embedding as double[]),
    lambda x: round(x / sqrt(list_sum(list_transform(cast(embedding as double[]), lambda y: y * y))), 6)) as u
  from embeddings),
g as (select u, min(vec_id) as representative, count(*) as copies from u group by u)
select vec_id, representative, copies from u join g using (u) where copies > 1""")
def q_vec_03_vectors(spark, d):
    """VEC-03 exact vector part on the embeddings."""
    return X.exact_vector_duplicates(table(spark, d, "embeddings"), "vec_id", "embedding")
