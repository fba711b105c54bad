"""One registered query per operator, with production parameters, over the
whole of its table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (collocations, decontaminate, divergence, langid, neardup, neighbours, pieces, repeats, secrets, sharding, tokencount, tokens,
               toxicity)
from .common import scratch_path

SHARDS = 24
END_ID = 2
MOST_TOKENS = 4096
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file (operators take it as a parameter)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _remainder(n: int) -> Column:
    """crc32 of the doc_id as text modulo ``n``; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens.write_token_files(docs, path, vocabulary("word_bpe_49k.json"), END_ID)
    return tokens.token_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def _span_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(generate_series(1, len(regexp_extract_all(t, '{p}', 0))), i -> {{
        's': list_sum(list_transform((string_split_regex(t, '{p}'))[1:i], x -> length(x)))
             + coalesce(list_sum(list_transform((regexp_extract_all(t, '{p}', 0))[1:i-1], x -> length(x))), 0),
        'r': {rank}, 'k': '{kind}', 'n': length((regexp_extract_all(t, '{p}', 0))[i]),
        'g': length((regexp_extract_all(t, '{p}', {group}))[i])}}), x -> x.g >= {least})"""


def _secrets_sql() -> str:
    every = [(i, r) for i, r in enumerate(secrets.RULES)]
    text = lambda of: (f"coalesce(array_to_string(list_transform(list_sort({of}), "  # noqa: E731
                       "x -> x.k || ':' || x.s::bigint::varchar || ':' || (x.s + x.n)::bigint::varchar), ','), '')")
    lists = ", ".join(f"{_span_sql(r.kind, i, r.tight or r.pattern, r.group, 1 if r.tight else r.least)} AS l{i}"
                      for i, r in every)
    base = " || ".join(f"l{i}" for i, _ in every[:len(secrets.BASE_RULES)])
    both = " || ".join(f"l{i}" for i, _ in every)
    counts = ", ".join(f"len(l{i})::bigint AS n_{r.kind}" for i, r in every[:len(secrets.BASE_RULES)])
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        l AS (SELECT doc_id, {lists} FROM d)
        SELECT doc_id, {counts}, sha256({text(base)}) AS base_sha256, {text(both)} AS spans FROM l"""


@query("op7_secret_scan", _secrets_sql())
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *secrets.digest(found))


@query("op9_external_shuffle")
def op9_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shuffle_into_shards(docs, SHARDS)
    return out.select("doc_id", sharding.record_size("text").alias("size"),
                      F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_repeated_bytes")
def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _remainder(5) == 0
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model, ["doc_id", held_out.alias("held_out")])


@query("op4_multi_index_hashing")
def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return neighbours.search(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


@query("op3_lsh_forest")
def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op1_string_kernel_svm")
def op1_string_kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder(4) == 2
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model, ["doc_id", held_out.alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= toxicity.CUT).cast("int"))


@query("op5_suffix_array_pieces")
def op5_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), ["doc_id"])


@query("op2_latent_semantic")
def op2_latent_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_COLLOCATION_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    word AS (SELECT lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] AS w FROM piece),
    total AS (SELECT lang, sum(len(w))::bigint AS n FROM word GROUP BY lang),
    phrase AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in generate_series(1, len(w) - k + 1)]) AS phrase
               FROM word, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM phrase GROUP BY ALL HAVING count(*) >= 30),
    cut AS (SELECT lang, k, phrase, f AS a, unnest(generate_series(1, k - 1)) AS c, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    score AS (SELECT cut.lang, cut.phrase, cut.a, cut.c, x.f AS l, y.f AS r,
                     ((2000000::hugeint * cut.a) // (x.f + y.f))::bigint AS score
              FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1:cut.c], ' ')
              JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[cut.c + 1:], ' ')),
    best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    part AS (SELECT cut.lang, array_to_string(cut.w[s:s + m - 1], ' ') AS phrase, max(cut.a) AS cover
             FROM cut, (VALUES (1), (2), (3)) AS b(s), (VALUES (2), (3)) AS d(m)
             WHERE cut.c = 1 AND m < cut.k AND s + m - 1 <= cut.k GROUP BY ALL),
    kept AS (SELECT best.* FROM best LEFT JOIN part USING (lang, phrase) WHERE cover IS NULL OR 100 * cover < 80 * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query("op11_setm_collocations", _COLLOCATION_SQL)
def op11_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
    grp AS (SELECT DISTINCT lang, source FROM d),
    tok AS (SELECT id, lang, source, unnest(words) AS term FROM d),
    kept AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT id) >= 3),
    cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    gs AS (SELECT lang, source, coalesce(sum(n), 0)::hugeint AS n, any_value(coalesce(v, 0)) AS v
           FROM grp LEFT JOIN v USING (lang) LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
    p AS (SELECT gs.lang, gs.source, kept.term, coalesce(cnt.n, 0) AS n,
                 1 + (1000000000::hugeint * (coalesce(cnt.n, 0) + 1)) // (gs.n + gs.v) AS p
          FROM gs JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
    q AS (SELECT lang, term, 1 + (1000000000::hugeint * (t + 1)) // (sum(t) OVER (PARTITION BY lang) + v) AS q
          FROM (SELECT lang, term, sum(n)::hugeint AS t FROM cnt GROUP BY ALL) JOIN v USING (lang)),
    pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
             UNION ALL SELECT a.lang, a.source, b.source, 0 FROM gs a JOIN gs b ON a.lang = b.lang AND a.source <> b.source
             WHERE a.v = 0),
    term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::bigint AS value
             FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::int AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::int AS rank FROM term) WHERE rank <= 200
"""


@query("op12_quadtree_divergence", _DIVERGENCE_SQL)
def op12_quadtree_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query("op13_overlap_token_counts")
def op13_overlap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, vocabulary("piece_bpe_32k.model"), ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > MOST_TOKENS)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
