"""The corpus pipeline: five operators of ``lakesmith.llm`` in turn, each on
what its predecessor kept, with a written table between two stages.

Rejected documents go (toxicity, near copies, benchmark leaks), secrets are
replaced in place, and the last stage turns texts into token ids. Tokens of
labelled rows train the toxicity model; nothing else is learned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesmith.llm import decontaminate, neardup, pieces, secrets, toxicity
from lakesmith.llm.common import materialise
from lakesmith.llm.queries import vocabulary
from lakesmith.sources.tables import table

REJECT = toxicity.CUT       # toxicity score from which a document goes: operator 1's own decision


def apart(docs: DataFrame) -> DataFrame:
    """(doc, text): all columns but the text in one, so that none clashes
    with results and the text travels once."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below ``REJECT``."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(apart(docs), model, ["doc"], with_text=True).where(F.col("score") < REJECT)
    return scored.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near copies."""
    kept = neardup.near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    leaks = decontaminate.find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leaks = leaks.select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_leak")), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars renewed."""
    out = secrets.redact(secrets.find_secrets(apart(docs)))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.coalesce(F.char_length("text").cast(kind), F.col("doc.n_chars"))
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]
ORACLE_SQL = None       # the kernel model and the latent space have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
