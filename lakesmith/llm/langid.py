"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed byte n-grams (1 to 3 bytes of its
letters, lower-cased in ASCII), log-scaled and of unit length. Each
language has several centroids (spherical k-means); a text gets the
language of the centroid with the largest cosine. Texts farther from it
than nearly all training texts of that language are marked ``rejected``.

The fit reads at most ``SAMPLE`` whole labelled texts per language (those
with the smallest hashes of their ids); prediction reads every whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, chunks, text_bytes

BITS = 12
DIMS = 1 << BITS
SAMPLE = 800
CENTROIDS = 4
UNKNOWN = "und"
TEMPERATURE = 40.0
_LETTER = re.compile(r"[^\W\d_]")

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _slots(x: np.ndarray, n: int) -> np.ndarray:
    return ((x * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - BITS)).astype(np.int64)


def _add_grams(out: np.ndarray, b: np.ndarray, row: np.ndarray) -> None:
    """Counts of the n-grams of folded bytes, by row."""
    b = _FOLD[b]
    keep = np.ones(len(b), bool)
    keep[1:] = ~((b[1:] == 32) & (b[:-1] == 32) & (row[1:] == row[:-1]))
    b, row = b[keep].astype(np.uint32), row[keep]
    code = np.zeros(len(b), np.uint32)
    for n in (1, 2, 3):
        code = (code[:len(b) - n + 1] << np.uint32(8)) | b[n - 1:]
        r = row[:len(code)]
        inside = r == row[n - 1:]
        out += np.bincount((r * DIMS + _slots(code, n))[inside], minlength=out.size)


def gram_counts(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x DIMS counts. One very long text is counted piece by piece
    (n-grams across a cut are left to the piece before it)."""
    rows = len(off) - 1
    out = np.zeros(rows * DIMS)
    row = np.repeat(np.arange(rows), np.diff(off))
    for s in range(0, len(b), 2 * CHUNK):
        _add_grams(out, b[s:s + 2 * CHUNK], row[s:s + 2 * CHUNK])
    return out.reshape(rows, DIMS).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.string()))


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first centres."""
    centre = unit(x.mean(axis=0, keepdims=True))
    far = x @ centre[0]
    picks = [int(np.argmax(far))]
    while len(picks) < min(k, len(x)):
        far = (x @ x[picks].T).max(axis=1)
        picks.append(int(np.argmin(far)))
    c = x[picks]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c


class Model:
    """Centroids (unit rows), their languages, IDF weights and, for each
    centroid's language, the distance beyond which a text is rejected."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], limits: dict[str, float]):
        self.idf, self.centroids, self.langs, self.limits = idf, centroids, langs, limits
        self.names = sorted(set(langs))
        self.slot = np.array([self.names.index(v) for v in langs], np.int64)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, distance)."""
        cos = self.vectors(counts) @ self.centroids.T
        best = np.full((len(cos), len(self.names)), -1.0)
        for i, s in enumerate(self.slot):
            best[:, s] = np.maximum(best[:, s], cos[:, i])
        top = best.argmax(axis=1)
        at = best[np.arange(len(best)), top]
        score = 1 / np.exp(TEMPERATURE * (best - at[:, None])).sum(axis=1)
        return top, score, 1 - at


def _centroids(idf: np.ndarray, sample: int, k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h", kind="stable").head(sample)
        b, off = _joined(rows["text"].tolist())
        x = unit(np.concatenate([np.log1p(gram_counts(b[off[i]:off[j]], off[i:j + 1] - off[i])) * idf
                                 for i, j in chunks(off)]))
        c = cluster(x, k)
        near = (x @ c.T).max(axis=1)
        return pd.DataFrame({"lang": key[0], "vector": list(c), "far": float(1 - near.min()) * 1.1})
    return run


def _frequencies(batches):
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        b, off = text_bytes(batch.column("text"))
        for i, j in chunks(off):
            df += (gram_counts(b[off[i]:off[j]], off[i:j + 1] - off[i]) > 0).sum(axis=0)
            n += j - i
    yield pa.RecordBatch.from_pydict({"slot": np.arange(DIMS + 1), "n": np.append(df, n)})


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE,
        k: int = CENTROIDS) -> Model | None:
    """Fit on rows with text and language; None if there are none. Each
    language's sample is clustered in a task of its own; the driver gets
    the centroids alone (``k`` rows of DIMS floats per language)."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h"))
    # the sample's largest hash per language, from the two narrow columns
    w = Window.partitionBy("lang").orderBy("h")
    cut = (rows.select("lang", "h").withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample)
           .groupBy("lang").agg(F.max("h").alias("cut")))
    # one row a language: the texts stay where they are until the sample is chosen
    chosen = rows.join(F.broadcast(cut), "lang").where("h <= cut").select("lang", "text", "h")
    counts = chosen.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(
        F.sum("n").alias("n")).collect()
    by_slot = {r["slot"]: r["n"] for r in counts}
    if not by_slot.get(DIMS):
        return None
    idf = np.array([np.log((1 + by_slot[DIMS]) / (1 + by_slot[s])) + 0.05 for s in range(DIMS)], np.float32)
    got = chosen.groupBy("lang").applyInPandas(_centroids(idf, sample, k),
                                               "lang string, vector array<float>, far double").collect()
    got = sorted(got, key=lambda r: r["lang"])
    return Model(idf, np.array([r["vector"] for r in got], np.float32), [r["lang"] for r in got],
                 {r["lang"]: r["far"] for r in got})


def _predictions(model: Model | None):
    def run(batches):
        for batch in batches:
            b, off = text_bytes(batch.column("text"))
            lang, score, dist = [], [], []
            for i, j in chunks(off):
                if model is None:
                    lang += [UNKNOWN] * (j - i)
                    score += [0.0] * (j - i)
                    dist += [None] * (j - i)
                    continue
                top, s, d = model.predict(gram_counts(b[off[i]:off[j]], off[i:j + 1] - off[i]))
                for r in range(i, j):
                    known = _LETTER.search(b[off[r]:off[r + 1]].tobytes().decode())
                    lang.append(model.names[top[r - i]] if known else UNKNOWN)
                    score.append(float(s[r - i]) if known else 0.0)
                    dist.append(float(d[r - i]) if known else None)
            out = [x is None or x > model.limits[v] for x, v in zip(dist, lang, strict=True)] if model else [True] * len(lang)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(dist, pa.float64()), pa.array(out, pa.bool_())],
                names=["row", "lang_pred", "score", "distance", "rejected"])
    return run


def predict(df: DataFrame, model: Model | None, keep: list[str | Column], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``df`` with lang_pred, score (0 to 1, share of
    the nearest language in a softmax of cosines), distance and rejected.

    ``und`` with score 0, rejected, for null texts and texts without a
    letter, and for all if nothing was learned. Equal texts get equal
    results; an empty table gives an empty one. The text is the only input."""
    cols = [F.col(f"`{c}`") if isinstance(c, str) else c for c in keep]
    base = df.select(F.struct(*cols).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
    schema = StructType([base.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                         StructField("distance", DoubleType()), StructField("rejected", BooleanType())])
    return base.mapInArrow(_predictions(model), schema).select("row.*", "lang_pred", "score", "distance", "rejected")
