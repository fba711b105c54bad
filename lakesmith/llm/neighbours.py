"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: several learned rotations (iterative
quantisation on the principal axes, from random starts), one bit per
rotated axis. A code is split into bytes, and each byte position is an
index table. Two codes within Hamming radius ``r`` agree within
``r // tables`` bits on one byte at least (pigeonhole), so probing the
buckets of every table that near to the query's byte retrieves every code
of the radius; the whole codes are compared, and what lies within the
radius is reranked by the Euclidean distance of the original vectors in
double precision.

The rotations and the radius are learned from a bounded sample (``SAMPLE``
vectors): the radius holds the share ``COVER`` of the true nearest
neighbours of sample queries. Every row is indexed. Rows are dealt into
partitions by hash; blocks of queries meet each partition of the index, and
only each block's best ``k`` leave it, so no hot bucket or vector gathers in
one task and nothing whole passes the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8192
SAMPLE_QUERIES = 256
ROTATIONS = 2
COVER = 0.97
BLOCK_QUERIES = 4096
BLOCK_ROWS = 65_536
_HAMMING = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


# ------------------------------------------------------------------- codes

class Codes:
    """Centre, rotation (dims x bits) and search radius."""

    def __init__(self, centre: np.ndarray, rotation: np.ndarray, radius: int):
        self.centre, self.rotation, self.radius = centre, rotation, radius

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.centre) @ self.rotation > 0, axis=1)


def _itq(x: np.ndarray, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x, full_matrices=False)
        r = (u @ vt).T
    return r


def learn(x: np.ndarray, k: int, rotations: int = ROTATIONS, cover: float = COVER) -> Codes:
    """Rotations and radius from sample vectors (rows in a fixed order)."""
    rng = np.random.default_rng(7)
    centre = x.mean(axis=0)
    z = x - centre
    axes = np.linalg.svd(z.T @ z)[0]
    p = z @ axes
    dims = x.shape[1]
    rot = np.concatenate([axes @ _itq(p, rng) for _ in range(rotations)], axis=1)
    if rot.shape[1] % 8:
        rot = np.concatenate([rot, np.zeros((dims, 8 - rot.shape[1] % 8))], axis=1)
    codes = Codes(centre, rot, rot.shape[1])
    if len(x) > 1:
        c = codes.encode(x)
        q = np.arange(min(SAMPLE_QUERIES, len(x)))
        sq = (x * x).sum(axis=1)
        d = sq[q, None] + sq[None, :] - 2 * x[q] @ x.T
        d[q, q] = np.inf
        near = np.argsort(d, axis=1)[:, :min(k, len(x) - 1)]
        ham = np.bitwise_count(c[q][:, None, :] ^ c[near]).sum(axis=2, dtype=np.int64)
        codes.radius = int(np.quantile(ham, cover, method="higher"))
    return codes


class Index:
    """Index tables of some rows: for each byte position the rows sorted
    by that byte and the place of every bucket."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, t], kind="stable") for t in range(codes.shape[1])]
        self.place = [np.searchsorted(codes[o, t], np.arange(257)) for t, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows within ``radius`` of ``code`` (pigeonhole probing)."""
        tables = self.codes.shape[1]
        step = radius // tables
        seen = np.zeros(len(self.codes), bool)
        for t in range(tables):
            # later tables may probe one bit less once radius % tables + 1 tables hold the wider ball
            reach = step if t <= radius % tables else step - 1
            if reach < 0:
                continue
            for v in np.flatnonzero(_HAMMING[code[t]] <= reach):
                seen[self.order[t][self.place[t][v]:self.place[t][v + 1]]] = True
        rows = np.flatnonzero(seen)
        ham = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64)
        return rows[ham <= radius]


def _search(codes: Codes, k: int):
    def run(_key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if queries.empty or rows.empty:
            return none
        x = np.array(rows["v"].tolist(), np.float64)
        y = np.array(queries["v"].tolist(), np.float64)
        ids = rows["vec_id"].to_numpy()
        index = Index(codes.encode(x))
        out = []
        for q, vec, code in zip(queries["vec_id"].tolist(), y, codes.encode(y), strict=True):
            near = index.within(code, codes.radius)
            near = near[ids[near] != q]
            others = int((ids != q).sum())
            if len(near) < min(k, others):      # fewer codes in the radius than asked for: take all rows of the block
                near = np.flatnonzero(ids != q)
            d = np.sqrt(((x[near] - vec) ** 2).sum(axis=1))
            top = np.lexsort((ids[near], d))[:k]
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near][top], "score": d[top]}))
        return pd.concat(out) if out else none
    return run


# ------------------------------------------------------------------ search

def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors without null, NaN or infinite components that
    are not zero. Null ids take no part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def search(rows: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS,
           block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """For each distinct query (vec_id, v): its ``k`` nearest ``rows``
    (vec_id, v) but those of its own id: query_id, rank, vec_id, score.

    Both come from :func:`usable`. Vectors of other lengths than the most
    frequent one take no part. Ties go to the smaller id; repeated rows of
    one id are one candidate; fewer rows than ``k`` give them all; no rows
    or queries give an empty result."""
    spark = rows.sparkSession
    kind = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], kind)
    dims, n = sizes
    rows = rows.where(F.size("v") == dims)
    queries = queries.where(F.size("v") == dims)
    share = min(1.0, 1.5 * sample / n)
    h = F.xxhash64("vec_id")
    got = rows.where(h < F.lit(int((2 * share - 1) * (2**63 - 1)))) if share < 1 else rows
    got = got.select(h.alias("h"), "v").orderBy("h").limit(sample).toPandas()
    codes = learn(np.array(got["v"].tolist(), np.float64), k)
    n_queries = queries.count()
    row_blocks = max(1, math.ceil(n / block_rows), min(n // 2048, spark.sparkContext.defaultParallelism))
    query_blocks = max(1, math.ceil(n_queries / block_queries))
    deal = lambda b: F.pmod(F.xxhash64(F.lit(3), "vec_id", "v"), F.lit(b)).cast("int")
    every = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    base = rows.select(deal(row_blocks).alias("rb"), every(query_blocks).alias("qb"), "vec_id", "v")
    asked = queries.distinct().select(every(row_blocks).alias("rb"), deal(query_blocks).alias("qb"), "vec_id", "v")
    best = (asked.groupBy("rb", "qb").cogroup(base.groupBy("rb", "qb"))
            .applyInPandas(_search(codes, k), "query_id long, vec_id long, score double"))
    best = best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
