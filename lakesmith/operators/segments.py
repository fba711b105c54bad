"""Silhouettes of clusters in closed form (ML-16, ML-23).

With squared Euclidean distances the mean distance of a point to a cluster
follows from the cluster's size, sum and sum of squared norms, so no pair of
points is ever made: |x|^2 - 2 x.S/n + Q/n. One aggregate gives these per
cluster; every point then meets the clusters, in blocks of ``BLOCK``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 2000        # clusters that travel to the tasks at once


def cluster_sums(df: DataFrame, vec: str, label: str) -> DataFrame:
    """(label, n, s, q): size, sum of the vectors, sum of squared norms."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = array_to_vector(F.col(vec).cast("array<double>"))
    norm = F.aggregate(F.transform(F.col(vec), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    g = df.select(F.col(label).alias("label"), v.alias("v"), norm.alias("q")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("v")).alias("s"), F.sum("q").alias("q"))
    return g.select("label", "n", vector_to_array("s").alias("s"), "q")


def _distances(rows: list) -> object:
    size, q = np.array([r["n"] for r in rows], float), np.array([r["q"] for r in rows])
    mean = np.array([r["s"] for r in rows]) / size[:, None]
    place = {r["label"]: i for i, r in enumerate(rows)}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("v").to_pylist(), float)
            d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ mean.T + q / size, 0)
            at = np.array([place.get(v, -1) for v in batch.column("label").to_pylist()])
            rows_ = np.flatnonzero(at >= 0)
            own, n = np.full(len(x), np.nan), np.zeros(len(x))
            own[rows_], n[rows_] = d[rows_, at[rows_]], size[at[rows_]]
            d[rows_, at[rows_]] = np.inf
            alone = n == 1
            a = np.where(alone, 0.0, own * n / np.maximum(n - 1, 1))
            least = d.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(a, mask=np.isnan(own)), pa.array(np.where(alone, 1, 0), pa.int32(), mask=np.isnan(own)),
                 pa.array(least, mask=np.isinf(least))], names=["row", "a", "alone", "b"])
    return run


def silhouettes(df: DataFrame, key: str, vec: str, label: str, block: int = BLOCK) -> DataFrame:
    """(key, label, silhouette): (b - a) / max(a, b) of every point, a the
    mean squared distance to the others of its cluster, b that to the
    nearest other cluster. 0 for a point alone in its cluster, and for all
    points if there are fewer than two clusters (label -1 is noise: it takes
    part as a group but does not count as a cluster). Keys are unique; null
    vectors and labels take no part."""
    data = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull())
    sums = cluster_sums(data, vec, label)
    groups, clusters = sums.agg(F.count(F.lit(1)), F.count_if(F.col("label").cast("string") != "-1")).first()
    row = F.struct(F.col(key).alias("key"), F.col(label).alias("label")).alias("row")
    if clusters < 2:
        return data.select(key, label, F.lit(0.0).alias("silhouette"))
    points = data.select(row, F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("v"))
    schema = T.StructType([points.schema["row"], T.StructField("a", T.DoubleType()), T.StructField("alone", T.IntegerType()),
                           T.StructField("b", T.DoubleType())])
    blocks, out = -(-groups // block), None
    for i in range(blocks):
        rows = sums.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == i).collect()      # about ``block`` clusters
        if rows:
            part = points.mapInArrow(_distances(rows), schema)
            out = part if out is None else out.unionByName(part)
    if blocks > 1:
        out = out.groupBy("row").agg(F.max("a").alias("a"), F.max("alone").alias("alone"), F.min("b").alias("b"))
    top = F.greatest("a", "b")
    value = F.when((F.col("alone") == 1) | (top == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return out.select(F.col("row.key").alias(key), F.col("row.label").alias(label), value.alias("silhouette"))


def silhouette_summary(points: DataFrame, label: str) -> DataFrame:
    """Mean silhouette, size and share of points nearer to another cluster,
    by cluster."""
    return points.groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.avg("silhouette").alias("silhouette"),
                                     F.avg((F.col("silhouette") < 0).cast("double")).alias("misplaced"))
