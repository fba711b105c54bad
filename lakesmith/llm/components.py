"""Connected components of a large edge list, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b)
    can reach, by alternating large-star and small-star steps until the
    edges stop changing (a number of rounds like the logarithm of the
    longest path). Each round is written to a shared table. A hub is
    aggregated before it is joined, so AQE can split its edges."""
    scratch, turn = Scratch(edges.sparkSession), 0
    cur = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "edges-0")
    state = _state(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        turn += 1
        cur = scratch.table(small.select("e.u", "e.v").where("u <> v").distinct(), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
        now = _state(cur)
        if now == state:
            break
        state = now
    stars = cur.groupBy("u").agg(F.min("v").alias("component"))
    return (stars.select(F.col("u").alias("id"), "component")
            .unionByName(stars.select(F.col("component").alias("id"), "component").distinct()))


def _state(edges: DataFrame) -> tuple:
    """Number and content hash of the edges (order-free)."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
