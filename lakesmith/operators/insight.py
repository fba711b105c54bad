"""Insight jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_divide


def period_change(df: DataFrame, period: str, metric: str, dim: str, top: int = 3) -> DataFrame:
    """INS-01: per period and segment the metric total, its change from the
    previous period, the share of the period's total change, and the
    ``top`` segments by absolute change (rank 1 = largest contributor)."""
    g = df.groupBy(period, dim).agg(F.sum(metric).alias("value"))
    w = Window.partitionBy(dim).orderBy(period)          # periods per segment: bounded
    c = g.withColumn("change", F.col("value") - F.lag("value").over(w)).where(F.col("change").isNotNull())
    tot = c.groupBy(period).agg(F.sum("change").alias("total_change"))
    r = Window.partitionBy(period).orderBy(F.desc(F.abs("change")), F.asc(dim))
    return (c.join(tot, period)
            .withColumn("share_of_change", safe_divide(F.col("change"), F.col("total_change"), None))
            .withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= top))


def cross_source_corr(a: DataFrame, b: DataFrame, on: str, cols_a: Sequence[str], cols_b: Sequence[str]) -> DataFrame:
    """INS-02: join two daily metric tables on the day and correlate every
    metric of one with every metric of the other (one aggregate)."""
    j = a.join(b, on)
    pairs = [(x, y) for x in cols_a for y in cols_b]
    row = j.agg(*[F.corr(x, y).alias(f"r{i}") for i, (x, y) in enumerate(pairs)],
                F.count(F.lit(1)).alias("days"))
    s = [F.struct(F.lit(x).alias("metric_a"), F.lit(y).alias("metric_b"), F.col(f"r{i}").alias("r"))
         for i, (x, y) in enumerate(pairs)]
    return row.select("days", F.explode(F.array(*s)).alias("s")).select("s.*", "days")
