"""Density clusters (ML-11) on a graph of cells, in any number of dimensions.

Space is cut into cells whose diagonal is ``eps``, so all points of a cell
are neighbours of each other: a cell is one node of the graph, whatever it
holds, and a cell with ``min_pts`` points has core points only. Pairs of
points are compared only for the points of thin cells, fewer than
``min_pts`` each. Whether two cells that are near have core points within
``eps`` is settled by boxes: sub-cells whose boxes are too far apart drop
out, a pair of boxes that lies within ``eps`` as a whole links the cells,
sub-cells with few points are compared point by point, and the others are
halved again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import connected_components, cut_lineage

FEW = 4096          # pairs of points of two sub-cells that are compared outright


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _distance2(a: str, b: str, d: int) -> Column:
    return _sum([(F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(d)])


def _cell(point: str, side: float, d: int) -> Column:
    return F.array(*[F.floor(F.col(point)[i] / side) for i in range(d)])


def near_cells(cells: DataFrame, d: int) -> DataFrame:
    """(a, b): occupied cells, a <> b, whose boxes are within ``eps``.
    ``cells``: cid, cell. Blocks of cells meet their neighbouring blocks in
    up to three dimensions; the others filter."""
    reach, k = math.ceil(math.sqrt(d)), min(d, 3)
    block = F.array(*[F.floor(F.col("cell")[i] / reach) for i in range(k)])
    blocks = cells.withColumn("block", block)
    offsets = [()]
    for _ in range(k):
        offsets = [(*o, s) for o in offsets for s in (-1, 0, 1)]
    probes = F.array(*[F.array(*[F.col("block")[i] + o[i] for i in range(k)]) for o in offsets])
    a = blocks.select(F.col("cid").alias("a"), F.col("cell").alias("ca"), F.explode(probes).alias("block"))
    b = blocks.select(F.col("cid").alias("b"), F.col("cell").alias("cb"), "block")
    gaps = [F.greatest(F.abs(F.col("ca")[i] - F.col("cb")[i]) - 1, F.lit(0)) for i in range(d)]
    return a.join(b, "block").where((F.col("a") != F.col("b")) & (_sum([g * g for g in gaps]) <= d)).select("a", "b")


def linked_cells(core: DataFrame, near: DataFrame, eps: float, side: float, d: int) -> DataFrame:
    """The pairs of ``near`` (a, b) that have core points within ``eps``.
    ``core``: cid, id, p."""
    both = core.select("cid").distinct()
    todo = near.where("a < b").join(both.withColumnRenamed("cid", "a"), "a").join(both.withColumnRenamed("cid", "b"), "b")
    todo = todo.select("a", "b", F.lit(None).cast("array<long>").alias("sa"), F.lit(None).cast("array<long>").alias("sb"))
    points = core.select("cid", "p", F.lit(None).cast("array<long>").alias("sub"))
    found, eps2 = [], eps * eps
    while True:
        lo, hi = ([f(F.col("p")[i]) for i in range(d)] for f in (F.min, F.max))
        boxes = points.groupBy("cid", "sub").agg(F.count(F.lit(1)).alias("n"), F.array(*lo).alias("lo"), F.array(*hi).alias("hi"))

        def side_of(df: DataFrame, s: str) -> DataFrame:
            return df.select(F.col("cid").alias(s), F.col("sub").alias(f"s{s}"), *[F.col(c).alias(f"{c}{s}") for c in df.columns[2:]])
        x, y = side_of(boxes, "a"), side_of(boxes, "b")
        pairs = todo.join(x.withColumnRenamed("sa", "_sa"), "a").where(F.col("sa").eqNullSafe(F.col("_sa"))).drop("_sa")
        pairs = pairs.join(y.withColumnRenamed("sb", "_sb"), "b").where(F.col("sb").eqNullSafe(F.col("_sb"))).drop("_sb")
        gap = [F.greatest(F.col("loa")[i] - F.col("hib")[i], F.col("lob")[i] - F.col("hia")[i], F.lit(0.0)) for i in range(d)]
        far = [F.greatest(F.col("hia")[i] - F.col("lob")[i], F.col("hib")[i] - F.col("loa")[i]) for i in range(d)]
        pairs = cut_lineage(pairs.select("a", "b", "sa", "sb", (F.col("na") * F.col("nb")).alias("n"),
                                         (_sum([f * f for f in far]) <= eps2).alias("whole"),
                                         (_sum([g * g for g in gap]) <= eps2).alias("maybe")).where("maybe"))
        found.append(pairs.where("whole").select("a", "b").distinct())
        open_ = pairs.where("not whole").join(found[-1], ["a", "b"], "left_anti")
        few = open_.where(F.col("n") <= FEW).select("a", "b", "sa", "sb")
        pa, pb = side_of(points.select("cid", "sub", "p"), "a"), side_of(points.select("cid", "sub", "p"), "b")
        few = few.join(pa.withColumnRenamed("sa", "_sa"), "a").where(F.col("sa").eqNullSafe(F.col("_sa")))
        few = few.join(pb.withColumnRenamed("sb", "_sb"), "b").where(F.col("sb").eqNullSafe(F.col("_sb")))
        found.append(cut_lineage(few.where(_distance2("pa", "pb", d) <= eps2).select("a", "b").distinct()))
        rest = cut_lineage(open_.where(F.col("n") > FEW).join(found[-1], ["a", "b"], "left_anti").select("a", "b", "sa", "sb"))
        if rest.isEmpty():
            return reduce(lambda u, v: u.unionByName(v), found).distinct()
        side /= 2
        used = rest.select(F.col("a").alias("cid"), F.col("sa").alias("_s")).unionByName(
            rest.select(F.col("b").alias("cid"), F.col("sb").alias("_s"))).distinct()
        finer = cut_lineage(points.join(used, "cid").where(F.col("sub").eqNullSafe(F.col("_s")))
                            .select("cid", "p", _cell("p", side, d).alias("sub"), F.col("sub").alias("up")))
        tree = finer.select("cid", "up", "sub").distinct()
        ta, tb = (tree.select(F.col("cid").alias(s), F.col("up").alias("_up"), F.col("sub").alias(f"n{s}")) for s in "ab")
        todo = rest.join(ta, "a").where(F.col("sa").eqNullSafe(F.col("_up"))).drop("_up")
        todo = todo.join(tb, "b").where(F.col("sb").eqNullSafe(F.col("_up"))).select(
            "a", "b", F.col("na").alias("sa"), F.col("nb").alias("sb"))
        points = finer.select("cid", "p", "sub")


def density_clusters(df: DataFrame, key: str, columns: Sequence[str], eps: float = 0.5, min_pts: int = 5) -> DataFrame:
    """(key, columns, cluster): core points have ``min_pts`` points within
    ``eps`` (Euclidean), themselves included; clusters are what core points
    reach over core points, named by the smallest key of theirs; other
    points within ``eps`` of core points join the smallest such cluster; the
    rest, and points with a null or NaN coordinate, are noise (-1). Keys are
    unique numbers."""
    d = len(columns)
    side = eps / math.sqrt(d) * (1 - 1e-12)
    coords = [F.col(c).cast("double") for c in columns]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in coords])
    pts = cut_lineage(df.where(whole).select(F.col(key).cast("long").alias("id"), F.array(*coords).alias("p"))
                      .withColumn("cell", _cell("p", side, d)))
    cells = cut_lineage(pts.groupBy("cell").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n")))
    pts = cut_lineage(pts.join(cells, "cell").select("id", "p", "cid", "n"))
    near = cut_lineage(near_cells(cells.select("cid", "cell"), d))
    thin = pts.where(F.col("n") < min_pts)
    others = pts.select(F.col("cid").alias("b"), F.col("p").alias("q"))
    around = (thin.withColumnRenamed("cid", "a").join(near, "a").join(others, "b").where(_distance2("p", "q", d) <= eps * eps)
              .groupBy("id").agg(F.count(F.lit(1)).alias("more")))
    thin_core = thin.join(around, "id").where(F.col("n") + F.col("more") >= min_pts).select("id")
    is_core = pts.where(F.col("n") >= min_pts).select("id").unionByName(thin_core)
    core = cut_lineage(pts.join(is_core, "id").select("cid", "id", "p"))
    nodes = core.groupBy("cid").agg(F.min("id").alias("least"))
    links = linked_cells(core, near, eps, side, d)
    group = nodes.join(connected_components(links).withColumnRenamed("id", "cid"), "cid", "left").select(
        "cid", "least", F.coalesce("label", "cid").alias("component"))
    names = group.groupBy("component").agg(F.min("least").alias("cluster"))
    named = cut_lineage(group.join(names, "component").select("cid", "cluster"))
    inner = core.join(named, "cid").select("id", "cluster")
    edge = thin.join(thin_core, "id", "left_anti").withColumnRenamed("cid", "a")
    close = near.unionByName(thin.select(F.col("cid").alias("a"), F.col("cid").alias("b")).distinct())
    known = core.join(named, "cid").select(F.col("cid").alias("b"), F.col("p").alias("q"), "cluster")
    border = (edge.join(close, "a").join(known, "b").where(_distance2("p", "q", d) <= eps * eps)
              .groupBy("id").agg(F.min("cluster").alias("cluster")))
    labels = inner.unionByName(border).withColumnRenamed("id", "_id")
    return (df.select(F.col(key).cast("long").alias("_id"), F.col(key), *columns).join(labels, "_id", "left")
            .select(key, *columns, F.coalesce("cluster", F.lit(-1)).alias("cluster")))
