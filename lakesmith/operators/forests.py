"""Forests and boosted trees of large tables, fitted on sums per cell.

Spark ML's trees tell the values of a feature apart by ``maxBins`` bins only,
and a split is chosen by the weight and the weighted label sum on its sides.
So rows that share the bins of all features, a cell, may be replaced by their
mean label with their number as weight: no split, leaf or residual changes.
The rows are read for the bins and once more for the sums; every tree is
then a Spark ML fit on cells, whose number does not grow with the rows.

* Bins: all values of a feature with ``maxBins`` distinct ones or fewer, else
  quantiles over all rows. Training rows without a finite value are an error,
  as in Spark ML; where a model is applied, NaN counts as largest.
* A forest's bags are drawn per row and tree (Poisson, by a hash of the row's
  key, so they do not depend on partitions) and summed per cell. Every tree
  is a forest of one on the sums of its bag.
* Folds are summed apart; the cells of the other folds make a training set,
  and squared errors follow from number, mean and variance in a cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import cut_lineage

MANY_ROWS = 1_000_000   # smaller tables are fitted row by row
CELLS = 1 << 18
BLOCK = 10              # bags summed in one aggregate row
ACCURACY = 10_000       # of the quantile sketch


def suits(estimator) -> bool:
    """Whether cells give the estimator's model: regression trees whose
    settings do not count rows."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    if not isinstance(estimator, (RandomForestRegressor, GBTRegressor)):
        return False
    e = estimator
    plain = (e.getMinInstancesPerNode() == 1 and e.getMinWeightFractionPerNode() == 0 and e.getSubsamplingRate() == 1.0
             and not e.isSet(e.weightCol))
    if isinstance(e, RandomForestRegressor):
        return plain and e.getBootstrap()
    return plain and e.getLossType() == "squared" and not e.isSet(e.validationIndicatorCol)


def _bag(key: Column, seed: int, tree: Column) -> Column:
    """Poisson(1) number of times that a row is in the bag of a tree."""
    h, out, total, term = F.xxhash64(key, F.lit(seed), tree), None, 0.0, math.exp(-1)
    for k in range(18):
        total += term
        bound = F.lit(int(min(total, 1.0) * 2**64 - 2**63) if total < 1 else 2**63 - 1).cast("long")
        out = F.when(h < bound, k) if out is None else out.when(h < bound, k)
        term /= k + 1
    return out.otherwise(18).cast("double")


class Grid:
    """Cells of a feature vector: inner bounds of the bins per feature."""

    def __init__(self, bounds: list[list[float]], features: str = "features"):
        self.bounds, self.features = bounds, features
        self.sizes = [len(b) + 1 for b in bounds]

    @property
    def cells(self) -> int:
        return math.prod(self.sizes)

    def with_cell(self, df: DataFrame) -> DataFrame:
        """Adds ``_cell``."""
        from pyspark.ml.feature import Bucketizer
        from pyspark.ml.functions import vector_to_array
        used = [i for i, b in enumerate(self.bounds) if b]
        if not used:
            return df.withColumn("_cell", F.lit(0).cast("long"))
        x = df.withColumn("_a", vector_to_array(self.features))
        x = x.withColumns({f"_x{i}": F.when(F.isnan(F.col("_a")[i]), float("inf")).otherwise(F.col("_a")[i]) for i in used})
        x = Bucketizer(splitsArray=[[-math.inf, *self.bounds[i], math.inf] for i in used], inputCols=[f"_x{i}" for i in used],
                       outputCols=[f"_b{i}" for i in used]).transform(x)
        cell = F.lit(0).cast("long")
        for i in used:
            cell = cell * self.sizes[i] + F.col(f"_b{i}").cast("long")
        return x.withColumn("_cell", cell).drop("_a", *[f"_x{i}" for i in used], *[f"_b{i}" for i in used])

    def vector(self) -> Column:
        """The bins of ``_cell`` as a feature vector."""
        from pyspark.ml.functions import array_to_vector
        out, left = [], F.col("_cell")
        for n in reversed(self.sizes):
            out.append((left % n).cast("double"))
            left = F.floor(left / n) if n > 1 else left
        return array_to_vector(F.array(*reversed(out)))


def grid_of(rows: DataFrame, max_bins: int, features: str = "features") -> Grid | None:
    """The grid of a table of ``MANY_ROWS`` rows or more; None for smaller ones
    and where the features make more than ``CELLS`` cells."""
    from pyspark.ml.functions import vector_to_array
    one = rows.select(F.size(vector_to_array(features))).first()
    if one is None or max(2, 2 ** one[0]) > CELLS:
        return None
    names = [f"_x{i}" for i in range(one[0])]
    x = rows.select(vector_to_array(features).alias("_a")).select(*[F.col("_a")[i].alias(c) for i, c in enumerate(names)])
    probs = [i / max_bins for i in range(1, max_bins)]
    finite = [F.abs(c) < float("inf") for c in names]       # NaN is larger
    got = x.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~ok).alias(f"not{c}") for c, ok in zip(names, finite, strict=True)], *[F.approx_count_distinct(c).alias(f"d{c}") for c in names],
                *[F.percentile_approx(c, probs, ACCURACY).alias(c) for c in names]).first()
    if got["n"] < MANY_ROWS:
        return None
    if any(got[f"not{c}"] for c in names):
        raise ValueError(f"{features} must hold neither NaN nor infinity")
    few = [c for c in names if got[f"d{c}"] <= 2 * max_bins]
    values: dict[str, list[float]] = {c: [] for c in few}
    if few:     # a few dozen values a feature
        pairs = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in few])).alias("e"))
        for r in pairs.select("e.f", "e.v").distinct().orderBy("f", "v").collect():
            values[r["f"]].append(r["v"])
    bounds = []
    for c in names:
        if c in values and len(values[c]) <= max_bins:
            v = values[c]
            cut = [a + (b - a) / 2 for a, b in zip(v[:-1], v[1:], strict=True)]
        else:
            cut = list(got[c])
        # a bound belongs to the bin below it
        cut = sorted({float(np.nextafter(b, math.inf)) for b in cut})
        bounds.append([b for b in cut if b < math.inf])
    grid = Grid(bounds, features)
    return grid if grid.cells <= CELLS else None


def cell_sums(rows: DataFrame, grid: Grid, label: str, key: str, trees: int, seed: int, fold: str | None = None) -> DataFrame:
    """(fold, block, cell, n, mean, var, w0.., s0..): rows of a cell and, for
    the trees of a block, weight and weighted label sum of their bags."""
    y = F.col(label).cast("double")
    y = F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit(f"labels in {label} must not be null or NaN"))).otherwise(y)
    x = grid.with_cell(rows).select(F.col(fold).alias("fold") if fold else F.lit(0).alias("fold"), "_cell", y.alias("_y"),
                                    F.xxhash64(key).alias("_h"))
    blocks = max(1, -(-trees // BLOCK))
    per = -(-trees // blocks)
    x = x.withColumn("block", F.explode(F.array(*[F.lit(b) for b in range(blocks)])))
    x = x.withColumns({f"_w{j}": _bag(F.col("_h"), seed, F.col("block") * per + j) for j in range(per)})
    sums = [F.sum(f"_w{j}").alias(f"w{j}") for j in range(per)]
    sums += [F.sum(F.col(f"_w{j}") * F.col("_y")).alias(f"s{j}") for j in range(per)]
    return cut_lineage(x.groupBy("fold", "block", "_cell").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), F.var_pop("_y").alias("var"), *sums))


def _without(sums: DataFrame, fold: int | None) -> DataFrame:
    """Sums of all folds but one."""
    if fold is None and "fold" not in sums.columns:
        return sums
    rest = sums if fold is None else sums.where(F.col("fold") != fold)
    cols = [c for c in sums.columns if c[0] in "ws" and c[1:].isdigit()]
    return cut_lineage(rest.groupBy("block", "_cell").agg(
        F.sum(F.col("n") * F.col("mean")).alias("total"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols]).coalesce(2))


def _cell_table(grid: Grid, spark) -> DataFrame:
    return spark.range(0, grid.cells, 1, 2).select(F.col("id").alias("_cell"), grid.vector().alias("features"))


def forest_predictions(estimator, train: DataFrame, grid: Grid, trees: int, parallelism: int = 4) -> DataFrame:
    """(_cell, features, p0..): prediction of every tree in every cell.
    ``train``: sums of the training rows."""
    per = len([c for c in train.columns if c[0] == "w"])
    strategy = estimator.getFeatureSubsetStrategy()
    if strategy == "auto":
        strategy = "all" if estimator.getNumTrees() == 1 else "onethird"

    def fit(t: int):
        w, s = F.col(f"w{t % per}"), F.col(f"s{t % per}")
        bag = train.where((F.col("block") == t // per) & (w > 0)).select(
            grid.vector().alias("features"), (s / w).alias("label"), w.alias("weight"))
        one = (estimator.copy().setNumTrees(1).setBootstrap(False).setFeatureSubsetStrategy(strategy).setWeightCol("weight")
               .setLabelCol("label").setFeaturesCol("features").setPredictionCol(f"p{t}").setSeed(estimator.getSeed() + t))
        return one.fit(bag)

    with ThreadPool(parallelism) as pool:
        models = pool.map(inheritable_thread_target(fit), range(trees))
    out = _cell_table(grid, train.sparkSession)
    for m in models:
        out = m.transform(out)
    return out


class CellModel:
    """A model whose prediction depends on the cell: (_cell, prediction)."""

    def __init__(self, grid: Grid, table: DataFrame, avg_metrics: Sequence[float] = ()):
        self.grid, self.table, self.avgMetrics = grid, table, list(avg_metrics)

    def transform(self, df: DataFrame) -> DataFrame:
        known = "_cell" in df.columns
        out = (df if known else self.grid.with_cell(df)).join(F.broadcast(self.table), "_cell")     # CELLS rows at most
        return out if known else out.drop("_cell")


def _mean(trees: int) -> Column:
    return sum((F.col(f"p{t}") for t in range(1, trees)), F.col("p0")) / trees


def fit_cells(estimator, train: DataFrame, grid: Grid, sums: DataFrame, trees: int) -> CellModel:
    """The estimator's model from the sums of its training rows."""
    if hasattr(estimator, "getNumTrees"):
        p = forest_predictions(estimator, sums, grid, trees).select("_cell", _mean(trees).alias("prediction"))
    else:
        rows = sums.where("block = 0").select(grid.vector().alias("features"), (F.col("total") / F.col("n")).alias("label"),
                                              F.col("n").cast("double").alias("weight"))
        one = (estimator.copy().setWeightCol("weight").setLabelCol("label").setFeaturesCol("features")
               .setPredictionCol("prediction"))
        p = one.fit(rows).transform(_cell_table(grid, sums.sparkSession)).select("_cell", "prediction")
    return CellModel(grid, cut_lineage(p))


def fit_all(estimators: Sequence, train: DataFrame, grid: Grid, label: str, key: str) -> list[CellModel]:
    """Models of several estimators from one pass over the rows."""
    trees = [e.getNumTrees() if hasattr(e, "getNumTrees") else 0 for e in estimators]
    seeds = {e.getSeed() for e, n in zip(estimators, trees, strict=True) if n}
    sums = {s: _without(cell_sums(train, grid, label, key, max(trees), s), None) for s in seeds or {0}}
    return [fit_cells(e, train, grid, sums[e.getSeed()] if n else next(iter(sums.values())), n)
            for e, n in zip(estimators, trees, strict=True)]


def cv_forests(folded: DataFrame, fold: str, k: int, estimators: Sequence, grid: Grid, label: str, key: str,
               parallelism: int = 4) -> CellModel:
    """Mean RMSE over the folds for every estimator, all from one pass over
    the rows; estimators that differ in the number of trees alone share
    trees. The model is the best one's, fitted on all folds."""
    most = max(e.getNumTrees() for e in estimators)
    sums = cell_sums(folded, grid, label, key, most, estimators[0].getSeed(), fold)

    def family(e) -> tuple:
        return tuple(sorted((p.name, repr(v)) for p, v in e.extractParamMap().items() if p.name != "numTrees"))

    members: dict[tuple, list[int]] = {}
    for i, e in enumerate(estimators):
        members.setdefault((*family(e), e.getNumTrees() == 1), []).append(i)
    total = [0.0] * len(estimators)
    for f in range(k):
        train, held = _without(sums, f), sums.where((F.col("fold") == f) & (F.col("block") == 0)).select("_cell", "n", "mean", "var")
        for which in members.values():
            trees = [estimators[i].getNumTrees() for i in which]
            p = forest_predictions(estimators[which[0]], train, grid, max(trees), parallelism)
            err = p.select("_cell", *[_mean(n).alias(f"m{i}") for i, n in zip(which, trees, strict=True)]).join(held, "_cell")
            got = err.agg(*[F.sqrt(F.sum(F.col("n") * (F.col("var") + (F.col("mean") - F.col(f"m{i}")) ** 2)) / F.sum("n"))
                            .alias(f"m{i}") for i in which]).first()
            for i in which:
                total[i] += got[f"m{i}"] / k
    best = min(range(len(estimators)), key=lambda i: total[i])
    model = fit_cells(estimators[best], folded, grid, _without(sums, None), estimators[best].getNumTrees())
    model.avgMetrics = total
    return model
