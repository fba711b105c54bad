"""Forests on sums per cell: models as from rows, fits that see cells only."""

import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from lakesmith.operators import forests
from lakesmith.operators import ml as M


@pytest.fixture
def rows(spark, tmp_path, monkeypatch):
    """4,000 rows: few values, one of them rare; skewed and continuous ones."""
    monkeypatch.setattr(forests, "MANY_ROWS", 1)
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    df = spark.range(4000).select(
        F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") == 7, 50.0).otherwise((F.col("id") % 7).cast("double")).alias("a"),
        (F.col("id") % 11).cast("double").alias("b"),
        F.when(F.col("id") % 3 > 0, 0.0).otherwise(h).alias("c"))
    df = df.withColumn("y", 10 * F.col("a") + F.col("b") * F.col("a") + 40 * F.col("c"))
    df.write.parquet(str(tmp_path / "t"))
    return M.assemble(spark.read.parquet(str(tmp_path / "t")), ["a", "b", "c"])


@pytest.fixture
def fitted(monkeypatch):
    """Rows that fits of forests and boosted trees were given."""
    seen = []
    for cls in (RandomForestRegressor, GBTRegressor):
        real = cls._fit
        monkeypatch.setattr(cls, "_fit", lambda self, d, real=real: (seen.append(d.count()), real(self, d))[1])
    return seen


def test_boosted_trees_of_few_values_are_those_of_the_rows(rows, fitted):
    rows = M.assemble(rows.drop("features"), ["a", "b"])
    est = GBTRegressor(labelCol="y", maxIter=4, seed=42)
    p = M.fit_candidates(rows, rows, [("boosted", est)], "y", "k")
    got = {r.row_key: r.predicted for r in p.collect()}
    assert max(fitted) <= 8 * 11
    for r in est.fit(rows).transform(rows).collect():
        assert got[r.k] == pytest.approx(r.prediction, abs=1e-6)


def test_forest_and_cross_validation_on_cells(rows, fitted, monkeypatch):
    rf = RandomForestRegressor(labelCol="y", seed=42)
    grid = ParamGridBuilder().addGrid(rf.numTrees, [4, 8]).addGrid(rf.maxDepth, [2, 5]).build()
    model, avg = M.cv_scores(rows, rf, "y", "k", k=3, grid=grid)
    cells = forests.grid_of(rows, 32).cells
    assert len(fitted) == 3 * 2 * 8 + 8 and max(fitted) <= min(cells, 1500)
    # squared errors from sums are those of the rows
    got = model.transform(rows).agg(F.count("prediction"), F.corr("prediction", "y")).first()
    assert got[0] == 4000 and got[1] > 0.8
    monkeypatch.setattr(forests, "MANY_ROWS", 10**9)
    _, by_rows = M.cv_scores(rows, rf, "y", "k", k=3, grid=grid)
    for x, y in zip(avg, by_rows, strict=True):
        assert x == pytest.approx(y, rel=0.25)


def test_grid_bounds_and_refusals(rows, spark):
    grid = forests.grid_of(rows, 32)
    assert grid.sizes[0] == 8 and grid.sizes[1] == 11 and 2 < grid.sizes[2] <= 32
    cells = grid.with_cell(rows).groupBy("a", "b").agg(F.countDistinct((F.col("_cell") / grid.sizes[2]).cast("long")).alias("n"))
    assert {r.n for r in cells.collect()} == {1}
    zero = grid.with_cell(rows).groupBy((F.col("_cell") % grid.sizes[2]).alias("bin")).agg(F.countDistinct(F.col("c") == 0).alias("n"))
    assert {r.n for r in zero.collect()} == {1}
    assert not forests.suits(RandomForestRegressor(minInstancesPerNode=5)) and not forests.suits(GBTRegressor(subsamplingRate=0.5))
    wide = M.assemble(rows.select("y", "k", *[(F.col("c") * i).alias(f"x{i}") for i in range(1, 20)]), [f"x{i}" for i in range(1, 20)])
    assert forests.grid_of(wide, 32) is None
    holes = M.assemble(rows.select("k", "y", F.when(F.col("a") > 0, F.col("a")).alias("a")), ["a"])
    with pytest.raises(ValueError, match="NaN"):
        forests.grid_of(holes, 32)


def test_bags_have_the_moments_of_a_bootstrap(spark):
    w = spark.range(40000).select(forests._bag(F.xxhash64("id"), 42, F.lit(3)).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert w[0] == pytest.approx(1, abs=0.03) and w[1] == pytest.approx(1, abs=0.05)
