"""Candidate models: features derived once, test rows read once."""

from pyspark.ml.regression import LinearRegression

from lakesmith.operators import ml as M
from lakesmith.plans import ml_queries
from lakesmith.plans.scale import plan_text


def test_text_features_are_derived_once(spark, sf_small, monkeypatch):
    seen = []

    def stop(train, test, *rest):
        seen.extend([train, test])
        raise StopIteration
    monkeypatch.setattr(M, "fit_candidates", stop)
    try:
        ml_queries.q_ml_09(spark, sf_small)
    except StopIteration:
        pass
    assert len(seen) == 2 and all("FileScan" not in plan_text(f) for f in seen)


def test_predictions_of_all_candidates_in_one_pass(spark, tmp_path):
    spark.createDataFrame([(str(i), float(i), 2.0 * i + 1) for i in range(40)], "k string, x double, y double").write.parquet(str(tmp_path / "t"))
    df = M.assemble(spark.read.parquet(str(tmp_path / "t")), ["x"])
    cands = [("plain", LinearRegression(labelCol="y")), ("ridge", LinearRegression(labelCol="y", regParam=1.0))]
    p = M.fit_candidates(df, df, cands, "y", "k")
    assert plan_text(p).count("FileScan") == 1
    rows = {(r.model, r.row_key): r for r in p.collect()}
    assert len(rows) == 80 and p.columns == ["target", "model", "row_key", "actual", "predicted"]
    for name, est in cands:
        for r in est.fit(df).transform(df).collect():
            got = rows[name, r.k]
            assert got.target == "y" and got.actual == r.y and abs(got.predicted - r.prediction) < 1e-9
