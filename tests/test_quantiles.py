import numpy as np

from lakesmith.functions.quantiles import exact_quantiles, kth_values, rank_quantiles


def test_kth_values_refinement_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = rng.normal(size=5000).round(3).tolist() + [5.0] * 300      # ties included
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    s = np.sort(vals)
    ks = [0, 1, 1234, 2500, 4999, 5299]
    got = kth_values(df, "x", ks)
    assert got == {k: float(s[k]) for k in ks}


def test_exact_quantiles_interpolate_like_numpy(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 1000.0]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    got = exact_quantiles(df, "x", [0.25, 0.5, 0.75])
    assert np.allclose(got, np.percentile(vals, [25, 50, 75]))


def test_rank_quartiles_use_sorted_index(spark):
    vals = list(range(1, 11))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    q1, q3 = rank_quantiles(df, "x", [(1, 4), (3, 4)])
    assert (q1, q3) == (3.0, 8.0)        # sorted[10 // 4], sorted[30 // 4]


def test_grouped_quantiles_exact_with_hot_group(spark):
    from lakesmith.functions.quantiles import grouped_quantiles
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.normal(size=6000).round(2)] + \
           [("cold", float(v)) for v in [1, 2, 2, 2, 9]] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.a, r.b, r.c) for r in grouped_quantiles(df, ["g"], "x", [0.25, 0.5, 0.95], ["a", "b", "c"]).collect()}
    for g in ("hot", "cold", "one"):
        vals = [v for k, v in rows if k == g]
        assert np.allclose(got[g], np.percentile(vals, [25, 50, 95])), g
