"""Silhouettes against all pairs."""

import numpy as np

from lakesmith.operators.segments import silhouettes


def plain(x, y):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    out = []
    for i in range(len(x)):
        own = np.array(y) == y[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][np.array(y) == c].mean() for c in set(y) - {y[i]})
        out.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return out


def test_silhouettes_equal_pairs(spark):
    rng = np.random.default_rng(6)
    y = [0] * 40 + [1] * 30 + [2] + [-1] * 5
    x = rng.normal(size=(len(y), 3)) + np.array(y)[:, None] * 2
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, y, strict=True))] + [(98, None, 1), (99, [1.0, 1.0, 1.0], None)],
                               "id long, v array<double>, c int")
    want = plain(x, y)
    for block in (2000, 1, 2):
        got = {r.id: r.silhouette for r in silhouettes(df, "id", "v", "c", block).collect()}
        assert set(got) == set(range(len(y))) and np.allclose([got[i] for i in range(len(y))], want)


def test_fewer_than_two_clusters(spark):
    df = spark.createDataFrame([(1, [0.0], 5), (2, [1.0], 5), (3, [9.0], -1)], "id long, v array<double>, c int")
    assert {r.silhouette for r in silhouettes(df, "id", "v", "c").collect()} == {0.0}
    assert silhouettes(df.limit(0), "id", "v", "c").count() == 0
