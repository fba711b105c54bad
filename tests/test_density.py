"""Density clusters against brute force."""

import math

import numpy as np
import pytest

from lakesmith.operators.density import density_clusters


def brute(points, eps, least):
    ids = sorted(points)
    p = np.array([points[i] for i in ids])
    near = ((p[:, None, :] - p[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label = {}
    for k in range(len(ids)):
        if core[k] and k not in label:
            todo, label[k] = [k], ids[k]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if j not in label:
                        label[j] = ids[k]
                        todo.append(j)
    out = {}
    for k, i in enumerate(ids):
        mine = [label[k]] if core[k] else [label[j] for j in np.flatnonzero(near[k] & core)]
        out[i] = min(mine, default=-1)
    return out


def run(spark, points, eps, least):
    d = len(next(iter(points.values())))
    cols = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in points.items()], ", ".join(["id long", *[f"{c} double" for c in cols]]))
    return {r.id: r.cluster for r in density_clusters(df, "id", cols, eps, least).collect()}


@pytest.mark.parametrize("d,eps", [(1, 0.05), (2, 0.5), (3, 0.8)])
def test_three_blobs_and_noise(spark, d, eps):
    rng = np.random.default_rng(d)
    blobs = [rng.normal(c, 0.4, (150, d)) for c in (0, 2, 6)]
    points = dict(enumerate(np.concatenate([*blobs, rng.uniform(-3, 9, (60, d))]).tolist()))
    assert run(spark, points, eps, 5) == brute(points, eps, 5)


def test_grid_points_at_exactly_eps(spark):
    points = {k: (0.5 * (k % 12), 0.5 * (k // 12)) for k in range(60)}
    points |= {100: (20.0, 20.0), 101: (20.0, 20.0), 102: (20.0, 20.0)}       # equal points
    assert run(spark, points, 0.5, 3) == brute(points, 0.5, 3)
    assert run(spark, points, 0.5, 4) == brute(points, 0.5, 4)


def test_full_cells_make_no_pairs(spark):
    """Two cells of 50,000 points each, linked by one pair of points at
    their borders, and two that are just too far apart."""
    rng = np.random.default_rng(1)
    side = 1 / math.sqrt(2)
    a = rng.uniform(0.02, 0.2, (50_000, 2)) * side
    b = a + [0, 1.25]
    points = np.concatenate([a, b, [[0.1, 0.65], [0.1, 0.68]], a[:2000] + [40, 0], a[:2000] + [40, 1.3]])
    df = spark.createDataFrame(enumerate(points.tolist()), "id long, p array<double>").selectExpr("id", "p[0] x", "p[1] y")
    got = {r.id: r.cluster for r in density_clusters(df, "id", ["x", "y"], 1.0, 5).collect()}
    assert {got[i] for i in range(100_002)} == {0}
    assert {got[i] for i in range(100_002, 102_002)} == {100_002}
    assert {got[i] for i in range(102_002, 104_002)} == {102_002}


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, float("nan"), 0.0), (3, 0.0, 0.0), (4, 0.1, 0.0)], "id long, x double, y double")
    assert {r.id: r.cluster for r in density_clusters(df, "id", ["x", "y"], 0.5, 2).collect()} == {1: -1, 2: -1, 3: 3, 4: 3}
    assert density_clusters(df.limit(0), "id", ["x", "y"]).count() == 0
