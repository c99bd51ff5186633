"""Dual ridge against the primal solution, and plane maps with planted outliers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reeltide.operators import fitting


def test_dot_products_of_many_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(k, i, rng.normal(size=6).tolist()) for k in ("a", "b") for i in range(25 if k == "a" else 1)] + [("a", 99, None)]
    got = {(r.k, r.a, r.b): r.dot for r in fitting.gram(spark.createDataFrame(data, "k string, i int, v array<double>"), ["k"], "i", "v", block=4).collect()}
    want = {(k, i, j): float(np.dot(v, w)) for k, i, v in data for kk, j, w in data if k == kk and i <= j and v and w}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_dual_ridge_is_the_primal_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(k, i, rng.normal(size=30).tolist(), float(rng.normal())) for k in (1, 2, 3) for i in range(4 + 5 * k)]
    df = spark.createDataFrame([*data, (1, 100, None, 1.0), (1, 101, [0.0] * 30, None)], "k int, i int, v array<float>, y double")
    got = {(r.k, r.place): (r.weight, r.intercept) for r in fitting.dual_ridge(df, ["k"], "i", "v", "y", 0.7).collect()}
    for k in (1, 2, 3):
        x, y = np.array([v for kk, _, v, _ in data if kk == k], np.float32).astype(float), np.array([t for kk, _, _, t in data if kk == k])
        w = np.linalg.solve(x.T @ x + 0.7 * np.eye(30), x.T @ (y - y.mean()))
        assert all(abs(got[k, p][0] - w[p]) < 1e-9 and abs(got[k, p][1] - y.mean()) < 1e-12 for p in range(30))
    monkeypatch.setattr(fitting, "ROWS", 3)
    with pytest.raises(ValueError):
        fitting.dual_ridge(df, ["k"], "i", "v", "y", 0.7)


def test_maps_are_recovered_among_outliers(spark):
    rng = random.Random(3)
    truth = {"a": [1.1, 0.05, 3.0, -0.04, 0.95, -2.0, 1e-4, -2e-4], "b": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]}
    data = []
    for k, h in truth.items():
        for i in range(400):
            x, y = rng.uniform(0, 500), rng.uniform(0, 300)
            w = h[6] * x + h[7] * y + 1
            u, v = (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w
            if i % 5 < 2:  # 40 % are elsewhere
                u, v = rng.uniform(0, 500), rng.uniform(0, 300)
            data.append((k, i, x, y, u + rng.gauss(0, 0.05), v + rng.gauss(0, 0.05)))
    data += [("few", i, 1.0, 1.0, 1.0, 1.0) for i in range(10)] + [("one place", i, 1.0, 1.0, 1.0, 1.0) for i in range(60)] + [("a", 999, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "k string, i int, x double, y double, u double, v double")
    run = lambda: {r.k: r for r in fitting.homographies(df, ["k"], ["i"], F.expr("i div 64"), ("x", "y", "u", "v"), 1.0, tries=60).collect()}
    got = run()
    assert set(got) == {"a", "b"} and {k: (r.map, r.inliers) for k, r in run().items()} == {k: (r.map, r.inliers) for k, r in got.items()}
    for k, h in truth.items():
        assert 240 <= got[k].inliers <= 260 and got[k].points == 400
        for x, y in ((0, 0), (500, 300), (250, 10)):
            to = lambda m: np.array([m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]]) / (m[6] * x + m[7] * y + 1)
            assert np.abs(to(h) - to(got[k].map)).max() < 0.2


def test_errors_of_what_was_left_out(spark):
    from reeltide.operators import measures

    rng = np.random.default_rng(5)
    data = [(g, float(x), float(3 * x + 2 + (10 if g == "odd" else 0)), 1.0) for g in ("a", "b", "odd") for x in rng.normal(size=50)]
    got = {r.g: r for r in measures.ridge_errors(spark.createDataFrame(data, "g string, x double, y double, w double"), ["x"], "y", "w", 1e-6, "g").collect()}
    assert all(r.rows == 50 for r in got.values()) and abs(got["odd"].bias - 10) < 1e-2 and abs(got["odd"].mean_error - 10) < 1e-2 and got["a"].bias < -3


@pytest.mark.parametrize("high", [True, False])
def test_measures_from_the_worst_end(spark, high):
    from reeltide.operators import measures

    rng = random.Random(6)
    data = [(k, rng.choice([rng.random(), 0.5])) for k, n in (("one", 1), ("few", 99), ("many", 6000)) for _ in range(n)] + [("few", None), ("few", float("nan"))]
    got = {r.k: r for r in measures.from_worst(spark.createDataFrame(data, "k string, v double"), ["k"], "v", high).collect()}
    for k in got:
        own = sorted((v for kk, v in data if kk == k and v is not None and v == v), reverse=high)
        assert (got[k].n, got[k].tail, got[k].worst) == (len(own), own[len(own) // 100], own[0]) and abs(got[k].mean - sum(own) / len(own)) < 1e-5
