"""Smoothing, decimation, ramps, tracked regions, alignment, solved settings and models, against plain loops."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reeltide.operators import alignment, models, smoothing, solving, tracking


def test_a_long_shot_is_smoothed_over_many_ranges(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a"] * 9 + ["b", None]), t, rng.choice([rng.random() * 9, rng.random(), None])) for t in range(700)]
    df = spark.createDataFrame(data, "shot string, t int, v double")
    got = {r.t: r.y for r in smoothing.smoothed(df, ["shot"], ["t"], F.expr("t div 10"), {"v": "y"}, 0.15, ["t"]).collect()}
    want = {}
    for shot in ("a", "b", None):
        y = None
        for s, t, v in data:
            if s == shot and v is not None:
                y = v if y is None else y + 0.15 * (v - y)
                want[t] = y
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-12 for t in want)


def test_bounds_of_an_array(spark):
    rng = random.Random(2)
    data = [([rng.random() for _ in range(n)],) for n in (1, 2, 59, 60, 61, 400)]
    low, high = smoothing.indexed_bounds("v", 3, 20)
    for r in spark.createDataFrame(data, "v array<double>").select("v", low.alias("low"), high.alias("high")).collect():
        some = sorted(r.v[::3])
        assert (r.low, r.high) == (some[len(some) // 20], some[len(some) - 1 - len(some) // 20])


@pytest.mark.parametrize("factor", [1, 2, 3])
def test_one_key_is_decimated_over_many_blocks(spark, factor):
    rng = random.Random(3)
    data = [("a", i, rng.choice([rng.random(), None])) for i in range(1500)] + [("b", i, 1.0) for i in range(7)]
    taps = smoothing.low_pass(factor, 8)
    assert abs(taps.sum() - 1) < 1e-12 and taps.size == 16 * factor + 1
    df = spark.createDataFrame(data, "k string, i int, v double")
    got = {(r.k, r.place): r.y for r in smoothing.decimated(df, ["k"], ["i"], F.expr("i div 50"), "v", factor, taps, "y", block=100).collect()}
    want = {}
    for k in "ab":
        x = np.array([v or 0.0 for kk, _, v in data if kk == k])
        full = np.convolve(x, taps[::-1])[: x.size]
        want |= {(k, n // factor): full[n] for n in range(factor - 1, x.size, factor)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ramps_between_stretches(spark):
    """Touching, overlapping, empty and open stretches; ramps longer than their stretch; before the first."""
    spans = [(1, 10, 20, 1, 5.0, 4), (1, 20, 30, 2, 9.0, 6), (1, 25, 28, 3, 1.0, 0), (1, 40, 44, 4, 7.0, 100), (1, 50, 0, 5, 2.0, 8), (1, 52, 52, 6, 99.0, 1), (2, 0, 0, 7, 3.0, 10)]
    df = spark.createDataFrame(spans, "k int, a long, b long, line int, v double, ramp long")
    points = spark.createDataFrame([(k, t) for k in (1, 2, 3) for t in range(0, 70)], "k int, t long")
    got = {(r.k, r.t): r.shape for r in smoothing.ramped(points, df, ["k"], "t", "a", "b", "line", "v", "ramp", 0.5, 8).collect()}

    def at(k, t):
        return max((s for s in spans if s[0] == k and t >= s[1] and (s[2] == 0 or t < s[2])), key=lambda s: s[3], default=None)

    for k, t in got:
        s = at(k, t)
        want = 0.5 if s is None else s[4]
        if s and t - s[1] < s[5]:
            before = at(k, s[1] - 1)
            first = before[4] if before else 0.5
            want = first + (t - s[1]) / s[5] * (s[4] - first)
        assert abs(got[k, t] - want) < 1e-12, (k, t)


def test_a_title_is_lifted_and_falls(spark):
    box, other = (0.0, 0.0, 10.0, 4.0), (50.0, 50.0, 60.0, 54.0)
    rows = [(1, p, i, *b, q) for p in range(6) for i, (b, q) in enumerate([(box, 0.9), (other, 0.2)])]
    rows += [(1, p, 0, None, None, None, None, None) for p in range(6, 16)] + [(2, 0, 0, *box, 0.6)]
    df = spark.createDataFrame(rows, "film int, picture int, i int, x0 double, y0 double, x1 double, y1 double, p double")
    got = {(r.film, r.picture, r.line): (r.lift, r.found) for r in tracking.tracked(df, ["film"], "picture", ["i"], ("x0", "y0", "x1", "y1"), "p", tracking.Rules()).collect()}
    assert [got[1, p, 0][0] for p in range(6)] == [0, 0, 0.25, 0.5, 0.75, 1.0]
    assert [got[1, p, 0] for p in (6, 7, 8)] == [(0.75, False), (0.5, False), (0.25, False)] and (1, 9, 0) not in got
    assert [got[1, p, 1][0] for p in range(6)] == [0] * 6 and (1, 7, 1) in got and (1, 8, 1) not in got and (2, 0, 0) in got


def test_regions_take_the_best_line_that_is_free():
    lines = tracking.Lines(tracking.Rules())
    lines.picture([((0, 0, 10, 10), 1.0), ((4, 0, 14, 10), 1.0)])
    told = lines.picture([((3, 0, 13, 10), 0.0), ((3, 0, 13, 10), 0.5), ((100, 0, 101, 1), 0.5)])
    assert [(i, round(p, 6)) for i, p, _, _ in told] == [(0, 0.85), (1, 0.7), (2, 0.5)]
    assert tracking.overlap((0, 0, 2, 2), (2, 0, 4, 2)) == 0 and tracking.overlap((0, 0, 2, 2), (1, 0, 3, 2)) == pytest.approx(1 / 3)


@pytest.mark.parametrize("block", [2, 256])
def test_alignment_against_all_pairs(spark, block):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randrange(200), i, rng.choice([None, [float(rng.randrange(3)) for _ in range(4)], [1.0, 1.0, 1.0, 1.0]])) for i in range(240)]
    df = spark.createDataFrame(data, "k string, t int, i int, v array<float>")
    got = {r.i: (r.m, r.m_t, r.distance) for r in alignment.aligned(df.where("i % 4 = 0"), df.where("i % 4 > 0"), ["k"], "t", "i", "v", 9, "m", block).collect()}
    for k, t, i, v in data:
        if i % 4 == 0:
            near = [] if v is None else [(sum(abs(a - b) for a, b in zip(v, w, strict=True)), s, j) for kk, s, j, w in data if kk == k and j % 4 and w is not None and abs(s - t) <= 9]
            d, s, j = min(near, default=(None, None, None))
            assert got[i] == (j, s, d)
    assert len(got) == 60


def brute_setting(sizes, target, start):
    """The rule over a dictionary of sizes."""
    points = {c: sizes[c] for c in (max(start - 6, 0), min(start + 6, 51))}

    def solve():
        p = sorted(points.items())
        i = next((i for i in range(len(p) - 1) if p[i][1] >= target >= p[i + 1][1]), 0)
        if target < p[-1][1]:
            i = len(p) - 2
        (c0, s0), (c1, s1) = p[i], p[i + 1]
        slope = (math.log(s1) - math.log(s0)) / (c1 - c0)
        return c0 + (math.log(target) - math.log(s0)) / (slope if slope < 0 else -math.log(2) / 6)

    c = solve()
    for _ in range(2):
        if any(abs(p - c) < 1.5 for p in points):
            break
        there = min(max(math.floor(c + 0.5), 0), 51)
        points[there] = sizes[there]
        c = solve()
    return sorted(points), min(max(math.ceil(c - 0.05), 0), 51)


def test_settings_for_sizes(spark):
    rng = random.Random(6)
    groups = {}
    for g in range(60):
        steep = rng.choice([0.02, 0.1, 0.2, 0.0])
        sizes = {c: 1e6 * math.exp(-steep * c - 0.002 * c * c * rng.choice([0, 1])) + (3e5 * rng.random() if g % 5 == 0 else 0) for c in range(52)}
        groups[g] = (sizes, rng.choice([1e3, 1e4, 2e5, 9e5, 5e6]), rng.randrange(0, 52))
    rows = [(g, c, s, t, st) for g, (sizes, t, st) in groups.items() for c, s in sizes.items()] + [(99, 3, 0.0, 1.0, 5), (98, 4, 5.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "g int, c int, size double, target double, start int")
    got = {r.g: (list(r.points), r.chosen) for r in solving.setting_for_size(df, ["g"], "c", "size", F.first("target"), F.first("start")).collect()}
    assert got == {g: brute_setting(*v) for g, v in groups.items()}


def test_missing_values_go_where_the_node_says(spark):
    tree = lambda left: {"base": 0.0, "trees": [[{"feature": 0, "threshold": 1.0, "left": 1, "right": 2, "nan_left": left}, {"value": -1.0}, {"value": 1.0}]]}
    df = spark.createDataFrame([(0, [0.5]), (1, [1.0]), (2, [float("nan")]), (3, [None]), (4, [])], "i int, x array<double>")
    side = lambda left: [r.s > 0.5 for r in models.tree_score(df, models.model(spark, json.dumps(tree(left)), models.TREES), F.col("x"), "s").orderBy("i").collect()]
    assert side(True) == [False, True, False, False, False] and side(False) == [False, True, True, True, True]
    with pytest.raises(ValueError):
        models.depth([{"left": 1, "right": 1}, {"left": 0, "right": 0}])
    with pytest.raises(ValueError):
        models.model(spark, " " * (models.MOST + 1), models.TREES)
    with pytest.raises(Exception):
        models.model(spark, "no model", models.TREES).collect()


def test_trees_of_unequal_depth(spark):
    rng = random.Random(7)

    def grown(deep):
        nodes = []

        def grow(d):
            at = len(nodes)
            nodes.append({})
            if d == 0 or rng.random() < 0.2:
                nodes[at] = {"value": rng.random() - 0.5}
            else:
                nodes[at] = {"feature": rng.randrange(3), "threshold": rng.random(), "nan_left": rng.random() < 0.5}
                nodes[at] |= {"left": grow(d - 1), "right": grow(d - 1)}
            return at

        grow(deep)
        return nodes

    trees = [grown(d) for d in (0, 1, 3, 6)]
    data = [(i, [rng.choice([rng.random(), float("nan"), None]) for _ in range(3)]) for i in range(200)]
    got = {r.i: r.s for r in models.tree_score(spark.createDataFrame(data, "i int, x array<double>"), models.model(spark, json.dumps({"base": 0.1, "trees": trees}), models.TREES), F.col("x"), "s").collect()}
    for i, x in data:
        total = 0.1
        for t in trees:
            n = t[0]
            while "left" in n:
                v = x[n["feature"]]
                n = t[n["left"] if (n["nan_left"] if v is None or v != v else v < n["threshold"]) else n["right"]]
            total += n["value"]
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-12
