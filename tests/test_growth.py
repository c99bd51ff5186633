"""Steps whose work must not grow faster than their rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from reeltide.functions import tracks
from reeltide.operators import measures, tracking


def greedy(boxes, regions, least):
    """What each region takes, by a plain loop over all boxes."""
    taken, out = set(), []
    for region in regions:
        best, place = max([(tracking.overlap(b, region), -i) for i, b in enumerate(boxes) if i not in taken], default=(0.0, 0))
        out.append(-1 if best < least or best == 0 else -place)
        taken.add(out[-1])
    return out


def test_free_lines_are_those_of_a_plain_loop():
    rng = random.Random(6)
    for least in (0.0, 0.1, 0.3, 0.5, 1.0):
        for _ in range(60):
            scale = rng.choice([1e-3, 1.0, 7.0, 1e6])
            size = lambda: rng.choice([0, 1, 2, 4, 4, 8, rng.random() * 16, -1])  # noqa: E731, B023
            made = []
            for _ in range(80):
                x, y = rng.randrange(-12, 12) * rng.choice([1, 1, 0.37]), rng.randrange(-6, 6)
                made.append(tuple(v * scale for v in (x, y, x + size(), y + size())))
            free = tracking.Free(made[:40], least)
            assert [free.take(b) for b in made[40:]] == greedy(made[:40], made[40:], least)


def test_a_picture_of_many_regions_compares_those_that_are_near(monkeypatch):
    calls, overlap = [0], tracking.overlap

    def counted(a, b):
        calls[0] += 1
        return overlap(a, b)

    monkeypatch.setattr(tracking, "overlap", counted)
    lines = tracking.Lines(tracking.Rules())
    regions = [((10.0 * (i % 40), 0.0, 10.0 * (i % 40) + 12, 12.0), 0.5) for i in range(1000)]
    lines.picture(regions)
    assert len(lines.picture(regions)) == 1000 and calls[0] < 20 * len(regions)


def analyzed(spark, column):
    return spark.range(1).select(column.alias("c"))._jdf.queryExecution().analyzed().toString()


def test_a_rate_is_reduced_once(spark):
    assert analyzed(spark, tracks.normal_rate(F.col("id") + 1, F.col("id") + 2)).count("aggregate(") == 1


def test_sums_of_a_rising_curve_are_made_once(spark):
    assert analyzed(spark, measures.rising(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0)))).count("aggregate(") == 1


def test_a_curve_is_read_at_one_piece(spark):
    at, values = [0.0, 1.0, 1.0, 2.5, 4.0], [1.0, 2.0, 2.0, 2.0, 7.0]
    x = [-1.0, 0.0, 0.25, 1.0, 1.7, 2.5, 3.0, 4.0, 9.0]
    df = spark.createDataFrame([(v, at, values) for v in x], "x double, at array<double>, v array<double>")
    got = df.select(measures.along(F.col("x"), "at", "v").alias("y"))
    assert np.allclose([r.y for r in got.collect()], np.interp(x, at, values))
    assert "aggregate(" not in got._jdf.queryExecution().analyzed().toString()
