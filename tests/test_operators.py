"""Rules against plain loops, with the cases that break naive forms."""

import random

import numpy as np
from pyspark.sql import functions as F

from reeltide.functions import clock, numbers, text
from reeltide.operators import asof, folds, measures, pairing, selection, sequence, timeline


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_as_of_before_exactly_and_after(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 999), (2, 1)], "k int, t long")
    right = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (1, 10, "c")], "k int, t long, v string")
    got = {(r.k, r.t): r.v for r in asof.as_of(left, right, ["k"], "t", {"v": "v"}, 8).collect()}
    assert got == {(1, 5): None, (1, 10): "c", (1, 999): "b", (2, 1): None}


def test_nearest_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, 10), (1, 16), (1, 40)], "k int, t long")
    right = spark.createDataFrame([(1, 5, "early"), (1, 15, "late")], "k int, t long, v string")
    got = {r.t: r.v for r in asof.nearest(left, right, ["k"], "t", 5, {"v": "v"}).collect()}
    assert got == {10: "early", 16: "late", 40: None}


def test_interval_last_line_wins(spark):
    points = spark.createDataFrame([(1, t) for t in range(0, 60, 5)], "k int, t long")
    spans = [(1, 0, 30, 1), (1, 10, 20, 2), (1, 15, 15, 3), (1, 50, 0, 4), (1, 5, 8, 5)]
    df = spark.createDataFrame(spans, "k int, a long, b long, line int")
    got = {r.t: r.line for r in asof.interval_last(points, df, ["k"], "t", "a", "b", "line", 7).collect()}
    want = {}
    for t in range(0, 60, 5):
        hits = [n for _, a, b, n in spans if t >= a and (b == 0 or t < b)]
        want[t] = max(hits) if hits else None
    assert got == want


def test_holes_bounds(spark):
    times = [0, 10, 25, 41, 41 + 300, 41 + 300 + 301]
    df = spark.createDataFrame([(1, t) for t in times], "k int, t long")
    got = {r.t: r.missing for r in sequence.holes(df, ["k"], ["t"], "t", 10, 300).collect()}
    assert got == {0: 0, 10: 0, 25: 0, 41: 1, 341: 29, 642: 0}


def test_overlapping_cues(spark):
    cues = [(1, 0, 10), (1, 5, 8), (1, 6, 12), (1, 20, 20), (1, 30, 31)]
    df = spark.createDataFrame(cues, "k int, a long, b long")
    got = sorted((r.begin, r.finish, r.gap) for r in sequence.clipped(df, ["k"], ["a", "b"], "a", "b").collect())
    assert got == [(0, 10, False), (10, 12, False), (12, 30, True), (30, 31, False)]


def test_display_order_with_resets(spark):
    df = spark.createDataFrame([(1, i, p, r) for i, (p, r) in enumerate([(0, True), (4, False), (2, False), (0, True), (1, False)])], "k int, i int, poc int, reset boolean")
    got = [r.d for r in sequence.display_order(df, ["k"], ["i"], F.col("reset"), "poc", "d").orderBy("i").collect()]
    assert got == [0, 2, 1, 3, 4]


def test_unwrap(spark):
    true = [5, 7, 14, 17, 15, 18, 33]
    df = spark.createDataFrame([(1, i, t % 16) for i, t in enumerate(true)], "k int, i int, t long")
    assert [r.u for r in sequence.unwrapped(df, ["k"], ["i"], "t", 4, "u").orderBy("i").collect()] == true[:6] + [true[6] - 16]


def test_clusters_restart_from_their_own_first_row(spark):
    rng = random.Random(3)
    data = [(k, rng.randrange(0, 2000), rng.random() < 0.3, i) for i, k in enumerate([1, 2] * 200)]
    df = spark.createDataFrame(data, "k int, t long, key boolean, i int")
    got = {r.i: r.cluster for r in folds.clusters(df, ["k"], ["i"], "t", "key", ["i"], 60, 150, 30).collect()}
    want = {}
    for k in (1, 2):
        start = None
        for _, t, key, i in (d for d in data if d[0] == k):
            if start is None:
                n, start = 0, t
            elif t - start >= 150 or t - start <= -30 or (key and t - start >= 60):
                n, start = n + 1, t
            want[i] = n
    assert got == want and any(b[1] < a[1] for a, b in zip(data[::2], data[2::2]))


def test_folds_take_nulls_as_they_are(spark):
    df = spark.createDataFrame([(None, 0, False, 0), (None, 100, False, 1), (None, 160, True, 2), (None, None, True, 3), (None, 400, False, 4), (2**60 + 1, 5, None, 5), (2**60 + 1, 500, True, 6)], "k long, t long, key boolean, i int")
    got = {r.i: (r.k, r.cluster) for r in folds.clusters(df, ["k"], ["i"], "t", "key", ["i"], 150, 300, 30).collect()}
    assert got == {0: (None, 0), 1: (None, 0), 2: (None, 1), 3: (None, 1), 4: (None, 1), 5: (2**60 + 1, 0), 6: (2**60 + 1, 1)}


def test_lookups_keep_rows_with_nulls(spark):
    left = spark.createDataFrame([(1, 10, None, "a"), (1, 50, 3, None), (None, 10, None, None), (1, None, None, "z")], "k int, t long, x int, s string")
    near = spark.createDataFrame([(1, 12, 7), (None, 10, 9), (1, 48, None)], "k int, t long, n int")
    got = sorted(rows(asof.nearest(left, near, ["k"], "t", 5, {"n": "n"}).select("t", "s", "n")), key=str)
    assert got == sorted([(10, "a", 7), (50, None, None), (10, None, None), (None, "z", None)], key=str)
    spans = spark.createDataFrame([(1, 0, 100, 7), (1, 5, 0, 2), (1, 9, 11, 9)], "k int, a long, b long, line int")
    got = sorted(rows(asof.interval_last(left, spans, ["k"], "t", "a", "b", "line", 4).select("t", "s", "line")), key=str)
    assert got == sorted([(10, "a", 9), (50, None, 7), (10, None, None), (None, "z", None)], key=str)


def test_spans_of_all_lengths_against_brute_force(spark):
    rng = random.Random(19)
    spans = [(1, a := rng.randrange(0, 5000), a + rng.choice([1, 3, 40, 700, 4000]) if rng.random() < 0.9 else 0, i) for i in range(120)]
    points = [(1, t) for t in rng.sample(range(6000), 300)]
    got = {r.t: r.line for r in asof.interval_last(spark.createDataFrame(points, "k int, t long"), spark.createDataFrame(spans, "k int, a long, b long, line int"), ["k"], "t", "a", "b", "line", 10).collect()}
    assert got == {t: max((i for _, a, b, i in spans if a <= t and (b == 0 or t < b)), default=None) for _, t in points}


def test_hysteresis(spark):
    rng = random.Random(5)
    data = [(1, i, rng.random() < 0.5, rng.random() < 0.05) for i in range(300)]
    df = spark.createDataFrame(data, "k int, i int, flag boolean, fresh boolean")
    got = [r.factor for r in folds.hysteresis(df, ["k"], ["i"], "flag", "fresh", ["i"], 3, 4).orderBy("i").collect()]
    want, flat, run, factor = [], None, 0, 1.0
    for _, _i, f, fresh in data:
        if flat is None or fresh:
            flat, run, factor = f, 0, 0.0 if f else 1.0
        else:
            if f != flat:
                run += 1
                if run >= 3:
                    flat, run = f, 0
            else:
                run = 0
            aim = 0.0 if flat else 1.0
            factor = min(factor + 0.25, aim) if factor < aim else max(factor - 0.25, aim)
        want.append(factor)
    assert got == want


def test_title_scan_is_not_a_sort(spark):
    data = [(1, "00001", 100.0, 1, 1), (1, "00002", 105.0, 0, 1), (1, "00003", 111.0, 0, 1)]
    df = spark.createDataFrame(data, "k int, name string, length double, chapters int, items int")
    assert rows(folds.tolerant_best(df, ["k"], "name", "length", "chapters", "items", 10.0)) == [(1, "00003")]


def test_a_flat_title_is_taken_before_one_of_the_same_film_in_3d(spark):
    data = [(1, "00001", 100.0, 5, 1, True), (1, "00002", 100.5, 5, 3, False), (1, "00003", 100.0, 4, 1, False)]
    df = spark.createDataFrame(data, "k int, name string, length double, chapters int, items int, both boolean")
    pick = lambda other: rows(folds.tolerant_best(df, ["k"], "name", "length", "chapters", "items", 1.0, other))
    assert pick("both") == [(1, "00002")] and pick(None) == [(1, "00001")]


def test_element_ranks_at_the_edges(spark):
    for n in (1, 99, 100, 101):
        df = spark.createDataFrame([(1, float(i)) for i in range(n)], "k int, v double")
        got = measures.element_at_rank(df, ["k"], "v", F.floor(F.col("n") / 100), "p1").first()
        assert (got.n, got.p1) == (n, float(n // 100))


def test_ranks_between_bounds_are_those_of_a_sort(spark, monkeypatch):
    rng = random.Random(23)
    data = [(k, rng.choice([rng.random(), float(rng.randrange(5)), None])) for k, n in ((1, 9000), (2, 150), (None, 5000), (3, 1)) for _ in range(n)] + [(4, 7.0)] * 6000
    df = spark.createDataFrame(data, "k int, v double").repartition(7)
    for place, near, at in ((F.floor(F.col("n") / 100), 0.01, lambda n: n // 100), (F.col("n") - 1 - F.floor(F.col("n") / 100), 0.99, lambda n: n - 1 - n // 100), (F.floor(F.col("n") / 2), 0.5, lambda n: n // 2)):
        for groups in (0, 100_000):
            monkeypatch.setattr(measures, "GROUPS", groups)
            got = {r.k: (r.n, r.x) for r in measures.element_at_rank(df, ["k"], "v", place, "x", near).collect()}
            for k in {d[0] for d in data}:
                vs = sorted(v for g, v in data if g == k and v is not None)
                assert not vs or got[k] == (len(vs), vs[at(len(vs))])


def test_trim_item_wholly_outside(spark):
    df = spark.createDataFrame([(1, i, 10) for i in range(4)], "k int, i int, length long")
    got = [(r.low, r.high, r.offset) for r in timeline.trimmed(df, ["k"], ["i"], "length", 12, 20).orderBy("i").collect()]
    assert got == [(0, 0, 0), (2, 10, 0), (0, 0, 8), (0, 0, 8)]


def test_fallbacks_are_used_once(spark):
    kept = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "k int, id int")
    offered = spark.createDataFrame([(1, 10, 9), (1, 20, 5), (1, 21, 7)], "k int, id int, q int")
    assert sorted(rows(selection.fallbacks(kept, offered, ["k"], "id", [F.col("q")]).select("kept_id", "fallback_id"))) == [(10, 21), (11, 20)]


def test_tracks_without_a_language_fall_back_on_one_another(spark):
    kept = spark.createDataFrame([(1, None, 10), (1, "eng", 11)], "k int, lang string, id int")
    offered = spark.createDataFrame([(1, None, 10, 9), (1, None, 20, 5), (1, "fra", 21, 7)], "k int, lang string, id int, q int")
    assert rows(selection.fallbacks(kept, offered, ["k", "lang"], "id", [F.col("q")])) == [(1, None, 10, 20)]


def test_guard_fails_on_an_empty_choice(spark):
    df = spark.createDataFrame([(1, "eng"), (2, "fra")], "k int, lang string")
    keep = selection.language(F.col("lang")) == "eng"
    try:
        selection.guarded(df, keep, ["k"]).collect()
    except Exception as e:
        assert "no track" in str(e)
    else:
        raise AssertionError("it must fail")
    assert selection.guarded(df, keep, ["k"], none_asked=True).count() == 0


def test_first_match_in_order(spark):
    df = spark.createDataFrame([("A_EAC3",), ("A_AC3",), ("A_X",)], "c string")
    got = [r[0] for r in df.select(selection.first_match(F.col("c"), [("eac3", 2), ("ac3", 1)], 0)).collect()]
    assert got == [2, 1, 0]


def test_pairing_first_dependent_or_none(spark):
    base = spark.createDataFrame([(1, 0), (1, 1), (1, None)], "k int, dts long")
    dep = spark.createDataFrame([(1, 0, 7), (1, 0, 8)], "k int, dts long, id int")
    got = sorted(((r.dts, r.d) for r in pairing.paired(base, dep, ["k", "dts"], ["id"], {"id": "d"}).collect()), key=str)
    assert got == [(0, 7), (1, None), (None, None)]


def test_monotone_cubic_goes_through_its_points():
    x, y = np.array([1.0, 2, 4, 7]), np.array([0.0, 1, 1.5, 4])
    at, low, high = measures._monotone(x, y)
    assert (low, high) == (1, 7) and np.allclose(at(x), y)
    assert np.all(np.diff(at(np.linspace(1, 7, 200))) >= -1e-12)


def test_clock_text_and_back(spark):
    df = spark.createDataFrame([("1:02:03.5", 3723500), ("90", 90000), ("1h30m", 5400000), ("59:60", None), ("x", None), ("2m", 120000)], "s string, ms long")
    assert [(r[0], r[1]) for r in df.select(clock.parse_clock(F.col("s")), "ms").collect()] == [(m, m) for _, m in [("", 3723500), ("", 90000), ("", 5400000), ("", None), ("", None), ("", 120000)]]


def test_text_rules(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(text.without_overrides(F.lit("0,0,Default,,0,0,0,,{\\i1}Hi, all{\\i0}\\Nthere"))) == "Hi, all\nthere"
    assert pick(text.without_markup(F.lit("<i>1 < 2</i> and 3 > 2 <b class=x>now</b>\r\n"))) == "1 < 2 and 3 > 2 now"
    assert pick(text.slug(F.lit("TrueHD Atmos"))) == "TrueHD-Atmos"
    assert pick(text.with_details(F.lit("/a/Film 3D FSBS.mkv"), F.lit("3D FSBS 1080p"))) == "/a/Film 3D FSBS 1080p.mkv"
    assert pick(text.parse_list(F.lit(" a, ,b,"))) == ["a", "b"]
    assert pick(numbers.greedy_labels(F.array(*[F.lit(float(v)) for v in (0, 1, 0, 0, 1, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1)]), 3)) == [1, 1, 2]
    assert pick(numbers.size_bytes(F.lit("3 GiB"))) == 3 << 30
