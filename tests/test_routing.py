"""Kinds, names, defaults, windows of packets, edges and clocks: the cases that break naive forms."""

from pyspark.sql import functions as F

from reeltide.functions import tracks
from reeltide.operators import routing


def column(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_kinds_and_names(spark):
    got = column(spark, [("V_MPEG2",), ("V_MPEG4/ISO/MVC",), ("V_MPEGH/ISO/HEVC/EL",), ("A_X",), ("S_X",), ("Z",), (None,)], "s string", tracks.kind(F.col("s")))
    assert [k for (k,) in got] == ["base", "dependent", "enhancement", "audio", "subtitles", "other", "other"]
    rows = [("TrueHD", "Atmos Channels: 7.1"), ("DTS-HD Master", "Channels: 6"), ("dts-hd", ""), ("E-AC3", "channels: 5.1"), ("ac3", None), ("raw PCM", "x"), ("Opus / 2", "Channels: 2")]
    assert [t for (t,) in column(spark, rows, "a string, b string", tracks.audio_tag(F.col("a"), F.col("b")))] == ["TrueHD-Atmos 7.1", "DTS-HD-MA 6.0", "DTS-HD-HRA", "DDP 5.1", "DD", "LPCM", "Opus-2 2.0"]


def test_languages(spark):
    said = [("EN", "eng"), ("pt-br", "por"), ("GER", "deu"), ("kor", "kor"), ("english", ""), ("", ""), (None, "")]
    assert all(a == b for a, b in column(spark, said, "a string, b string", tracks.language_code(F.col("a")), "b"))
    named = [("  English SDH", "eng"), ("Français (VFF)", "fre"), ("Brazilian", "por"), ("The English", ""), (None, "")]
    assert all(a == b for a, b in column(spark, named, "a string, b string", tracks.language_of_name(F.col("a")), "b"))
    looked = [("fra", "eng", "fra"), ("", "eng", "eng"), (None, "en", ""), (None, None, "")]
    assert all(a == b for a, b in column(spark, looked, "a string, k string, b string", tracks.described(F.col("a"), F.col("k")), "b"))


def test_rates_and_channels(spark):
    rates = [(96000, 4004, 24000, 1001), (50, 2, 25, 1), (2997, 100, 30000, 1001), (17, 1, 17, 1), (0, 5, 0, 0), (30, -1, 0, 0), (2147483629, 2147483587, 2147483629, 2147483587)]
    got = column(spark, rates, "n int, d int, a long, b long", tracks.normal_rate(F.col("n"), F.col("d")), "a", "b")
    assert all((r.num, r.den) == (a, b) for r, a, b in got)
    got = column(spark, [(8, True, c) for c in range(8)] + [(8, False, 4), (6, True, 4)], "n int, l boolean, c int", tracks.disc_channel(F.col("n"), F.col("l"), F.col("c")))
    assert [c for (c,) in got] == [0, 1, 2, 3, 6, 7, 4, 5, 4, 4]


def test_spelling_of_read_captions(spark):
    lines = ["lt's l, l'm HELLO AlL", "lf... ln the hall", "l", "-l!", "ill will", "hall'l", "l’ll go", "", "LlE l'l'", None]
    want = ["It's I, I'm HELLO AIL", "If... In the hall", "I", "-I!", "ill will", "hall'l", "I’ll go", "", "LIE I'I'", None]
    assert [t for (t,) in column(spark, [(x,) for x in lines], "t string", tracks.respelled(F.col("t")))] == want


def test_selections_and_defaults(spark):
    rows = [("a", 1, "audio", "A_X", "", False), ("a", 2, "base", "V_MPEGH/ISO/HEVC", "", False), ("a", 3, "base", "V_MPEG2", "", False), ("a", 4, "enhancement", "V_EL", "", False),
            ("b", 1, "enhancement", "V_EL", "", False), ("b", 2, "base", "V_MPEG2", None, False), ("c", 1, "subtitles", "S", "SDH", False), ("c", 2, "subtitles", "S", "Forced", False),
            ("c", 3, "subtitles", "S", None, True), ("c", 4, "subtitles", "S", "foreign parts", False), ("d", 1, "subtitles", "S", "eng sdh", False), ("d", 2, "subtitles", "S", "full", None)]
    df = spark.createDataFrame(rows, "src string, i int, kind string, stream string, name string, forced boolean")
    got = {r.src: (r.base, r.enhancement, r.audio, r.subtitles) for r in routing.flat_selection(df, ["src"], "kind", "stream", "i", "i").collect()}
    assert got == {"a": (2, 4, 1, 0), "b": (2, None, 0, 0), "c": (None, None, 0, 4), "d": (None, None, 0, 2)}
    got = {r.src: (r.audio, r.subtitles) for r in routing.default_tracks(df, ["src"], "kind", F.lit(True), "name", "forced", "i", "i").collect()}
    assert got == {"a": (1, None), "b": (None, None), "c": (None, 1), "d": (None, 2)}


def test_packets_of_a_window(spark):
    rows = [(1, 0, "base", 5, 5, True), (1, 1, "clock", 0, 0, False), (1, 2, "base", 12, 10, False), (1, 3, "base", 14, 11, True), (1, 4, "clock", 0, 0, False), (1, 5, "dependent", 14, 11, False), (1, 6, "kept", 9, 9, False),
            (1, 7, "kept", 10, 10, False), (1, 8, "base", 30, 20, False), (1, 9, "clock", 0, 0, False), (1, 10, "dependent", 15, 12, False), (1, 11, "kept", 20, 20, False), (1, 12, "other", 12, 12, True),
            (2, 0, "clock", 0, 0, False), (2, 1, "kept", 15, 15, False), (2, 2, "base", 11, 11, False), (None, 3, "base", 11, 11, True)]
    df = spark.createDataFrame([(*r, 10, 20) for r in rows], "k int, s int, role string, pts long, dts long, key boolean, a long, b long")
    got = sorted((r.k or 0, r.s) for r in routing.kept_packets(df, ["k"], "s", "role", "pts", "dts", "key", "a", "b").collect())
    assert got == [(0, 3), (1, 3), (1, 4), (1, 5), (1, 7), (1, 10), (2, 1)]


def test_frames_at_an_edge(spark):
    rows = [("near", 8, 1), ("near", 9, 2), ("near", 12, 4), ("near", 30, 8), ("far", 1, 1), ("far", 10, 2), ("tie", 8, 1), ("tie", 12, 2), ("none", 2, 5), ("after", 20, 3)]
    df = spark.createDataFrame(rows, "k string, t long, size long")
    got = {r.k: (r.kept, r.dropped, r.early) for r in routing.edge_frames(df, ["k"], "t", "size", F.lit(10), F.lit(20)).collect()}
    assert got == {"near": (2, 9, True), "far": (1, 1, False), "tie": (1, 1, False), "none": (0, 5, False), "after": (0, 3, False)}
    got = routing.from_first_picture(df, ["k"], "t", F.col("size") == 2).select("k", "t").collect()
    assert sorted(map(tuple, got)) == [("far", 10), ("near", 9), ("near", 12), ("near", 30), ("tie", 12)]


def test_a_clock_of_samples(spark):
    """A late begin, a gap beyond the threshold, one below it, a sync point behind."""
    second = 1_000_000_000
    rows = [(1, 0, None, 5 * second), (1, 0, 48000, None), (1, 9, 48000, None), (1, 20, None, 8 * second), (1, 20, 48000, None), (1, 30, None, 9 * second + 10), (1, 30, 480, None), (1, 40, None, 2), (1, 41, None, 3), (1, 41, 48, None), (2, 5, 10, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k int, at long, n long, s long, i int")
    got = [(r.i, r.at, r.gap) for r in routing.audio_clock(df.withColumnRenamed("at", "place"), ["k"], "place", ["i"], "n", "s", ["i"], 48000, 1000).orderBy("i").collect()]
    assert got == [(1, 5 * second, 0), (2, 6 * second, 0), (4, 8 * second, second), (6, 9 * second, 0), (9, 9 * second + 10_000_000, 0), (10, 0, 0)]


def test_groups_and_entries(spark):
    df = spark.createDataFrame([("a", i, i in (3, 4, 8)) for i in range(10)] + [("b", 0, True)], "k string, i int, key boolean")
    b = F.expr("i div 4")
    assert sorted(map(tuple, routing.group_lengths(df, ["k"], ["i"], b, F.col("key")).collect())) == [("a", 0, 3), ("a", 1, 1), ("a", 2, 4), ("a", 3, 2), ("b", 1, 1)]
    assert sorted(map(tuple, routing.entry_points(df, ["k"], ["i"], b, F.col("key"), ["i"]).collect())) == [("a", 3, 3), ("a", 4, 4), ("a", 8, 8), ("b", 0, 0)]


def test_best_by_language_against_a_loop(spark):
    """Requests whose spellings overlap, repeat or fit nothing; ties; a null language; each track once."""
    import random

    from reeltide.operators import selection

    rng = random.Random(12)
    data = [(s, i, rng.choice(["spa", "esp", "ESP ", "por", "pob", "eng", None, "und"]), rng.randrange(3)) for i in range(120) for s in [rng.choice("abcde")]]
    df = spark.createDataFrame(data, "src string, i int, lang string, q int")
    asked = ["es", "spa", "pt", "por", "xx", "und", "es"]
    got = sorted((r.src, r.place, r.i) for r in selection.best_by_language(df, ["src"], "lang", "i", [F.col("q")], asked, ["i"]).collect())
    want = []
    for s in "abcde":
        taken = set()
        for place, one in enumerate(asked):
            pool = [(-q, i) for src, i, lang, q in data if src == s and i not in taken and ((lang or "und").strip().lower()) in selection.spelled([one])]
            if pool:
                taken.add(min(pool)[1])
                want.append((s, place, min(pool)[1]))
    assert got == sorted(want)


def test_offsets_of_a_group_run_out(spark):
    from reeltide.operators import asof

    groups = spark.createDataFrame([(1, 10, [5, 6, 7]), (1, 50, [9]), (1, 70, []), (1, 90, None)], "k int, t long, offsets array<int>")
    points = spark.createDataFrame([(1, t) for t in (0, 9, 10, 14, 15, 19, 20, 49, 50, 69, 71, 95)] + [(2, 10)], "k int, t long")
    got = {(r.k, r.t): r.o for r in asof.offset_at(points, groups, ["k"], "t", "offsets", 5, 16, "o").collect()}
    assert got == {(1, 0): None, (1, 9): None, (1, 10): 5, (1, 14): 5, (1, 15): 6, (1, 19): 6, (1, 20): 7, (1, 49): 7, (1, 50): 9, (1, 69): 9, (1, 71): None, (1, 95): None, (2, 10): None}


def test_layers_that_do_not_agree_are_told(spark):
    import pytest

    from reeltide.operators import pairing

    a = spark.createDataFrame([(1, 0, 4), (1, 1, 5)], "k int, i int, shown int")
    b = spark.createDataFrame([(1, 0, 4), (1, 1, 6)], "k int, j int, meant int")
    assert pairing.zipped_checked(a.where("i = 0"), b, ["k"], ["i"], ["j"], "shown", "meant").count() == 1
    with pytest.raises(Exception, match="place 1: indexes 5 and 6"):
        pairing.zipped_checked(a, b, ["k"], ["i"], ["j"], "shown", "meant").collect()
