"""Streams with state against batch, for any cut into micro-batches; runs that are broken off."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from reeltide.operators import pairing, tracking
from reeltide.streaming import resume, stateful
from test_streaming import drained, feed

ROWS = "k int, seq long, kind int, t long, id long"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def cut(rows, seed, n):
    """The rows in n micro-batches cut anywhere."""
    places = sorted(random.Random(seed).sample(range(1, len(rows)), n - 1))
    return [rows[a:b] for a, b in zip([0, *places], [*places, len(rows)], strict=True)]


def arrivals(seed, n=120):
    rng = random.Random(seed)
    out = []
    for k in (1, 2):
        order = sorted([(i + rng.random() * 6, 0, i) for i in range(n)] + [(i + rng.random() * 14, 1, i) for i in range(n) if rng.random() < 0.8])
        out += [(k, s, kind, t, 1000 * kind + t) for s, (_, kind, t) in enumerate(order)]
    return sorted(out, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("bound", [1, 3, 2048])
def test_bounded_pairs_of_a_stream_are_those_of_batch(spark, tmp_path, bound):
    rows = arrivals(bound)
    df = spark.createDataFrame(rows, ROWS)
    b, d = df.where("kind = 0"), df.where("kind = 1")
    want = sorted(map(str, (tuple(r) for r in pairing.paired_bounded(b, d, ["k"], "t", "seq", "id", bound, 16).collect())))
    step, states, direct = stateful.pair_step(bound), {}, []
    for k, _, kind, t, i in rows:
        direct += [(k, *r) for r in step(states.setdefault(k, {}), (kind, t, i))]
        assert len(states[k]["bases"]) <= bound + 1 and len(states[k]["deps"]) <= bound
    for k in states:
        direct += [(k, *r) for r in step(states[k], (None, None, None))]
    assert sorted(map(str, direct)) == want
    if bound < 2048:
        assert 0 < sum("None" in x for x in want) < len(want)
    s = feed(spark, f"{tmp_path}/f", [*cut(rows, 4, 3), [(k, 10**6, None, None, None) for k in (1, 2)]], ROWS)
    got = drained(stateful.paired_bounded(s, "k", bound), f"bounded{bound}", spark).collect()
    assert sorted(map(str, map(tuple, got))) == want


def test_merged_stream_has_the_places_of_batch(spark, tmp_path):
    rng = random.Random(9)
    queues = {(k, s): [(t, 100 * s + i) for i, t in enumerate(sorted(rng.randrange(40) for _ in range(30)))] for k in (1, 2) for s in (0, 1)}
    rows, flat = [], {s: [(k, t, i) for (k, q), v in queues.items() if q == s for t, i in v] for s in (0, 1)}
    for seq in range(200):
        for k in (1, 2):
            if left := [s for s in (0, 1) if queues[k, s]]:
                s = rng.choice(left)
                rows.append((k, seq, s, *queues[k, s].pop(0)))
    want = sorted(tuple(r) for r in pairing.merged([spark.createDataFrame(flat[s], "k int, t long, id long") for s in (0, 1)], ["k"], "t", ["id"], "place").select("k", "id", "source", "place").collect())
    s = feed(spark, f"{tmp_path}/f", [*cut(rows, 2, 4), [(k, 999, None, None, None) for k in (1, 2)]], ROWS)
    assert sorted(map(tuple, drained(stateful.merged(s, "k"), "heads", spark).collect())) == want
    step, state = stateful.merge_step(2), {}
    assert step(state, (0, 5, 1)) == [] and step(state, (1, 7, 2)) == [(1, 0, 1)] and step(state, (0, None, None)) == [(2, 1, 2)]


def test_tracked_stream_is_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in (1, 2):
        for i in range(150):
            x = rng.randrange(3) * 10.0
            box = (x, 0.0, x + 12, 12.0) if rng.random() < 0.9 else (None,) * 4
            rows.append((k, i, i // 2, *box, rng.random()))
    form = "k int, seq long, picture long, x0 double, y0 double, x1 double, y1 double, p double"
    df = spark.createDataFrame(rows, form)
    want = sorted(map(str, map(tuple, tracking.tracked(df, ["k"], "picture", ["seq"], ("x0", "y0", "x1", "y1"), "p", tracking.Rules()).collect())))
    rows.sort(key=lambda r: r[1])
    s = feed(spark, f"{tmp_path}/f", [*cut(rows, 5, 4), [(k, 999, *[None] * 6) for k in (1, 2)]], form)
    assert sorted(map(str, map(tuple, drained(stateful.tracked(s, "k", tracking.Rules()), "titles", spark).collect()))) == want


# --- runs that are broken off


def test_content_keys(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 5), ("b", 2, 5)], "path string, length long, changed long")
    key = resume.content_key(df, {"crf": 20, "size": None})
    assert key == resume.content_key(df.repartition(3).select("changed", "path", "length"), {"size": None, "crf": 20})
    others = [resume.content_key(d, s) for d, s in ((df.distinct(), {"crf": 20, "size": None}), (df, {"crf": 21, "size": None}), (df.limit(0), {}), (df.withColumn("length", F.col("length") + 1), {"crf": 20, "size": None}))]
    assert len({key, *others}) == 5


def test_a_killed_run_goes_on(spark, tmp_path):
    """A stream that dies in the middle of a batch and is started again gives the rows of one run."""
    rows = [(i // 10, i, i * i) for i in range(100)]
    source = feed(spark, f"{tmp_path}/in", [rows[i : i + 20] for i in range(0, 100, 20)], "segment long, i long, v long")
    segments = resume.Segments(spark, f"{tmp_path}/out", "key1")
    seen = []

    def dies(df, batch):
        seen.append(batch)
        if batch == 2 and len(seen) < 4:
            df.write.parquet(f"{tmp_path}/out/parts/key1/{batch:012d}")  # written, but not committed
            raise RuntimeError("killed")
        segments.write(df, batch)

    def run():
        q = source.writeStream.foreachBatch(dies).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(60)

    with pytest.raises(Exception, match="killed"):
        run()
    assert segments.rows().count() == 40
    run()
    assert sorted(map(tuple, segments.rows().select("segment", "i", "v").collect())) == rows
    segments.write(spark.createDataFrame(rows, "segment long, i long, v long"), 77)  # all finished: nothing is added
    segments.write(spark.createDataFrame([(50, 1, 1)], "segment long, i long, v long"), 0)  # a batch that is committed
    assert segments.rows().count() == 100
    other = resume.Segments(spark, f"{tmp_path}/out", "key2")
    assert other.rows() is None and other.missing(source).isStreaming
    other.write(spark.createDataFrame([(1, 1, 1)], "segment long, i long, v long"), 0)
    assert other.drop_stale() == ["key1"] and segments.rows() is None and other.rows().count() == 1


def test_parts_are_joined_with_one_header(spark):
    rows = [(f, s, i, i < 2) for f in "ab" for s in (3, 1, 2) for i in range(4 if f == "a" else 2)]
    df = spark.createDataFrame(rows, "film string, segment int, i int, head boolean")
    got = sorted((r.film, r.place, r.segment, r.i) for r in resume.joined(df, ["film"], "segment", ["i"], F.col("head")).collect())
    want = [("a", n, s, i) for n, (s, i) in enumerate([(1, 0), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)])]
    assert got == want + [("b", 0, 1, 0), ("b", 1, 1, 1)]


def test_rounds_over_sources(spark, tmp_path):
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    done = os.path.join(tmp_path, "done")
    work = lambda broken: lambda df: df.where("source <> 'c'").withColumn("error", F.when(F.col("source") == broken, F.lit("broken")))
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(resume.round_of(sources, done, work("b"))) == [("a", "ok"), ("b", "failed: broken")]
    assert told(resume.round_of(sources, done, work("b"))) == []
    assert told(resume.round_of(sources, done, work("x"), retry=True)) == [("b", "ok")]
    assert told(resume.round_of(sources, done, lambda df: df.withColumn("error", F.lit(None).cast("string")))) == [("c", "ok")]
