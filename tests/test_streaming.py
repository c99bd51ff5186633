"""Streams against the batch rules, and caption texts."""

from pyspark.sql import functions as F

from reeltide.operators import pairing, sequence
from reeltide.sources import captions
from reeltide.streaming import streams


def drained(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    return spark.table(name)


def feed(spark, path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_stream_pairing_gives_unmatched_rows(spark, tmp_path):
    s = 1_000_000
    base = [[(1, i * s, i) for i in range(5)], [(1, 100 * s, 100)], [(1, 200 * s, 200)]]
    dep = [[(1, i * s, 10 + i) for i in (0, 2, 4)], [(1, 100 * s, 110)], [(1, 200 * s, 210)]]
    schema = "k int, t long, id int"
    b, d = feed(spark, f"{tmp_path}/b", base, schema), feed(spark, f"{tmp_path}/d", dep, schema)
    got = {(r.id, r.dep_id) for r in drained(streams.paired(b, d, ["k"], "t", "10 seconds"), "pairs", spark).collect()}
    flat = lambda x: spark.createDataFrame([r for p in x for r in p], schema)
    want = {(r.id, r.d) for r in pairing.paired(flat(base), flat(dep), ["k", "t"], ["id"], {"id": "d"}).collect()}
    assert got == want


def test_stream_reordering_matches_batch(spark, tmp_path):
    pocs = [0, 4, 2, 1, 3, 8, 6, 5, 7, 0, 2, 1]
    rows = [(1, i, p == 0, p) for i, p in enumerate(pocs)]
    schema = "k int, seq long, reset boolean, poc long"
    s = feed(spark, f"{tmp_path}/f", [rows[:5], rows[5:]], schema)
    got = {r.seq: r.display for r in drained(streams.reordered(s, "k", held=4), "shown", spark, "append").collect()}
    batch = sequence.display_order(spark.createDataFrame(rows, schema), ["k"], ["seq"], F.col("reset"), "poc", "d")
    want = {r.seq: r.d for r in batch.collect()}
    assert len(got) >= len(rows) - 4 and all(want[k] == v for k, v in got.items())


def test_captions(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("﻿1\r\n00:00:01,500 --> 00:00:02,000\r\nHi <i>you</i>\r\nall\r\n\r\n2\r\n01:00:00,0 --> 01:00:01,25\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nBye\r\n".encode())
    (tmp_path / "b.vtt").write_text("WEBVTT\n\nNOTE 00:01.000 --> 00:02.000\nno\n\nid\n00:03.000 --> 00:04.500 align:start\nYes\n")
    (tmp_path / "c.ass").write_text("[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Style, Text\nComment: 0,0:00:00.00,0:00:01.00,D,no\nDialogue: 0,0:00:01.50,0:00:02.00,D,Hello, {\\b1}you\n")
    got = [(r.begin, r.finish, r.cue) for r in captions.arrow_cues(captions.texts(spark, f"{tmp_path}/a.srt")).orderBy("begin").collect()]
    assert got == [(1500, 2000, "Hi <i>you</i>\nall"), (5000, 6000, "Bye")]
    assert [(r.begin, r.finish, r.cue) for r in captions.arrow_cues(captions.texts(spark, f"{tmp_path}/b.vtt")).collect()] == [(3000, 4500, "Yes")]
    assert [(r.begin, r.finish, r.style, r.cue) for r in captions.ass_cues(captions.texts(spark, f"{tmp_path}/c.ass")).collect()] == [(1500, 2000, "D", "Hello, {\\b1}you")]
    (tmp_path / "d.txt").write_text("10 20 depth=0.5\n# note\n1:00 screen=1 flat=yes\n90\n")
    got = [(r.start, r.end, r.settings) for r in captions.shots(captions.texts(spark, f"{tmp_path}/d.txt")).orderBy("line").collect()]
    assert got == [(10000, 20000, {"depth": "0.5"}), (60000, 90000, {"screen": "1", "flat": "yes"}), (90000, 0, {})]
