"""Large files by ranges: n partitions give the rows of one, damage costs what it touches, parts of files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from reeltide.operators import ranges
from reeltide.sources import byteranges, matroska, transport
from test_sources import box, el, pes, table, u


def stream(seed, wide=False, n=400):
    """(bytes, bodies by pid in order) of a stream of two pids whose units go over many packets, with tables and padding between."""
    rng = random.Random(seed)
    out, counter, bodies = bytearray(), {}, {0x1011: [], 0x1100: []}

    def put(pid, data):
        start = True
        while data or start:
            part, data = data[:184], data[184:]
            c = counter[pid] = (counter.get(pid, -1) + 1) % 16
            head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255])
            pad = 183 - len(part)
            body = bytes([0x10 | c]) + part if len(part) == 184 else bytes([0x30 | c, pad]) + (b"\0" + b"\xff" * (pad - 1) if pad else b"") + part
            out.extend((bytes(4) if wide else b"") + head + body)
            start = False

    for i in range(n):
        if i % 9 == 0:
            put(0x1FFF, b"\xff" * 184)
        pid = rng.choice([0x1011, 0x1100])
        body = rng.randbytes(rng.randrange(1, 1500))
        bodies[pid].append(body)
        put(pid, pes(0xE0 if pid == 0x1011 else 0xBD, 90 * i, None, body))
    return bytes(out), bodies


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("wide", [False, True])
def test_packets_of_many_ranges_are_those_of_one(spark, tmp_path, wide):
    data, bodies = stream(1, wide)
    (tmp_path / "a.m2ts").write_bytes(data)
    one = byteranges.read_ranges(spark, str(tmp_path), "packets")
    many = byteranges.read_ranges(spark, str(tmp_path), "packets", range_bytes=7001)
    cols = ("at", "pid", "unit_start", "counter", "payload")
    assert many.rdd.getNumPartitions() > 20 and rows(one, *cols) == rows(many, *cols)
    units = byteranges.units(many, 5000).orderBy("at").collect()
    for pid, want in bodies.items():
        assert [r.payload for r in units if r.pid == pid] == want
    whole = sorted((r[0], r[1], r[2], r[3], r[5]) for r in transport.read_pes(data))
    assert sorted((r.pid, r.stream_id, r.pts, r.dts, bytes(r.payload)) for r in units) == whole
    assert {r.pid for r in many.where("pid = 4352").select("pid").distinct().collect()} == {0x1100}


def test_damage_costs_what_it_touches(spark, tmp_path):
    data, _ = stream(2)
    cut = 188 * 300
    hurt = data[:cut] + os.urandom(1000).replace(b"G", b"H") + data[cut + 188 * 3 :]  # three packets become junk of another length
    (tmp_path / "a.ts").write_bytes(data)
    (tmp_path / "b.ts").write_bytes(hurt)
    good = rows(byteranges.read_ranges(spark, str(tmp_path / "a.ts"), "packets"), "at", "payload")
    for size in (1 << 20, 30_000, 5_000):
        got = rows(byteranges.read_ranges(spark, str(tmp_path / "b.ts"), "packets", range_bytes=size), "at", "payload")
        moved = 1000 - 188 * 3
        assert got == [r for r in good if r[0] < cut] + [(at + moved, x) for at, x in good if at >= cut + 188 * 3]


def test_a_sparse_file_of_three_gigabytes(spark, tmp_path):
    data, _ = stream(3, n=60)
    path, size = tmp_path / "big.ts", 3 << 30
    places = [0, (1 << 30) + 188 * 7 + 5, size - len(data)]
    with open(path, "wb") as f:
        for p in places:
            f.seek(p)
            f.write(data)
    got = byteranges.read_ranges(spark, str(path), "packets", range_bytes=256 << 20)
    n = len(data) // 188
    assert got.rdd.getNumPartitions() == 12
    assert [r[0] for r in rows(got, "at")] == [p + 188 * i for p in places for i in range(n)]


def test_parts_of_files(spark, tmp_path):
    data, _ = stream(4)
    (tmp_path / "a.ts").write_bytes(data)
    every = rows(byteranges.read_ranges(spark, str(tmp_path), "packets"), "at")
    assert rows(byteranges.read_ranges(spark, str(tmp_path), "packets", first=50_001), "at") == [r for r in every if r[0] >= 50_001]
    some = byteranges.read_ranges(spark, str(tmp_path), "packets", places=4, place_bytes=2000)
    starts = [int((i + 0.5) / 4 * len(data)) for i in range(4)]
    assert rows(some, "at") == [r for r in every if any(s <= r[0] < s + 2000 for s in starts)]


def clusters(seed, n=40, unknown=False):
    rng = random.Random(seed)
    out, at = [el(0x1A45DFA3, b"") + u(matroska.SEGMENT, 4) + b"\x01" + b"\xff" * 7 + el(matroska.INFO, el(matroska.SCALE, u(1_000_000, 4)))], []
    for i in range(n):
        at.append(sum(map(len, out)))
        body = el(matroska.CLUSTER_TIME, u(i * 1000, 4))
        for k in range(rng.randrange(1, 5)):
            body += el(matroska.SIMPLE, b"\x81" + u(k * 40, 2) + bytes([0x80 if k == 0 else 0]) + rng.randbytes(rng.randrange(1, 3000)))
        body += el(matroska.GROUP, el(matroska.BLOCK, b"\x82\0\x05\x04\x01aabb") + el(matroska.BLOCK_DURATION, b"\x28"))
        out.append(u(matroska.CLUSTER, 4) + b"\x01" + b"\xff" * 7 + body if unknown else el(matroska.CLUSTER, body))
    return b"".join(out), at


@pytest.mark.parametrize("unknown", [False, True])
def test_clusters_of_many_ranges_are_those_of_one(spark, tmp_path, unknown):
    data, at = clusters(5, unknown=unknown)
    (tmp_path / "a.mkv").write_bytes(data)
    cols = ("at", "cluster_at", "track", "ticks", "duration", "keyframe", "lace", "data")
    one = byteranges.read_ranges(spark, str(tmp_path), "blocks")
    many = rows(byteranges.read_ranges(spark, str(tmp_path), "blocks", range_bytes=3000), *cols[:4], "lace", "data")
    assert rows(one, *cols[:4], "lace", "data") == many and {r[1] for r in many} == set(at)
    if not unknown:
        want = [(t, p // 1_000_000, k, d) for t, _, p, _, k, d in matroska.read_frames(data)]
        assert [(r.track, r.ticks, r.keyframe, bytes(r.data)) for r in one.orderBy("at", "lace").collect()] == want
    late = byteranges.read_ranges(spark, str(tmp_path), "blocks", first=at[7] + 1)  # goes on at the first cluster after a place
    assert {r[0] for r in rows(late, "cluster_at")} == set(at[8:])


def test_a_broken_cluster_costs_itself(spark, tmp_path):
    data, at = clusters(6)
    hurt = bytearray(data)
    hurt[at[3] + 16 : at[3] + 20] = b"\xff\xff\xff\xff"
    (tmp_path / "a.mkv").write_bytes(bytes(hurt) [: at[-1] + 20])
    got = byteranges.read_ranges(spark, str(tmp_path), "blocks", range_bytes=4000)
    assert {r[0] for r in rows(got, "cluster_at")} >= set(at[:3] + at[4:-1])


def test_samples_by_place(spark, tmp_path):
    sizes = [10, 20, 30, 40, 50]
    stbl = table(b"stts", [(5, 100)]) + table(b"stsc", [(1, 2, 1), (3, 1, 1)]) + box(b"stsz", u(0, 4) + u(0, 4) + u(5, 4) + b"".join(u(s, 4) for s in sizes))
    mdhd = box(b"mdhd", u(0, 4) + u(0, 8) + u(600, 4) + u(500, 4) + u(0, 2) + u(0, 2))
    trak = lambda chunks: box(b"trak", box(b"tkhd", u(0, 4) + u(0, 8) + u(7, 4) + b"\0" * 60) + box(b"mdia", mdhd + box(b"minf", box(b"stbl", stbl + table(b"stco", [(c,) for c in chunks])))))
    data = bytes(random.Random(1).randbytes(400))
    file = box(b"ftyp", b"isom") + box(b"mdat", data) + box(b"moov", trak([200, 20, 120]))
    (tmp_path / "a.mp4").write_bytes(file)
    want = sorted((at, file[at : at + n]) for at, n in zip([200, 210, 20, 50, 120], sizes, strict=True))
    assert rows(byteranges.read_ranges(spark, str(tmp_path), "samples"), "at", "data") == want
    assert rows(byteranges.read_ranges(spark, str(tmp_path), "samples", range_bytes=37), "at", "data") == want
    assert rows(byteranges.read_ranges(spark, str(tmp_path), "samples", first=51), "at", "data") == [w for w in want if w[0] > 50]


def test_listing(tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    for name in ("b.MKV", "x/a.m2ts", "x/y/c.mkv", "x/notes.txt"):
        (tmp_path / name).write_bytes(b"12345")
    found = byteranges.listed(str(tmp_path), byteranges.KINDS["blocks"][1])
    assert [(os.path.relpath(p, tmp_path), n) for p, n in found] == [("b.MKV", 5), ("x/y/c.mkv", 5)]
    assert [byteranges.kind_of(n) for n in ("a.MKV", "b.m2ts", "c.txt", "d.mp4")] == ["blocks", "packets", None, "samples"]
    with pytest.raises(FileNotFoundError):
        byteranges.listed(str(tmp_path / "none"), (".ts",))


def test_two_level_sums_and_neighbours(spark):
    rng = random.Random(8)
    data = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(300), i, rng.choice([0, 1, None])) for i in range(500)]
    df = spark.createDataFrame(data, "k int, t int, i int, v int")
    b = F.floor(F.col("t") / 10)
    summed = {r.i: r.s for r in ranges.running_sum(df, ["k"], ["t", "i"], b, F.col("v"), "s").collect()}
    place = {r.i: r.n for r in ranges.numbered(df, ["k"], ["t", "i"], b, "n").collect()}
    before = {r.i: (r.pi, r.pt) for r in ranges.lagged(df, ["k"], ["t", "i"], b, {"i": "pi", "t": "pt"}).collect()}
    for k in (1, 2, None):
        own = sorted((t, i, v) for kk, t, i, v in data if kk == k)
        total, last = 0, (None, None)
        for n, (t, i, v) in enumerate(own):
            total += v or 0
            assert (summed[i], place[i], before[i]) == (total, n, last)
            last = (i, t)
