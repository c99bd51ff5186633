"""Parsers against byte strings that are built here, whole, damaged and cut short."""

import struct

import pytest
from pyspark.sql import functions as F

from reeltide.sources import elementary, files, matroska, mp4, playlists, transport


def u(n, size):
    return n.to_bytes(size, "big")


def stream_entry(pid, attributes):
    entry = bytes([1]) + u(pid, 2) + b"\0" * 6
    return bytes([len(entry)]) + entry + bytes([len(attributes)]) + attributes


def playlist_bytes(marks=((1, 0, 5000), (2, 0, 6000), (1, 1, 9000))):
    stn = b"\0\0" + bytes([1, 1, 1, 0, 0, 0, 0]) + b"\0" * 5
    stn += stream_entry(0x1011, bytes([0x1B, 0x61])) + stream_entry(0x1100, bytes([0x83, 0x61]) + b"eng") + stream_entry(0x1200, bytes([0x90]) + b"fra")

    def item(clip, begin, end):
        body = clip + b"M2TS" + u(1, 2) + b"\0" + u(begin, 4) + u(end, 4) + b"\0" * 12 + u(len(stn), 2) + stn
        return u(len(body), 2) + body

    def sub(kind, clips):
        entries = b""
        for clip, sync in clips:
            e = clip + b"M2TS" + b"\0\0\0" + b"\0" + u(0, 4) + u(1, 4) + u(sync, 2) + u(0, 4)
            entries += u(len(e), 2) + e
        body = b"\0" + bytes([kind]) + b"\0\0\0" + bytes([len(clips)]) + entries
        return u(len(body), 4) + body

    lists = b"\0" * 2 + u(2, 2) + u(1, 2) + item(b"00001", 4500, 9000) + item(b"00002", 0, 45000) + sub(8, [(b"00003", 0), (b"00004", 9)])
    lists = u(len(lists), 4) + lists
    info = u(14, 4) + b"\0" * 12 + u(0x1000, 2)
    at = 40 + len(info)
    m = u(len(marks), 2) + b"".join(b"\0" + bytes([k]) + u(i, 2) + u(t, 4) + b"\0" * 6 for k, i, t in marks)
    return b"MPLS0200" + u(at, 4) + u(at + len(lists), 4) + u(0, 4) + b"\0" * 20 + info + lists + u(len(m), 4) + m


def test_playlist():
    [(version, right, items, marks)] = playlists.parse_playlist(playlist_bytes())
    assert (version, right) == ("0200", True)
    assert [i[:6] for i in items] == [(0, "00001", 4500, 9000, 1, "00003"), (1, "00002", 0, 45000, 1, "00004")]
    assert items[0][6] == [(0, 0x1011, 0x1B, 6, 1, None), (1, 0x1100, 0x83, 6, 1, "eng"), (2, 0x1200, 0x90, None, None, "fra")]
    assert marks == [(0, 1, 0, 5000), (1, 2, 0, 6000), (2, 1, 1, 9000)]


def test_every_prefix_of_a_playlist_fails_with_a_reason():
    data = playlist_bytes()
    for n in range(len(data) - 1):
        with pytest.raises(Exception) as e:
            list(playlists.parse_playlist(data[:n]))
        assert str(e.value)


def test_clip():
    program = u(0, 4) + b"\0" + bytes([1]) + b"\0" * 6 + bytes([2, 0])
    for pid, a in ((0x1011, bytes([0x24, 0x81])), (0x1100, bytes([0x86, 0xC1]) + b"deu")):
        program += u(pid, 2) + bytes([len(a)]) + a
    data = b"HDMV0200" + u(0, 4) + u(40, 4) + b"\0" * 24 + program
    assert list(playlists.parse_clip(data)) == [(0x1011, 0x24, 8, 1, None), (0x1100, 0x86, 12, 1, "deu")]


# --- transport stream


def stamp(mark, t):
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1]) + u((t >> 15 & 0x7FFF) << 1 | 1, 2) + u((t & 0x7FFF) << 1 | 1, 2)


def pes(stream, pts, dts, body):
    head = stamp(3, pts) + stamp(1, dts) if dts is not None else stamp(2, pts) if pts is not None else b""
    flags = 0xC0 if dts is not None else 0x80 if pts is not None else 0
    rest = b"\x80" + bytes([flags, len(head)]) + head + body
    return b"\0\0\1" + bytes([stream]) + u(len(rest), 2) + rest


def section(table, body):
    n = len(body) + 4
    s = bytes([table, 0xB0 | n >> 8, n & 255]) + body
    crc = transport.crc_mpeg(s)
    return s + u(crc, 4)


class Muxer:
    def __init__(self, wide):
        self.out, self.counts, self.wide = bytearray(), {}, wide

    def put(self, pid, data, psi=False):
        data, start = (b"\0" + data if psi else data), True
        while data:
            n = self.counts[pid] = (self.counts.get(pid, -1) + 1) % 16
            part, data = data[:184], data[184:]
            head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255])
            if len(part) == 184:
                p = head + bytes([0x10 | n]) + part
            elif psi:
                p = head + bytes([0x10 | n]) + part.ljust(184, b"\xff")
            else:
                pad = 183 - len(part)
                p = head + bytes([0x30 | n, pad]) + (b"\0" + b"\xff" * (pad - 1) if pad else b"") + part
            self.out += (b"\0\0\0\0" if self.wide else b"") + p
            start = False


def transport_bytes(wide):
    m = Muxer(wide)
    m.put(0, section(0, u(1, 2) + b"\xc1\0\0" + u(1, 2) + u(0xE100, 2)), psi=True)
    streams = bytes([0x1B]) + u(0xF011, 2) + u(0xF000, 2) + bytes([0x81]) + u(0xF100, 2) + u(0xF006, 2) + b"\x0a\x04eng\0"
    m.put(0x100, section(2, u(1, 2) + b"\xc1\0\0" + u(0xF001, 2) + u(0xF000, 2) + streams), psi=True)
    bodies = [bytes([i]) * (300 + i) for i in range(4)]
    m.put(0x1011, pes(0xE0, (1 << 33) - 1, 900, bodies[0]))
    m.put(0x1100, pes(0xBD, 1000, None, bodies[1]))
    m.put(0x1011, pes(0xE0, 2000, 1900, bodies[2]))
    m.put(0x1100, pes(0xBD, None, None, bodies[3]))
    return bytes(m.out), bodies


@pytest.mark.parametrize("wide", [False, True])
def test_transport_stream(wide):
    data, bodies = transport_bytes(wide)
    rows = list(transport.read_pes(data))
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [(0x1011, 0xE0, (1 << 33) - 1, 900), (0x1100, 0xBD, 1000, 1000), (0x1011, 0xE0, 2000, 1900), (0x1100, 0xBD, None, None)]
    assert [r[5] for r in rows] == bodies
    assert list(transport.read_program(data)) == [(1, 0x1001, 0x1011, 0x1B, None), (1, 0x1001, 0x1100, 0x81, "eng")]
    assert [r[0] for r in transport.read_pes(data, {0x1100})] == [0x1100, 0x1100]


def test_transport_stream_after_damage():
    data, bodies = transport_bytes(False)
    rows = list(transport.read_pes(data[: 188 * 2] + b"junk" * 9 + data[188 * 2 :]))
    assert [r[5] for r in rows] == bodies


# --- Matroska


def el(ident, body):
    n = (ident.bit_length() + 7) // 8
    return u(ident, n) + u(1 << 28 | len(body), 4) + body


def matroska_bytes():
    M = matroska
    track = el(M.TRACK, el(0xD7, b"\1") + el(0x83, b"\1") + el(0x86, b"V_MPEG4/ISO/AVC") + el(0x23E383, u(40_000_000, 4)) + el(0xE0, el(0xB0, u(1920, 2)) + el(0xBA, u(1080, 2))))
    track += el(M.TRACK, el(0xD7, b"\2") + el(0x83, b"\2") + el(0x86, b"A_AC3") + el(0x22B59C, b"fra") + el(0x23E383, u(32_000_000, 4)) + el(0xE1, el(0x9F, b"\6") + el(0xB5, struct.pack(">d", 48000))))
    xiph = b"\x82" + u(5, 2) + b"\x02" + b"\x02" + b"\x01" + b"\x02" + b"a" + b"bb" + b"ccc"
    ebml = b"\x82" + u(70, 2) + b"\x06" + b"\x02" + b"\x81" + b"\xc0" + b"a" + b"bb" + b"ccc"
    fixed = b"\x82" + u(0xFFFF, 2) + b"\x04" + b"\x01" + b"aabb"
    cluster = el(M.CLUSTER, el(M.CLUSTER_TIME, u(1000, 2)) + el(M.SIMPLE, b"\x81\0\0\x80key") + el(M.GROUP, el(M.BLOCK, b"\x81\0\x28\0dep") + el(M.BLOCK_DURATION, b"\x28") + el(M.REFERENCE, b"\1")) + el(M.SIMPLE, xiph) + el(M.SIMPLE, ebml) + el(M.SIMPLE, fixed))
    atom = lambda t, hidden=0: el(M.ATOM, el(M.ATOM_START, u(t, 4)) + el(M.ATOM_HIDDEN, bytes([hidden])))
    chapters = el(M.CHAPTER_LIST, el(M.EDITION, atom(1)) + el(M.EDITION, el(M.EDITION_DEFAULT, b"\1") + atom(0) + atom(5, 1) + atom(9)))
    return el(0x1A45DFA3, b"") + el(M.SEGMENT, el(M.INFO, el(M.SCALE, u(1_000_000, 4))) + el(M.TRACK_LIST, track) + chapters + cluster)


def test_matroska():
    data = matroska_bytes()
    tracks = list(matroska.read_tracks(data))
    assert [t[:4] for t in tracks] == [(1, "video", "V_MPEG4/ISO/AVC", "eng"), (2, "audio", "A_AC3", "fra")]
    assert tracks[0][7:9] == (1920, 1080) and tracks[1][9:11] == (6, 48000.0)
    frames = list(matroska.read_frames(data))
    assert [(f[0], f[2] // 1_000_000, f[3], f[4], f[5]) for f in frames] == [
        (1, 1000, None, True, b"key"), (1, 1040, 40_000_000, False, b"dep"),
        (2, 1005, None, False, b"a"), (2, 1037, None, False, b"bb"), (2, 1069, None, False, b"ccc"),
        (2, 1070, None, False, b"a"), (2, 1102, None, False, b"bb"), (2, 1134, None, False, b"ccc"),
        (2, 999, None, False, b"aa"), (2, 1031, None, False, b"bb"),
    ]
    assert list(matroska.read_chapters(data)) == [(0, 0), (1, 9)]


def test_every_prefix_of_matroska_says_what_is_missing():
    from reeltide.sources.bits import Missing

    data = matroska_bytes()
    whole = list(matroska.read_frames(data))
    for n in range(5, len(data)):
        with pytest.raises(Missing) as e:
            list(matroska.read_frames(data[:n]))
        assert e.value.offset + e.value.length <= len(data) or e.value.offset == n
    assert list(matroska.read_frames(data + b"\0" * 9)) == whole


# --- MP4


def box(kind, body):
    return u(8 + len(body), 4) + kind + body


def table(kind, rows):
    return box(kind, u(0, 4) + u(len(rows), 4) + b"".join(u(v & 0xFFFFFFFF, 4) for r in rows for v in r))


def mp4_bytes():
    stsd = box(b"stsd", u(0, 4) + u(1, 4) + box(b"avc1", b"\0" * 24 + u(640, 2) + u(480, 2) + b"\0" * 10))
    stbl = stsd + table(b"stts", [(3, 100), (1, 50)]) + table(b"ctts", [(1, 0), (2, -100), (1, 7)]) + table(b"stsc", [(1, 2, 1), (2, 1, 1)]) + table(b"stco", [(1000,), (5000,), (9000,)]) + table(b"stss", [(1,), (4,)])
    stbl += box(b"stsz", u(0, 4) + u(0, 4) + u(4, 4) + b"".join(u(s, 4) for s in (10, 20, 30, 40)))
    lang = (ord("e") - 96) << 10 | (ord("n") - 96) << 5 | (ord("g") - 96)
    mdia = box(b"mdhd", u(0, 4) + u(0, 8) + u(600, 4) + u(350, 4) + u(lang, 2) + u(0, 2)) + box(b"hdlr", u(0, 8) + b"vide" + b"\0" * 13) + box(b"minf", box(b"stbl", stbl))
    trak = box(b"trak", box(b"tkhd", u(0, 4) + u(0, 8) + u(7, 4) + b"\0" * 60) + box(b"mdia", mdia))
    return box(b"ftyp", b"isom") + box(b"moov", trak) + box(b"mdat", b"x" * 50)


def test_mp4():
    data = mp4_bytes()
    assert list(mp4.read_tracks(data)) == [(7, "video", "avc1", "eng", 600, 350, 640, 480, 4)]
    assert list(mp4.read_samples(data)) == [(7, 0, 1000, 10, 0, 0, 100, True), (7, 1, 1010, 20, 100, 0, 100, False), (7, 2, 5000, 30, 200, 100, 100, False), (7, 3, 9000, 40, 300, 307, 50, True)]
    for n in range(12, data.index(b"mdat") - 5):
        with pytest.raises(Exception):
            list(mp4.read_samples(data[:n]))


def test_edit_lists_shift_times():
    def with_edits(rows, version=0):
        w = 8 if version else 4
        elst = box(b"elst", bytes([version, 0, 0, 0]) + u(len(rows), 4) + b"".join(u(d, w) + u(m % (1 << 8 * w), w) + u(1 << 16, 4) for d, m in rows))
        data = mp4_bytes()
        trak = data[data.index(b"trak") + 4 : data.index(b"mdat") - 4]
        mvhd = box(b"mvhd", u(0, 4) + u(0, 8) + u(1000, 4) + b"\0" * 80)
        return box(b"ftyp", b"isom") + box(b"moov", mvhd + box(b"trak", trak + box(b"edts", elst)))

    plain = [(r[4], r[5]) for r in mp4.read_samples(mp4_bytes())]
    for version in (0, 1):
        for rows, shift in (([(500, -1), (9, 0)], 300), ([(9, 100)], -100), ([(500, -1), (9, 40), (9, 7)], 260), ([], 0)):
            assert [(r[4], r[5]) for r in mp4.read_samples(with_edits(rows, version))] == [(d + shift, c + shift) for d, c in plain]


# --- elementary streams


def test_units_and_captions():
    units = [b"\x09\x10", b"\x67sps", b"\x68pps", b"\x65\x88idr", b"\x65\x08more", b"\x41\x9adep", b"\x09\x30", b"\x41\x9blast"]
    data = b"".join(b"\0\0\0\1" + x for x in units)
    assert elementary.split_units(data) == units
    assert [(r[0], r[1], r[3]) for r in elementary.read_units(data)] == [(0, True, 5), (1, False, 1), (2, False, 2)]
    assert elementary.split_units(elementary.start_codes(u(2, 4) + b"\x09\x10" + u(1, 4) + b"\x0c", 4)) == [b"\x09\x10", b"\x0c"]
    assert elementary.unescaped(b"\0\0\3\1\0\0\3\0\0\3") == b"\0\0\1\0\0\0\0"
    sup = b"".join(b"PG" + u(t, 4) + u(0, 4) + bytes([k]) + u(len(x), 2) + x for t, k, x in ((90, 0x16, b"abc"), (180, 0x80, b"")))
    assert list(elementary.read_sup(sup)) == [(0, 90, 0, 0x16, b"abc"), (1, 180, 0, 0x80, b"")]


def test_units_of_a_dependent_view():
    units = [b"\x6fsps", b"\x68pps"] + [b"\x74" + bytes([0x80 | (0x40 if i else 0)]) + b"\0\0" + x for i in range(5) for x in (b"\x88first", b"\x08more")]
    got = [(r[0], r[1], r[3]) for r in elementary.read_units(b"".join(b"\0\0\0\1" + x for x in units))]
    assert got == [(0, True, 4), *[(i, False, 2) for i in range(1, 5)]]


def test_cues_that_show_nothing_are_none(spark):
    from reeltide.sources import captions

    srt = "1\n00:00:01,000 --> 00:00:02,000\nA\n\n2\n00:00:03,000 --> 00:00:03,000\nB\n\nx\ny\nz\n00:00:05,000 --> 00:00:06,000\nC"
    ass = "[Events]\nFormat: Start, End, Style, Text\nDialogue: 0:00:01.00,0:00:02.00,S,one, two\nDialogue: 0:00:03.00,0:00:02.00,S,back"
    df = spark.createDataFrame([("s", srt), ("v", "WEBVTT\n\n" + srt.replace(",", "."))], "file string, text string")
    got = {(r.file, r.begin, r.cue) for r in captions.arrow_cues(df).collect()}
    assert got == {("s", 1000, "A"), ("s", 5000, "C"), ("v", 1000, "A")}
    assert [(r.begin, r.finish, r.cue) for r in captions.ass_cues(spark.createDataFrame([("a", ass)], "file string, text string")).collect()] == [(1000, 2000, "one, two")]


def test_headers_and_pictures():
    assert list(elementary.parse_ac3(b"\x0b\x77\0\0\x1e\x40\xe1\0")) == [("ac3", 6, 48000, 448)]
    assert list(elementary.parse_lpcm(b"\0\0\x91\x40")) == [("lpcm", 6, 48000, 4608)]
    assert list(elementary.parse_ac3(b"nothing")) == []
    y4m = b"YUV4MPEG2 W2 H2 F25:1 C420\n" + b"FRAME\nabcdUV" * 2
    assert list(elementary.read_y4m(y4m)) == [(0, 2, 2, b"abcd", b"U", b"V"), (1, 2, 2, b"abcd", b"U", b"V")]


# --- as tables


def test_files_as_tables(spark, tmp_path):
    (tmp_path / "a.mpls").write_bytes(playlist_bytes())
    (tmp_path / "b.mpls").write_bytes(playlist_bytes()[:90])
    df = files.read_media(spark, f"{tmp_path}/a.mpls", "mpls")
    items = df.select(F.explode("items").alias("i")).select("i.clip", (F.col("i.out_time") - F.col("i.in_time")).alias("ticks"))
    assert [tuple(r) for r in items.orderBy("clip").collect()] == [("00001", 4500), ("00002", 45000)]
    both = files.read_media(spark, f"{tmp_path}/*.mpls", "mpls", mode="PERMISSIVE").orderBy("file").collect()
    assert both[0].error is None and "missing" in both[1].error and both[1].items is None
    with pytest.raises(Exception):
        files.read_media(spark, f"{tmp_path}/*.mpls", "mpls").collect()


def test_data_source_takes_pids_down(spark, tmp_path):
    data, bodies = transport_bytes(True)
    (tmp_path / "x.m2ts").write_bytes(data)
    files.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("media").option("kind", "m2ts").load(f"{tmp_path}/*.m2ts")
    assert df.count() == 4
    only = df.where(F.col("pid") == 0x1100)
    assert [bytes(r.payload) for r in only.orderBy("seq").collect()] == [bodies[1], bodies[3]]
