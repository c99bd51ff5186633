"""MP4: tracks and samples from the movie box."""

from __future__ import annotations

from collections.abc import Iterator

from reeltide.sources.bits import Cursor, Missing

TRACKS = "track int, type string, codec string, lang string, timescale int, duration bigint, width int, height int, samples bigint"
SAMPLES = "track int, ord bigint, offset bigint, size bigint, dts bigint, cts bigint, dur bigint, key boolean"
HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts"}


def boxes(b: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes between two places; size 0 goes on to the end, size 1 has 64 bits."""
    while at + 8 <= end:
        size, head = int.from_bytes(b[at : at + 4], "big"), 8
        if size == 1:
            if at + 16 > end:
                raise Missing(at, 16)
            size, head = int.from_bytes(b[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head:
            raise ValueError("a box shorter than its header")
        yield b[at + 4 : at + 8], at + head, at + size
        at += size


def movie(b: bytes) -> tuple[int, int]:
    """Where the movie box's content is; says which bytes are missing if the input ends before it does."""
    for kind, i, j in boxes(b, 0, len(b)):
        if kind == b"moov":
            if j > len(b):
                raise Missing(len(b), j - len(b))
            return i, j
    raise Missing(len(b), 1)


def _tree(b: bytes, i: int, j: int) -> dict[bytes, list[tuple[int, int]]]:
    out: dict[bytes, list[tuple[int, int]]] = {}
    for kind, x, y in boxes(b, i, j):
        out.setdefault(kind, []).append((x, y))
        if kind in HOLDERS and kind != b"trak":
            for k, v in _tree(b, x, y).items():
                out.setdefault(k, []).extend(v)
    return out


def _traks(b: bytes) -> Iterator[tuple[int, dict]]:
    i, j = movie(b)
    for kind, x, y in boxes(b, i, j):
        if kind == b"trak":
            t = _tree(b, x, y)
            at = t[b"tkhd"][0][0]
            yield int.from_bytes(b[at + (20 if b[at] == 1 else 12) :][:4], "big"), t


def _table(b: bytes, t: dict, kind: bytes, width: int, skip: int = 4) -> list[tuple[int, ...]]:
    """The rows of a full box of fixed rows of 32-bit numbers."""
    if kind not in t:
        return []
    c = Cursor(b, *t[kind][0])
    c.take(skip)
    return [tuple(c.uint(4) for _ in range(width)) for _ in range(c.uint(4))]


def _movie_scale(b: bytes) -> int:
    """Ticks a second of the movie's own clock; 0 where it has no header."""
    for kind, x, _ in boxes(b, *movie(b)):
        if kind == b"mvhd":
            return int.from_bytes(b[x + (20 if b[x] == 1 else 12) :][:4], "big")
    return 0


def edit_shift(b: bytes, t: dict, movie_scale: int) -> int:
    """Ticks to add to a track's times: empty edits at its beginning delay it, the first other one skips into it."""
    if b"elst" not in t:
        return 0
    c = Cursor(b, *t[b"elst"][0])
    size = 8 if c.uint(1) == 1 else 4
    c.take(3)
    delay = 0
    for _ in range(c.uint(4)):
        length, at = c.uint(size), c.uint(size)
        c.take(4)
        if at == (1 << (8 * size)) - 1:  # minus one: an empty edit
            delay += length * _media(b, t)[0] // movie_scale if movie_scale else 0
        else:
            return delay - (at - (1 << (8 * size)) if at >> (8 * size - 1) else at)
    return delay


def _media(b: bytes, t: dict) -> tuple[int, int, str]:
    c = Cursor(b, *t[b"mdhd"][0])
    wide = c.uint(1) == 1
    c.take(3 + (16 if wide else 8))
    scale, duration, lang = c.uint(4), c.uint(8 if wide else 4), c.uint(2)
    return scale, duration, "".join(chr(0x60 + (lang >> s & 31)) for s in (10, 5, 0))


def read_samples(b: bytes) -> Iterator[tuple]:
    """Every track's samples: run-length tables of sizes, times, chunks and sync points expanded. Times are in the track's timescale, as its edits shift them."""
    scale = _movie_scale(b)
    for track, t in _traks(b):
        c = Cursor(b, *t[b"stsz"][0])
        c.take(4)
        fixed, n = c.uint(4), c.uint(4)
        sizes = [fixed] * n if fixed else [c.uint(4) for _ in range(n)]
        durations = [d for count, d in _table(b, t, b"stts", 2) for _ in range(count)]
        shifts = [s - (1 << 32) if s >= 1 << 31 else s for count, s in _table(b, t, b"ctts", 2) for _ in range(count)]
        keys = {k for (k,) in _table(b, t, b"stss", 1)} if b"stss" in t else None
        if b"co64" in t:
            c = Cursor(b, *t[b"co64"][0])
            c.take(4)
            chunks = [c.uint(8) for _ in range(c.uint(4))]
        else:
            chunks = [o for (o,) in _table(b, t, b"stco", 1)]
        runs = [*_table(b, t, b"stsc", 3), (len(chunks) + 1, 0, 0)]
        i, dts = 0, edit_shift(b, t, scale)
        for (first, per, _), (following, _, _) in zip(runs, runs[1:], strict=False):
            for chunk in range(first, following):
                at = chunks[chunk - 1]
                for _ in range(per):
                    if i >= n:
                        break
                    d = durations[i] if i < len(durations) else 0
                    yield track, i, at, sizes[i], dts, dts + (shifts[i] if i < len(shifts) else 0), d, keys is None or i + 1 in keys
                    at, dts, i = at + sizes[i], dts + d, i + 1


def read_tracks(b: bytes) -> Iterator[tuple]:
    for track, t in _traks(b):
        scale, duration, lang = _media(b, t)
        kind = b[t[b"hdlr"][0][0] + 8 :][:4].decode("latin-1") if b"hdlr" in t else None
        codec = w = h = None
        if b"stsd" in t:
            i, j = t[b"stsd"][0]
            for name, x, _ in boxes(b, i + 8, j):
                codec = name.decode("latin-1")
                if kind == "vide":
                    w, h = int.from_bytes(b[x + 24 : x + 26], "big"), int.from_bytes(b[x + 26 : x + 28], "big")
                break
        n = int.from_bytes(b[t[b"stsz"][0][0] + 8 :][:4], "big") if b"stsz" in t else 0
        yield track, {"vide": "video", "soun": "audio", "text": "subtitles", "sbtl": "subtitles"}.get(kind, "other"), codec, lang, scale, duration, w, h, n
