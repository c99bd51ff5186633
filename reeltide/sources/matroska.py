"""Matroska: tracks, chapters and frames, with lacing undone."""

from __future__ import annotations

from collections.abc import Iterator

from reeltide.sources.bits import Missing

TRACKS = "track int, type string, codec string, lang string, name string, forced boolean, is_default boolean, width int, height int, channels int, rate double, default_duration bigint"
FRAMES = "track int, ord bigint, pts bigint, duration bigint, keyframe boolean, data binary"
CHAPTERS = "ord int, at bigint"

#: Element numbers.
SEGMENT, INFO, SCALE, TRACK_LIST, TRACK = 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
CLUSTER, CLUSTER_TIME, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CHAPTER_LIST, EDITION, ATOM, ATOM_START, ATOM_HIDDEN, ATOM_ENABLED, EDITION_DEFAULT = 0x1043A770, 0x45B9, 0xB6, 0x91, 0x98, 0x4598, 0x45DB
KINDS = {1: "video", 2: "audio", 17: "subtitles"}


def vint(b: bytes, at: int, keep: bool = False) -> tuple[int | None, int]:
    """(value, length) of a variable-length number; None where all its bits are set (unknown) and it is no id."""
    if at >= len(b):
        raise Missing(at, 1)
    if b[at] == 0:
        raise ValueError("bad number")
    n = 9 - b[at].bit_length()
    if at + n > len(b):
        raise Missing(at, n)
    v = int.from_bytes(b[at : at + n], "big")
    if keep:
        return v, n
    v &= (1 << (7 * n)) - 1
    return (None if v == (1 << (7 * n)) - 1 else v), n


def elements(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the elements between two places; one of unknown length goes on to the end.

    Zeros up to the end are padding. An element that says it goes on where the input has ended is an error that tells which bytes are missing; so is one that
    goes on beyond its parent.
    """
    while at < end:
        if b[at] == 0 and not any(b[at:end]):
            return
        ident, n = vint(b, at, keep=True)
        size, m = vint(b, at + n)
        begin = at + n + m
        stop = end if size is None else begin + size
        if stop > len(b):
            raise Missing(len(b), stop - len(b))
        if stop > end:
            raise ValueError(f"an element at {at} goes on beyond its parent")
        yield ident, begin, stop
        at = stop


def _uint(b: bytes, i: int, j: int) -> int:
    return int.from_bytes(b[i:j], "big")


def _float(b: bytes, i: int, j: int) -> float:
    import struct

    return struct.unpack(">f" if j - i == 4 else ">d", b[i:j])[0] if j - i in (4, 8) else 0.0


def _segment(b: bytes) -> Iterator[tuple[int, int, int]]:
    found = False
    for ident, i, j in elements(b, 0, len(b)):
        if ident == SEGMENT:
            found = True
            yield from _flat(b, i, j)
    if not found:
        raise Missing(len(b), 1)


def _flat(b: bytes, i: int, j: int) -> Iterator[tuple[int, int, int]]:
    """Children of a segment; a cluster of unknown length ends where the next one begins."""
    for ident, x, y in elements(b, i, j):
        if ident == CLUSTER and y == j:
            nxt = b.find(CLUSTER.to_bytes(4, "big"), x)
            if 0 <= nxt < j:
                yield ident, x, nxt
                yield from _flat(b, nxt, j)
                return
        yield ident, x, y


def read_tracks(b: bytes) -> Iterator[tuple]:
    for ident, i, j in _segment(b):
        if ident != TRACK_LIST:
            continue
        for t, x, y in elements(b, i, j):
            if t != TRACK:
                continue
            f = {"lang": "eng", "forced": 0, "default": 1}
            for e, p, q in elements(b, x, y):
                if e in (0xD7, 0x83, 0x55AA, 0x88, 0x23E383):
                    f[{0xD7: "n", 0x83: "type", 0x55AA: "forced", 0x88: "default", 0x23E383: "duration"}[e]] = _uint(b, p, q)
                elif e in (0x86, 0x22B59C, 0x536E, 0x22B59D):
                    f[{0x86: "codec", 0x22B59C: "lang", 0x536E: "name", 0x22B59D: "lang"}[e]] = b[p:q].rstrip(b"\0").decode("utf-8", "replace")
                elif e in (0xE0, 0xE1):
                    for k, r, s in elements(b, p, q):
                        if k in (0xB0, 0xBA, 0x9F):
                            f[{0xB0: "w", 0xBA: "h", 0x9F: "channels"}[k]] = _uint(b, r, s)
                        elif k == 0xB5:
                            f["rate"] = _float(b, r, s)
            yield f.get("n"), KINDS.get(f.get("type"), "other"), f.get("codec"), f["lang"], f.get("name"), bool(f["forced"]), bool(f["default"]), f.get("w"), f.get("h"), f.get("channels"), f.get("rate"), f.get("duration")


def unlace(b: bytes, lacing: int) -> list[bytes]:
    """The frames of a block: 0 no lacing, 1 Xiph, 2 fixed, 3 EBML."""
    if lacing == 0:
        return [b]
    n, at = b[0] + 1, 1
    sizes: list[int] = []
    if lacing == 2:
        return [b[at + i * ((len(b) - 1) // n) : at + (i + 1) * ((len(b) - 1) // n)] for i in range(n)]
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while b[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + b[at], at + 1
            sizes.append(size)
    else:
        for i in range(n - 1):
            v, m = vint(b, at)
            v = (1 << (7 * m)) - 1 if v is None else v
            at += m
            sizes.append(v if i == 0 else sizes[-1] + v - ((1 << (7 * m - 1)) - 1))
    out = []
    for size in sizes:
        out.append(b[at : at + size])
        at += size
    return [*out, b[at:]]


def read_frames(b: bytes) -> Iterator[tuple]:
    """Frames in file order; times in nanoseconds. Laced frames after the first are a default duration apart, where that is known."""
    scale, order = 1_000_000, 0
    apart = {t[0]: t[11] for t in read_tracks(b)}

    def block(data: bytes, base: int, key: bool | None, duration: int | None) -> Iterator[tuple]:
        nonlocal order
        track, n = vint(data, 0)
        rel = int.from_bytes(data[n : n + 2], "big", signed=True)
        flags = data[n + 2]
        for i, frame in enumerate(unlace(data[n + 3 :], flags >> 1 & 3)):
            pts = (base + rel) * scale + i * (apart.get(track) or 0)
            yield track, order, pts, None if duration is None else duration * scale, bool(flags & 0x80) if key is None else key, frame
            order += 1

    for ident, i, j in _segment(b):
        if ident == INFO:
            for e, p, q in elements(b, i, j):
                if e == SCALE:
                    scale = _uint(b, p, q)
        elif ident == CLUSTER:
            base = 0
            for e, p, q in elements(b, i, j):
                if e == CLUSTER_TIME:
                    base = _uint(b, p, q)
                elif e == SIMPLE:
                    yield from block(b[p:q], base, None, None)
                elif e == GROUP:
                    inner = {k: (r, s) for k, r, s in elements(b, p, q)}
                    if BLOCK in inner:
                        duration = _uint(b, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None
                        yield from block(b[slice(*inner[BLOCK])], base, REFERENCE not in inner, duration)


def read_chapters(b: bytes) -> Iterator[tuple]:
    """Starts of the first default edition that has chapters, else of the first edition that has; hidden and disabled ones are left out."""
    editions = []
    for ident, i, j in _segment(b):
        if ident == CHAPTER_LIST:
            for e, p, q in elements(b, i, j):
                if e == EDITION:
                    default, times = False, []
                    for k, r, s in elements(b, p, q):
                        if k == EDITION_DEFAULT:
                            default = _uint(b, r, s) == 1
                        elif k == ATOM:
                            at = {x: _uint(b, u, v) for x, u, v in elements(b, r, s) if x in (ATOM_START, ATOM_HIDDEN, ATOM_ENABLED)}
                            if at.get(ATOM_HIDDEN, 0) == 0 and at.get(ATOM_ENABLED, 1) == 1:
                                times.append(at.get(ATOM_START, 0))
                    if times:
                        editions.append((not default, len(editions), times))
    if editions:
        yield from enumerate(min(editions)[2])
