"""Disc playlists (.mpls) and clip information (.clpi)."""

from __future__ import annotations

from collections.abc import Iterator

from reeltide.sources.bits import Cursor

#: Coding types of stream entries.
VIDEO = {0x01, 0x02, 0x1B, 0x20, 0x24, 0xEA}
AUDIO = {0x03, 0x04, 0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0xA1, 0xA2}
GRAPHICS = {0x90, 0x91}
TEXT = 0x92
DEPENDENT_VIEW = 8

PLAYLIST = (
    "version string, base_view_is_right boolean, "
    "items array<struct<item:int,clip:string,in_time:bigint,out_time:bigint,connection:int,dependent_clip:string,"
    "streams array<struct<kind:int,pid:int,coding:int,format:int,rate:int,lang:string>>>>, "
    "marks array<struct<ord:int,type:int,play_item:int,time:bigint>>"
).replace("streams array", "streams:array")
CLIP = "pid int, coding int, format int, rate int, lang string"


def _attributes(c: Cursor) -> tuple[int, int | None, int | None, str | None]:
    coding, form, rate, lang = c.uint(1), None, None, None
    if coding in VIDEO or coding in AUDIO:
        v = c.uint(1)
        form, rate = v >> 4, v & 15
    if coding == TEXT:
        c.take(1)
    if coding in AUDIO or coding in GRAPHICS or coding == TEXT:
        lang = c.text(3)
    return coding, form, rate, lang


def _streams(c: Cursor) -> list[tuple]:
    c = c.sub(c.uint(2))
    c.take(2)
    counts = [c.uint(1) for _ in range(7)]
    c.take(5)
    out = []
    for kind, n in enumerate(counts):
        for _ in range(n):
            e = c.sub(c.uint(1))
            where = e.uint(1)
            e.take({1: 0, 2: 2, 3: 1, 4: 2}.get(where, 0))
            pid = e.uint(2) if where in (1, 2, 3, 4) else None
            coding, form, rate, lang = _attributes(c.sub(c.uint(1)))
            out.append((kind, pid, coding, form, rate, lang))
    return out


def _item(c: Cursor) -> list:
    c = c.sub(c.uint(2))
    clip = c.text(5)
    c.take(4)
    flags = c.uint(2)
    c.take(1)
    begin, end = c.uint(4), c.uint(4)
    c.take(12)
    if flags & 0x10:
        angles = c.uint(1)
        c.take(1 + 10 * max(0, angles - 1))
    return [clip, begin, end, flags & 15, None, _streams(c)]


def _sub_items(c: Cursor) -> tuple[int, list[tuple[str, int]]]:
    c = c.sub(c.uint(4))
    c.take(1)
    kind = c.uint(1)
    c.take(3)
    out = []
    for _ in range(c.uint(1)):
        s = c.sub(c.uint(2))
        clip = s.text(5)
        s.take(8 + 8)
        out.append((clip, s.uint(2)))
    return kind, out


def parse_playlist(data: bytes) -> Iterator[tuple]:
    """One row: version, base_view_is_right, items, marks. Clips of the dependent view go to the item they sync to, or to that of their own place."""
    if data[:4] != b"MPLS" or len(data) < 40:
        raise ValueError("not a playlist")
    head = Cursor(data, 4)
    version = head.text(4)
    lists, marks_at, extension = head.uint(4), head.uint(4), head.uint(4)
    info = Cursor(data, 40)
    info.take(4 + 4 + 8)
    right = bool(info.uint(2) & 0x1000)

    c = Cursor(data, lists)
    c.take(6)
    n_items, n_subs = c.uint(2), c.uint(2)
    items = [_item(c) for _ in range(n_items)]
    subs = [_sub_items(c) for _ in range(n_subs)]
    if 0 < extension < len(data):
        subs += _extended(data, extension)
    for kind, entries in subs:
        if kind == DEPENDENT_VIEW:
            for i, (clip, sync) in enumerate(entries):
                at = sync if sync < len(items) else i
                if at < len(items) and items[at][4] is None:
                    items[at][4] = clip
    marks = []
    if marks_at:
        m = Cursor(data, marks_at + 4)
        for i in range(m.uint(2)):
            m.take(1)
            kind, item, time = m.uint(1), m.uint(2), m.uint(4)
            m.take(6)
            marks.append((i, kind, item, time))
    yield version, right, [(i, *x) for i, x in enumerate(items)], marks


def _extended(data: bytes, at: int) -> list:
    """Sub-paths of the extension data (entry 2.2); a damaged extension gives none."""
    try:
        c = Cursor(data, at + 11)
        for _ in range(c.uint(1)):
            a, b, start, _length = c.uint(2), c.uint(2), c.uint(4), c.uint(4)
            if (a, b) == (2, 2):
                e = Cursor(data, at + start)
                e.take(4)
                return [_sub_items(e) for _ in range(e.uint(2))]
    except Exception:
        pass
    return []


def _programs(data: bytes, at: int) -> Iterator[tuple]:
    c = Cursor(data, at)
    c.take(5)
    for _ in range(c.uint(1)):
        c.take(6)
        streams = c.uint(1)
        c.take(1)
        for _ in range(streams):
            pid = c.uint(2)
            yield pid, *_attributes(c.sub(c.uint(1)))


def parse_clip(data: bytes) -> Iterator[tuple]:
    """The program's streams, then those of the 3D extension (entry 2.5)."""
    if data[:4] != b"HDMV" or len(data) < 40:
        raise ValueError("not clip information")
    yield from _programs(data, int.from_bytes(data[12:16], "big"))
    extension = int.from_bytes(data[24:28], "big")
    if extension and extension + 12 <= len(data):
        c = Cursor(data, extension + 11)
        for _ in range(c.uint(1)):
            a, b, start, _length = c.uint(2), c.uint(2), c.uint(4), c.uint(4)
            if (a, b) == (2, 5):
                yield from _programs(data, extension + start)
