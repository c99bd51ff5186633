"""Elementary streams: access units of start-code streams, caption segments, audio headers, raw pictures."""

from __future__ import annotations

from collections.abc import Iterator

from reeltide.sources.bits import Cursor, Missing

UNITS = "ord bigint, key boolean, size bigint, nals int, data binary"
SEGMENTS = "ord bigint, pts bigint, dts bigint, type int, data binary"
PICTURES = "ord bigint, width int, height int, y binary, u binary, v binary"
AUDIO = "codec string, channels int, rate int, kbps int"

#: AC-3 bit rates in kilobits a second, by frame size code div 2; channels by coding mode.
AC3_RATES = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]
AC3_CHANNELS = [2, 1, 2, 3, 3, 4, 4, 5]
SAMPLE_RATES = [48000, 44100, 32000]


def split_units(b: bytes) -> list[bytes]:
    """NAL units of a start-code stream, without start codes and trailing zeros."""
    out, at = [], b.find(b"\0\0\1")
    while at >= 0:
        nxt = b.find(b"\0\0\1", at + 3)
        unit = b[at + 3 : nxt if nxt >= 0 else len(b)].rstrip(b"\0") if nxt >= 0 else b[at + 3 :]
        if unit:
            out.append(unit)
        at = nxt
    return out


def start_codes(b: bytes, size: int) -> bytes:
    """Length-prefixed units as a start-code stream."""
    c, out = Cursor(b), bytearray()
    while c.at < c.end:
        out += b"\0\0\0\1" + c.take(c.uint(size))
    return bytes(out)


def unescaped(unit: bytes) -> bytes:
    """A unit without its emulation prevention bytes."""
    out, zeros = bytearray(), 0
    for x in unit:
        if zeros >= 2 and x == 3:
            zeros = 0
            continue
        zeros = zeros + 1 if x == 0 else 0
        out.append(x)
    return bytes(out)


def starts_unit(unit: bytes, slices_before: bool) -> bool:
    """Whether an H.264 NAL unit, of a base or a dependent view's stream, begins a new access unit, given whether one with a slice is open."""
    kind = unit[0] & 31
    if not slices_before:
        return False
    if kind in (1, 5):
        return len(unit) > 1 and bool(unit[1] & 0x80)  # first_mb_in_slice is 0
    if kind == 20:  # a dependent view's slice has three more bytes of header
        return len(unit) > 4 and bool(unit[4] & 0x80)
    return kind in (6, 7, 8, 9, 14, 15, 16, 17, 18)


def read_units(b: bytes) -> Iterator[tuple]:
    """Access units of an H.264 start-code stream."""
    held: list[bytes] = []
    order, slices = 0, False

    def told() -> tuple:
        data = b"".join(b"\0\0\0\1" + u for u in held)
        return order, any(u[0] & 31 == 5 or (u[0] & 31 == 20 and len(u) > 1 and not u[1] & 0x40) for u in held), len(data), len(held), data

    for unit in split_units(b):
        if starts_unit(unit, slices):
            yield told()
            held, slices, order = [], False, order + 1
        held.append(unit)
        slices = slices or unit[0] & 31 in (1, 5, 20)
    if held:
        yield told()


def read_sup(b: bytes) -> Iterator[tuple]:
    """Segments of a caption file; times in 90 kHz ticks."""
    c, order = Cursor(b), 0
    while c.at < c.end:
        if c.take(2) != b"PG":
            raise ValueError("not a caption file")
        pts, dts, kind = c.uint(4), c.uint(4), c.uint(1)
        yield order, pts, dts, kind, c.take(c.uint(2))
        order += 1


def parse_ac3(b: bytes) -> Iterator[tuple]:
    """Header facts of an AC-3 or E-AC-3 frame; none if it is neither."""
    if len(b) < 7 or b[:2] != b"\x0b\x77":
        return
    if b[5] >> 3 <= 10:
        code, mode = b[4] >> 6, b[6] >> 5
        if code == 3 or (b[4] & 63) // 2 >= len(AC3_RATES):
            return
        bit = 3 + 2 * (mode & 1 and mode != 1) + 2 * bool(mode & 4) + 2 * (mode == 2)
        lfe = int.from_bytes(b[6:8].ljust(2, b"\0"), "big") >> (15 - bit) & 1
        yield "ac3", AC3_CHANNELS[mode] + lfe, SAMPLE_RATES[code], AC3_RATES[(b[4] & 63) // 2]
    elif b[5] >> 3 <= 16:
        size = ((b[2] & 7) << 8 | b[3]) * 2 + 2
        code = b[4] >> 6
        blocks = 6 if code == 3 else [1, 2, 3, 6][b[4] >> 4 & 3]
        rate = SAMPLE_RATES[b[4] >> 4 & 3] // 2 if code == 3 else SAMPLE_RATES[code]
        yield "eac3", AC3_CHANNELS[b[4] >> 1 & 7] + (b[4] & 1), rate, size * 8 * rate // (blocks * 256) // 1000


def parse_lpcm(b: bytes) -> Iterator[tuple]:
    """Header facts of disc LPCM."""
    if len(b) < 4:
        return
    channels = {1: 1, 3: 2, 4: 3, 5: 3, 6: 4, 7: 4, 8: 5, 9: 6, 10: 7, 11: 8}.get(b[2] >> 4)
    rate = {1: 48000, 4: 96000, 5: 192000}.get(b[2] & 15)
    bits = {1: 16, 2: 20, 3: 24}.get(b[3] >> 6)
    if channels and rate and bits:
        yield "lpcm", channels, rate, channels * rate * bits // 1000


def read_y4m(b: bytes) -> Iterator[tuple]:
    """Pictures of a Y4M file of 8 bits, 4:2:0 or mono."""
    end = b.index(b"\n")
    head = b[:end].decode("latin-1").split()
    if head[0] != "YUV4MPEG2":
        raise ValueError("not a Y4M file")
    f = {x[0]: x[1:] for x in head[1:]}
    w, h, mono = int(f["W"]), int(f["H"]), f.get("C", "420").startswith("mono")
    cw, ch = (0, 0) if mono else ((w + 1) // 2, (h + 1) // 2)
    c, order = Cursor(b, end + 1), 0
    while c.at < c.end:
        line = b.index(b"\n", c.at)
        if b[c.at : c.at + 5] != b"FRAME":
            raise ValueError("no picture where one should begin")
        c.at = line + 1
        yield order, w, h, c.take(w * h), c.take(cw * ch), c.take(cw * ch)
        order += 1
