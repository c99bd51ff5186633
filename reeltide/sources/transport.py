"""Transport streams: packets of 188 or 192 bytes, program tables, PES packets."""

from __future__ import annotations

from collections.abc import Iterator

PES = "pid int, stream_id int, pts bigint, dts bigint, seq bigint, payload binary"
PROGRAM = "program int, pcr_pid int, pid int, type int, lang string"


def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, 0 over a section with its CRC."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def packet_size(data: bytes) -> tuple[int, int]:
    """(size, place of the sync byte in a packet) by where sync bytes recur."""
    for size, sync in ((192, 4), (188, 0)):
        if len(data) > sync and all(data[i] == 0x47 for i in range(sync, min(len(data), size * 4), size)):
            return size, sync
    return (192, 4) if data[4:5] == b"\x47" and data[:1] != b"\x47" else (188, 0)


def packets(data: bytes) -> Iterator[bytes]:
    """188-byte packets; after damage it goes on at the next place where two sync bytes recur."""
    size, sync = packet_size(data)
    at = sync
    while at + 188 <= len(data):
        if data[at] != 0x47:
            at += 1
            while at + 188 <= len(data) and not (data[at] == 0x47 and (at + size >= len(data) or data[at + size] == 0x47)):
                at += 1
            continue
        yield data[at : at + 188]
        at += size


def _payload(p: bytes) -> tuple[int, bool, bytes]:
    pid, start, control = (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), p[3] >> 4 & 3
    at = 4 + (1 + p[4] if control & 2 else 0)
    return pid, start, p[at:] if control & 1 and at <= 188 else b""


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _pes(pid: int, b: bytes, seq: int) -> tuple | None:
    if len(b) < 6 or b[:3] != b"\0\0\1":
        return None
    stream, pts, dts, at = b[3], None, None, 6
    if stream not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xFF, 0xF2, 0xF8) and len(b) >= 9:
        flags, at = b[7] >> 6, 9 + b[8]
        if flags & 2 and len(b) >= 14:
            pts = dts = _time(b[9:14])
        if flags == 3 and len(b) >= 19:
            dts = _time(b[14:19])
    length = b[4] << 8 | b[5]
    return pid, stream, pts, dts, seq, b[at : 6 + length if length else None]


class Tables:
    """Sections put together by PID, their CRC checked."""

    def __init__(self):
        self.parts: dict[int, bytearray] = {}
        self.programs: dict[int, int] = {}

    def section(self, pid: int, start: bool, payload: bytes) -> Iterator[bytes]:
        if start and payload:
            skip = payload[0]
            if pid in self.parts:
                self.parts[pid] += payload[1 : 1 + skip]
                yield from self._whole(pid)
            self.parts[pid] = bytearray(payload[1 + skip :])
        elif pid in self.parts:
            self.parts[pid] += payload
        yield from self._whole(pid)

    def _whole(self, pid: int) -> Iterator[bytes]:
        b = self.parts.get(pid)
        while b and len(b) >= 3 and b[0] != 0xFF:
            n = 3 + ((b[1] & 15) << 8 | b[2])
            if len(b) < n:
                return
            if crc_mpeg(bytes(b[:n])) == 0:
                yield bytes(b[:n])
            del b[:n]

    def program(self, section: bytes) -> Iterator[tuple]:
        if section[0] == 0:
            for i in range(8, len(section) - 4, 4):
                number, pid = section[i] << 8 | section[i + 1], (section[i + 2] & 31) << 8 | section[i + 3]
                if number:
                    self.programs[pid] = number
        elif section[0] == 2:
            number, pcr = section[3] << 8 | section[4], (section[8] & 31) << 8 | section[9]
            i = 12 + ((section[10] & 15) << 8 | section[11])
            while i + 5 <= len(section) - 4:
                kind, pid, n = section[i], (section[i + 1] & 31) << 8 | section[i + 2], (section[i + 3] & 15) << 8 | section[i + 4]
                lang, j = None, i + 5
                while j + 2 <= i + 5 + n:
                    if section[j] == 10 and section[j + 1] >= 3:
                        lang = section[j + 2 : j + 5].decode("latin-1")
                    j += 2 + section[j + 1]
                yield number, pcr, pid, kind, lang
                i += 5 + n


def read_pes(data: bytes, pids: set[int] | None = None) -> Iterator[tuple]:
    """PES packets in the order in which they end; only of `pids` if given. Packets of tables, padding and others are never put together."""
    open_: dict[int, bytearray] = {}
    tables, seq = Tables(), 0

    def done(pid: int) -> Iterator[tuple]:
        nonlocal seq
        row = _pes(pid, bytes(open_.pop(pid)), seq)
        if row:
            seq += 1
            yield row

    for p in packets(data):
        pid, start, payload = _payload(p)
        if pid == 0x1FFF:
            continue
        if pid == 0 or pid in tables.programs:
            for s in tables.section(pid, start, payload):
                list(tables.program(s))
            continue
        if pids is not None and pid not in pids:
            continue
        if start:
            if pid in open_:
                yield from done(pid)
            if payload[:3] == b"\0\0\1":
                open_[pid] = bytearray(payload)
        elif pid in open_:
            open_[pid] += payload
        if pid in open_ and len(open_[pid]) >= 6:
            n = open_[pid][4] << 8 | open_[pid][5]
            if n and len(open_[pid]) >= 6 + n:
                yield from done(pid)
    for pid in list(open_):
        yield from done(pid)


def read_program(data: bytes) -> Iterator[tuple]:
    """The streams of the first program table."""
    tables = Tables()
    for p in packets(data):
        pid, start, payload = _payload(p)
        if pid == 0 or pid in tables.programs:
            for s in tables.section(pid, start, payload):
                rows = list(tables.program(s))
                if rows:
                    yield from rows
                    return
