"""Large media files by ranges of bytes: one file is many partitions, and Spark joins what crosses a border.

`spark.read.format("media_ranges").option("kind", ...).load(path)` lists the files (a file, a glob, or a folder, walked), cuts each into ranges of `rangeBytes` and gives the records that begin in a range. A reader
begins a little before its range, finds the first place where the format's marks recur, and drops what begins too early; so n partitions give the rows of one, and damage costs what it touches.

- `packets`: transport stream packets of 188 or 192 bytes. `units` counts unit starts over the ranges and puts PES packets together.
- `blocks`: frames of Matroska clusters, of the clusters that begin in the range; `from` continues at the first cluster at or after an offset.
- `samples`: MP4 samples by place in the file; their tables come from the movie box, found by reading box headers only.

`from` and `places` with `placeBytes` read a part only: everything from an offset on, or so many short ranges at even fractions of each file. Files are opened through pyarrow's file systems; a task holds
one window of WINDOW bytes and one record.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from reeltide.operators.ranges import running_sum
from reeltide.sources import matroska, mp4, transport

WINDOW, RANGE = 1 << 20, 64 << 20
#: Packets that must carry a sync byte, one after the other, before a place is taken for the beginning of one; and packets read before a range.
AGREE, BEFORE = 4, 64
PACKETS = "file string, at bigint, pid int, unit_start boolean, counter int, payload binary"
BLOCKS = "file string, at bigint, cluster_at bigint, track int, ticks bigint, duration bigint, keyframe boolean, lace int, data binary"
SAMPLES = "file string, at bigint, track int, ord bigint, pts bigint, dts bigint, duration bigint, keyframe boolean, data binary"
KINDS = {"packets": (PACKETS, (".ts", ".m2ts", ".mts", ".ssif")), "blocks": (BLOCKS, (".mkv", ".webm", ".mka")), "samples": (SAMPLES, (".mp4", ".m4v", ".mov", ".m4a"))}


class Bytes:
    """A file read at places, through one window."""

    def __init__(self, path: str):
        self.path = path
        fs, name = opened(path)
        self.size = fs.get_file_info(name).size
        self.file = fs.open_input_file(name)
        self.begin, self.held = 0, b""

    def at(self, place: int, n: int) -> bytes:
        """Up to n bytes from a place; fewer at the end of the file."""
        n = max(0, min(n, self.size - place))
        if not self.begin <= place or place + n > self.begin + len(self.held):
            self.file.seek(place)
            self.begin, self.held = place, self.file.read(max(n, min(WINDOW, self.size - place)))
        return self.held[place - self.begin : place - self.begin + n]

    def find(self, mark: bytes, place: int, end: int) -> int:
        """The first occurrence of `mark` that begins in place to end - 1, or -1."""
        while place < end:
            some = self.at(place, min(WINDOW, end - place + len(mark) - 1))
            found = some.find(mark)
            if found >= 0:
                return place + found if place + found < end else -1
            if len(some) < len(mark):
                return -1
            place += len(some) - len(mark) + 1
        return -1

    def close(self) -> None:
        self.file.close()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(name, size) of the files at a path; of those below a folder only the ones with the kind's endings."""
    if "://" not in path and any(c in path for c in "*?["):
        return sorted((p, os.path.getsize(p)) for p in glob.glob(path) if os.path.isfile(p))
    fs, name = opened(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(name, recursive=True))
    root = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((root + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(endings))


# --- transport stream packets


def packet_form(f: Bytes) -> tuple[int, int]:
    """(size, place of the sync byte) by which step sync bytes recur most often over the first packets."""
    head = np.frombuffer(f.at(0, 192 * 1024), np.uint8) == 0x47
    best = (0.0, 188)
    for size in (188, 192):
        whole = head[: head.size // size * size].reshape(-1, size)
        if whole.size:
            best = max(best, (float(whole.mean(axis=0).max()), size))
    return best[1], 4 if best[1] == 192 else 0


def locked(f: Bytes, place: int, size: int, end: int) -> int:
    """The first sync byte at or after `place` that recurs AGREE times, as far as the file goes; -1 if none begins before `end`."""
    while (place := f.find(b"G", place, end)) >= 0:
        some = f.at(place, size * AGREE)
        if all(some[i] == 0x47 for i in range(0, len(some), size)):
            return place
        place += 1
    return -1


def packets(f: Bytes, start: int, end: int, pids: set[int] | None = None) -> Iterator[pa.RecordBatch]:
    """The packets whose sync byte lies in start to end - 1. Where sync is lost, they go on at the next place where it recurs."""
    size, _ = packet_form(f)
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("pid", pa.int32()), ("unit_start", pa.bool_()), ("counter", pa.int32()), ("payload", pa.binary())])
    place = locked(f, max(0, start - BEFORE * size), size, end)
    while 0 <= place < end:
        n = max(1, min(WINDOW // size, -(-(end - place) // size)))
        raw = f.at(place, n * size)
        whole = (len(raw) - 188) // size + 1  # the last one of a file of 192-byte packets has no head after it
        if whole < 1:
            return
        table = np.frombuffer(raw.ljust(whole * size, b"\0"), np.uint8)[: whole * size].reshape(whole, size)
        good = table[:, 0] == 0x47
        run = whole if good.all() else int(np.argmin(good))
        t, at = table[:run], place + np.arange(run) * size
        pid = (t[:, 1].astype(np.int32) & 0x1F) << 8 | t[:, 2]
        control = t[:, 3] >> 4 & 3
        begin = np.where(control & 2, 5 + t[:, 4].astype(np.int64), 4)
        keep = (at >= start) & (at < end)
        if pids is not None:
            keep &= np.isin(pid, list(pids))
        rows = np.flatnonzero(keep)
        if rows.size:
            payload = [raw[i * size + b : i * size + 188] if c & 1 and b <= 188 else b"" for i, b, c in zip(rows.tolist(), begin[rows].tolist(), control[rows].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f.path] * rows.size), pa.array(at[rows]), pa.array(pid[rows], pa.int32()), pa.array((t[rows, 1] & 0x40) > 0), pa.array(t[rows, 3] & 15, pa.int32()), pa.array(payload, pa.binary())], schema=schema)
        if run == whole and len(raw) == n * size:
            place += whole * size
        elif run == whole or place + run * size + 188 > f.size:
            return
        else:
            place = locked(f, place + run * size + 1, size, end)


def units(rows: DataFrame, bucket_bytes: int = 8 << 20) -> DataFrame:
    """PES packets of rows of `packets`: file, pid, at (of the first packet), stream_id, pts, dts, payload.

    Unit starts are counted along each (file, pid) in two levels, so a packet's unit may have begun in another range; what comes before the first start, and what is no PES packet (tables), is left out.
    """
    rows = rows.where("pid <> 8191")
    counted = running_sum(rows, ["file", "pid"], ["at"], F.floor(F.col("at") / bucket_bytes), F.col("unit_start").cast("int"), "unit").where("unit > 0")
    whole = counted.groupBy("file", "pid", "unit").agg(F.sort_array(F.collect_list(F.struct("at", "payload"))).alias("parts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, pid, parts in zip(batch.column("file").to_pylist(), batch.column("pid").to_pylist(), batch.column("parts"), strict=True):
                parts = parts.as_py()
                told = transport._pes(pid, b"".join(p["payload"] for p in parts), 0)
                if told:
                    out.append({"file": name, "pid": pid, "at": parts[0]["at"], "stream_id": told[1], "pts": told[2], "dts": told[3], "payload": told[5]})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("pid", pa.int32()), ("at", pa.int64()), ("stream_id", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("payload", pa.binary())]))

    return whole.select("file", "pid", "parts").mapInArrow(decode, "file string, pid int, at bigint, stream_id int, pts bigint, dts bigint, payload binary")


# --- Matroska clusters

#: Elements that a cluster may begin with.
FIRST = (matroska.CLUSTER_TIME, 0xBF, 0xEC, 0xA7, 0xAB, 0x5854)
TOP = (matroska.CLUSTER, matroska.INFO, matroska.TRACK_LIST, matroska.CHAPTER_LIST, 0x1C53BB6B, 0x1254C367, 0x1941A469, 0x114D9B74)


def element(f: Bytes, place: int) -> tuple[int, int | None, int] | None:
    """(id, size, begin) of the element at a place; None where there is none."""
    head = f.at(place, 12)
    try:
        ident, n = matroska.vint(head, 0, keep=True)
        size, m = matroska.vint(head, n)
    except Exception:
        return None
    return ident, size, place + n + m


def next_cluster(f: Bytes, place: int, end: int) -> int:
    """The first cluster that begins in place to end - 1, by its number and a first child that a cluster may have; -1 if none."""
    mark = matroska.CLUSTER.to_bytes(4, "big")
    while (place := f.find(mark, place, end)) >= 0:
        head = element(f, place)
        child = head and element(f, head[2])
        if child and child[0] in FIRST and child[1] is not None and (child[0] != matroska.CLUSTER_TIME or child[1] <= 8):
            return place
        place += 1
    return -1


def blocks(f: Bytes, start: int, end: int) -> Iterator[tuple]:
    """Frames of the clusters that begin in start to end - 1. A broken cluster ends where its elements no longer make sense; the next one is looked for from there."""
    place = next_cluster(f, start, end)
    while place >= 0:
        _, size, at = element(f, place)
        stop = f.size if size is None else min(f.size, at + size)
        cluster, base, whole = place, 0, True
        while at < stop:
            e = element(f, at)
            if e is None or (size is None and e[0] in TOP) or e[1] is None or e[2] + e[1] > stop:
                whole = size is None and e is not None and e[0] in TOP
                break
            ident, n, begin = e
            if ident == matroska.CLUSTER_TIME:
                base = int.from_bytes(f.at(begin, n), "big")
            elif ident in (matroska.SIMPLE, matroska.GROUP):
                yield from frames(f.path, cluster, at, base, ident, f.at(begin, n))
            at = begin + n
        place = next_cluster(f, max(at, place + 4) if whole else max(place + 4, at), end)


def frames(name: str, cluster: int, at: int, base: int, ident: int, data: bytes) -> Iterator[tuple]:
    duration, key = None, None
    if ident == matroska.GROUP:
        inner = {k: (r, s) for k, r, s in matroska.elements(data, 0, len(data))}
        if matroska.BLOCK not in inner:
            return
        key = matroska.REFERENCE not in inner
        if matroska.BLOCK_DURATION in inner:
            duration = int.from_bytes(data[slice(*inner[matroska.BLOCK_DURATION])], "big")
        data = data[slice(*inner[matroska.BLOCK])]
    track, n = matroska.vint(data, 0)
    ticks, flags = base + int.from_bytes(data[n : n + 2], "big", signed=True), data[n + 2]
    for i, frame in enumerate(matroska.unlace(data[n + 3 :], flags >> 1 & 3)):
        yield name, at, cluster, track, ticks, duration, bool(flags & 0x80) if key is None else key, i, frame


# --- MP4 samples


def movie_box(f: Bytes) -> bytes:
    """The movie box, found by reading headers of boxes only."""
    at = 0
    while at + 8 <= f.size:
        head = f.at(at, 16)
        n, kind = int.from_bytes(head[:4], "big"), head[4:8]
        if n == 1:
            n = int.from_bytes(head[8:16], "big")
        elif n == 0:
            n = f.size - at
        if kind == b"moov":
            return f.at(at, n)
        if n < 8:
            break
        at += n
    raise ValueError("no movie box")


def samples(f: Bytes, start: int, end: int) -> Iterator[tuple]:
    """Samples that begin in start to end - 1, in the order of the file."""
    told = [s for s in mp4.read_samples(movie_box(f)) if start <= s[2] < end]
    for track, order, at, size, dts, pts, duration, key in sorted(told, key=lambda s: (s[2], s[0], s[1])):
        yield f.path, at, track, order, pts, dts, duration, key, f.at(at, size)


# --- the source


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_ranges"

    def schema(self) -> str:
        return KINDS[self.options["kind"]][0]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.path = options["kind"], options["path"]
        self.bytes, self.first = int(options.get("rangeBytes", RANGE)), int(options.get("from", 0))
        self.places, self.place_bytes = int(options.get("places", 0)), int(options.get("placeBytes", 4 << 20))
        self.pids: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if self.kind == "packets" and asked is not None and f.attribute == ("pid",):
                self.pids = asked if self.pids is None else self.pids & asked
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for path, size in listed(self.path, KINDS[self.kind][1]):
            if self.places:
                starts = [int((i + 0.5) / self.places * size) for i in range(self.places)]
                out += [Range(path, s, min(s + self.place_bytes, e)) for s, e in zip(starts, [*starts[1:], size], strict=True)]
            else:
                out += [Range(path, s, min(s + self.bytes, size)) for s in range(self.first, size, self.bytes)]
        return out

    def read(self, partition: Range) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        f = Bytes(partition.path)
        try:
            if self.kind == "packets":
                yield from packets(f, partition.start, partition.end, self.pids)
            else:
                yield from (blocks if self.kind == "blocks" else samples)(f, partition.start, partition.end)
        finally:
            f.close()


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters on `pid` go down to its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RangeSource)


def read_ranges(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """The records of the files at `path`, read by ranges of bytes."""
    register(spark)
    reader = spark.read.format("media_ranges").option("kind", kind)
    for name, value in options.items():
        reader = reader.option({"range_bytes": "rangeBytes", "first": "from", "place_bytes": "placeBytes"}.get(name, name), str(value))
    return reader.load(path)


def kind_of(path: str) -> str | None:
    """The kind of a file by its ending; None if no reader takes it."""
    return next((kind for kind, (_, endings) in KINDS.items() if path.lower().endswith(endings)), None)
