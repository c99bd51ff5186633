"""Media files as tables.

Two ways in. `read_media` parses whole files that any store of Spark's holds, through the binaryFile source: one row a record, with `file`. The Python Data
Source `media` (spark.read.format("media")) reads local or mounted files, one partition a file, and takes filters on `pid` down to the packet reader.
A file that cannot be parsed fails the read, or with mode PERMISSIVE gives a row of nulls but for `error`, which says what was missing and where.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from reeltide.sources import elementary, matroska, mp4, playlists, transport

#: kind -> (parser of a file's bytes, its columns)
KINDS: dict[str, tuple[Callable[[bytes], Iterator[tuple]], str]] = {
    "mpls": (playlists.parse_playlist, playlists.PLAYLIST),
    "clpi": (playlists.parse_clip, playlists.CLIP),
    "m2ts": (transport.read_pes, transport.PES),
    "m2ts_program": (transport.read_program, transport.PROGRAM),
    "mkv_tracks": (matroska.read_tracks, matroska.TRACKS),
    "mkv_frames": (matroska.read_frames, matroska.FRAMES),
    "mkv_chapters": (matroska.read_chapters, matroska.CHAPTERS),
    "mp4_tracks": (mp4.read_tracks, mp4.TRACKS),
    "mp4_samples": (mp4.read_samples, mp4.SAMPLES),
    "annexb": (elementary.read_units, elementary.UNITS),
    "sup": (elementary.read_sup, elementary.SEGMENTS),
    "y4m": (elementary.read_y4m, elementary.PICTURES),
    "ac3": (elementary.parse_ac3, elementary.AUDIO),
    "lpcm": (elementary.parse_lpcm, elementary.AUDIO),
}
BATCH = 1000


def schema_of(kind: str) -> str:
    return f"file string, {KINDS[kind][1]}, error string"


def _width(columns: str) -> int:
    """How many columns a schema's text has at its top level."""
    depth = n = 0
    for x in columns:
        depth += (x == "<") - (x == ">")
        n += x == "," and depth == 0
    return n + 1


def parsed(kind: str, name: str, data: bytes, strict: bool, **more) -> Iterator[tuple]:
    """A file's rows; if it is not strict, a row with the error after those that were read."""
    parser, columns = KINDS[kind]
    width = _width(columns)
    try:
        for row in parser(data, **more):
            yield name, *row, None
    except Exception as e:
        if strict:
            raise
        yield name, *[None] * width, f"{type(e).__name__}: {e}"


def read_media(spark: SparkSession, path: str, kind: str, mode: str = "FAILFAST", recursive: bool = False) -> DataFrame:
    """All records of the files at `path` (a glob that Spark understands): file, the columns of `kind`, error."""
    schema = T._parse_datatype_string(schema_of(kind))
    arrow = to_arrow_schema(schema)
    strict = mode.upper() == "FAILFAST"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(arrow.names, _named(row, schema), strict=True)) for row in held], arrow)

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for row in parsed(kind, name, content.as_py(), strict):
                    held.append(row)
                    if len(held) >= BATCH:
                        yield done()
                        held = []
        if held:
            yield done()

    return files.mapInArrow(run, schema)


def _named(value, kind: T.DataType):
    """Tuples of nested structs as dictionaries."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        named = {f.name: _named(v, f.dataType) for f, v in zip(kind.fields, value, strict=True)}
        return tuple(named.values()) if kind.names[0] == "file" else named
    if isinstance(kind, T.ArrayType):
        return [_named(v, kind.elementType) for v in value]
    return value


class MediaSource(DataSource):
    """spark.read.format("media").option("kind", "m2ts").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return schema_of(self.options["kind"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MediaReader(self.options)


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.path = options["kind"], options["path"]
        self.strict = options.get("mode", "FAILFAST").upper() == "FAILFAST"
        self.pids: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.kind == "m2ts" and isinstance(f, EqualTo) and f.attribute == ("pid",):
                self.pids = {f.value} if self.pids is None else self.pids & {f.value}
            elif self.kind == "m2ts" and isinstance(f, In) and f.attribute == ("pid",):
                self.pids = set(f.value) if self.pids is None else self.pids & set(f.value)
            else:
                yield f

    def partitions(self) -> list[FilePartition]:
        found = sorted(glob.glob(self.path)) if not os.path.isdir(self.path) else sorted(glob.glob(f"{self.path}/*"))
        return [FilePartition(p) for p in found if os.path.isfile(p)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        yield from parsed(self.kind, partition.path, data, self.strict, **({"pids": self.pids} if self.pids is not None else {}))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaSource)


def settled(files: DataFrame, now, seconds: int = 60) -> DataFrame:
    """Sources (rows of path, modificationTime, length) by their directory whose newest file has not changed for a while."""
    d = files.withColumn("source", F.regexp_replace("path", "/[^/]*$", ""))
    return d.groupBy("source").agg(F.max("modificationTime").alias("changed"), F.sum("length").alias("bytes")).where(F.col("changed") < F.lit(now) - F.expr(f"INTERVAL {seconds} SECONDS"))
