"""Which tracks a conversion takes and which packets it keeps: roles, defaults, routes, windows, edges, clocks, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reeltide.operators.folds import fold
from reeltide.operators.ranges import _back, numbered, running_sum

#: Numbers of tables and of padding in a transport stream.
TABLES = (0, 0x1F, 0x1FFF)
#: Fixed value: only with this picture stream does an enhancement layer go.
LAYERED = "V_MPEGH/ISO/HEVC"


def flat_selection(tracks: DataFrame, keys: list[str], kind: str, stream: str, order: str, ident: str) -> DataFrame:
    """keys, base, enhancement, audio, subtitles: the first picture track, the first enhancement layer if the picture is of the kind that takes one, and how many tracks of sound and captions. Keys without a picture have a null base."""
    first = lambda what, value: F.min_by(value, F.when(F.col(kind) == what, F.col(order)))
    of = lambda what: F.count_if(F.col(kind) == what)
    s = tracks.groupBy(*keys).agg(first("base", F.struct(ident, stream)).alias("_b"), first("enhancement", F.col(ident)).alias("_e"), of("base").alias("_nb"), of("enhancement").alias("_ne"), of("audio").alias("audio"), of("subtitles").alias("subtitles"))
    return s.select(*keys, F.when(F.col("_nb") > 0, F.col(f"_b.{ident}")).alias("base"), F.when((F.col("_ne") > 0) & (F.col("_nb") > 0) & (F.col(f"_b.{stream}") == LAYERED), F.col("_e")).alias("enhancement"), "audio", "subtitles")


def default_tracks(tracks: DataFrame, keys: list[str], kind: str, wanted: Column, name: str, forced: str, order: str, ident: str) -> DataFrame:
    """keys, audio, subtitles: the first sound track that is wanted, and the first captions that are, neither forced nor so named, those for the hard of hearing last; null where none is."""
    low = F.lower(F.coalesce(name, F.lit("")))
    sound = wanted & (F.col(kind) == "audio")
    plain = wanted & (F.col(kind) == "subtitles") & ~F.coalesce(F.col(forced), F.lit(False)) & ~low.contains("forced") & ~low.contains("foreign")
    return tracks.groupBy(*keys).agg(F.min_by(ident, F.when(sound, F.col(order))).alias("audio"), F.min_by(ident, F.when(plain, F.struct(low.contains("sdh"), order))).alias("subtitles"))


def route(pid: Column, from_dependent: Column, keep: Column, program: Column, clock: int, dependent: int) -> Column:
    """Where a packet goes: a (base clip's queue), b (dependent view's), or null: tables and padding, what is not kept, and the dependent clip's own clock."""
    gone = pid.isin(*TABLES) | program | ~((pid == clock) | keep) | (from_dependent & (pid == clock))
    return F.when(~gone, F.when(from_dependent | (pid == dependent), "b").otherwise("a"))


def kept_packets(packets: DataFrame, keys: list[str], seq: str, role: str, pts: str, dts: str, key_frame: str, begin: str, end: str) -> DataFrame:
    """The packets of a clip's window [begin, end), columns of the packets: pictures (roles base and dependent) by decode time from the first key frame in the window, kept streams (role kept) by display time, clock references (role clock) from the key frame's place until the base has ended; others go.

    The facts of a clip (the key frame, where the base ends) are one row a key, joined back.
    """
    entry = (F.col(role) == "base") & F.col(key_frame) & (F.col(dts) >= F.col(begin))
    over = (F.col(role) == "base") & (F.col(dts) >= F.col(end))
    facts = packets.groupBy(*keys).agg(F.min_by(dts, F.when(entry, F.col(seq))).alias("_dts"), F.min(F.when(entry, F.col(seq))).alias("_at"))
    known = _back(packets, facts, keys)
    ends = known.groupBy(*keys).agg(F.min(F.when(over & (F.col(dts) >= F.col("_dts")), F.col(seq))).alias("_end"))
    known = _back(known, ends, keys)
    picture = F.col("_at").isNotNull() & (F.col(seq) >= F.col("_at")) & (F.col(dts) >= F.col("_dts")) & (F.col(dts) < F.col(end))
    other = (F.col(pts) >= F.col(begin)) & (F.col(pts) < F.col(end))
    clock = F.col("_at").isNotNull() & (F.col(seq) >= F.col("_at")) & (F.col("_end").isNull() | (F.col(seq) < F.col("_end")))
    keep = F.when(F.col(role).isin("base", "dependent"), picture).when(F.col(role) == "kept", other).when(F.col(role) == "clock", clock).otherwise(False)
    return known.where(F.coalesce(keep, F.lit(False))).select(*packets.columns)


def edge_frames(frames: DataFrame, keys: list[str], t: str, size: str, begin: Column, end: Column) -> DataFrame:
    """keys, kept, dropped (bytes), early (whether the frame before the window is taken): frames of [begin, end) are kept; the last one before goes too where it begins nearer to the window's begin than the first one inside, so that sound is within half a frame of the picture.

    One pass of sums and of the two frames beside the edge; times of a track are not repeated.
    """
    inside = (F.col(t) >= begin) & (F.col(t) < end)
    before = F.col(t) < begin
    s = frames.withColumns({"_in": inside, "_off": F.abs(F.col(t) - begin)}).groupBy(*keys).agg(
        F.count_if("_in").alias("_n"), F.sum(F.when(~F.col("_in"), F.col(size))).alias("_gone"),
        F.min(F.when(before, F.struct("_off", size))).alias("_h"), F.min(F.when(F.col("_in"), F.col("_off"))).alias("_first"),
    )
    early = F.coalesce((F.col("_h._off") < F.col("_first")) & (F.col("_n") > 0), F.lit(False))
    return s.select(*keys, (F.col("_n") + early.cast("int")).alias("kept"), (F.coalesce("_gone", F.lit(0)) - F.when(early, F.col(f"_h.{size}")).otherwise(0)).alias("dropped"), early.alias("early"))


def from_first_picture(frames: DataFrame, keys: list[str], t: str, picture: Column) -> DataFrame:
    """The frames that do not begin before the first picture of their key; all of a key without pictures go."""
    first = frames.groupBy(*keys).agg(F.min(F.when(picture, F.col(t))).alias("_t0"))
    return _back(frames, first, keys).where(F.col(t) >= F.col("_t0")).drop("_t0")


def audio_clock(rows: DataFrame, keys: list[str], place: str, order: list[str], samples: str, sync: str, carry: list[str], rate: int, threshold: int) -> DataFrame:
    """keys, carry, at, gap: when each frame of a raw stream is played, in nanoseconds.

    A row is a frame (its number of samples, a null sync) or a sync point (a null number of samples, the time that the source gives), by their place in the file, sync points first at one place. The clock counts samples, and moves forward to the last
    sync point at or before a frame if that is more than `threshold` ahead; `gap` is by how much it moved there, 0 at a stream's begin. Each step depends on the last, so a stream is read in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    n = len(keys)

    def step(state, row):
        many, at, rest = row[n], row[n + 1], row[n + 2 :]
        base, count, seen, started = state or (0, 0, None, False)
        if many is None:
            return (base, count, at, started), []
        now = base + count * 1_000_000_000 // rate
        gap = 0
        if seen is not None and seen - now > threshold:
            gap = seen - now if started else 0
            base, count, now = seen, 0, seen
        return (base, count + many, None, True), [(*row[:n], *rest, now, gap)]

    form = ", ".join(f"{c} {kinds[c]}" for c in [*keys, *carry]) + ", at bigint, gap bigint"
    ready = rows.withColumn("_second", F.col(samples).isNotNull())
    return fold(ready, keys, [place, "_second", *order], [samples, sync, *carry], step, form)


def entry_points(packets: DataFrame, keys: list[str], order: list, bucket: Column, key_frame: Column, carry: list[str], out: str = "packet") -> DataFrame:
    """The key frames of a clip with the number of their packet, counted over all of the clip's packets in two levels."""
    return numbered(packets, keys, order, bucket, out).where(key_frame).select(*keys, *carry, out)


def group_lengths(pictures: DataFrame, keys: list[str], order: list, bucket: Column, key_frame: Column) -> DataFrame:
    """keys, group, pictures: how many pictures each group holds, a group begun by a key frame; what comes before the first is group 0."""
    return running_sum(pictures, keys, order, bucket, key_frame.cast("int"), "group").groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("pictures"))
