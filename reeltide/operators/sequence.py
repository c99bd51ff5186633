"""Window rules over ordered records of a key: motion, holes, display order, cues, segments, clocks, run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from reeltide.operators.ranges import lagged, numbered, running_sum

UP_TO = (Window.unboundedPreceding, 0)
BEFORE = (Window.unboundedPreceding, -1)


def ordered(keys: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def motion(df: DataFrame, keys: list[str], order: list, sad: str, out: str) -> DataFrame:
    """0 for the first row, else the lesser of its own difference and the next one's; the last keeps its own."""
    w = ordered(keys, order)
    return df.withColumn(out, F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.least(sad, F.coalesce(F.lead(sad).over(w), F.col(sad)))))


def holes(df: DataFrame, keys: list[str], order: list, t: str, frame: int, longest: int) -> DataFrame:
    """df with `missing`: how many pictures are lost before each; a gap counts above one and a half frames and up to `longest`."""
    gap = F.col(t) - F.lag(t).over(ordered(keys, order))
    count = F.expr(f"((_gap + {frame // 2}) div {frame}) - 1")
    lost = (F.col("_gap") > frame * 3 // 2) & (F.col("_gap") <= longest)
    return df.withColumn("_gap", gap).withColumn("missing", F.when(lost, count).otherwise(0)).drop("_gap")


def filled(df: DataFrame, keys: list[str], order: list, t: str, frame: int, longest: int) -> DataFrame:
    """df with a copy of a row for every picture lost before it, at the times they would have had, `copy` 0 for the row itself."""
    h = holes(df, keys, order, t, frame, longest).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("missing"))))
    return h.withColumn(t, F.col(t) - F.col("copy") * frame).drop("missing")


def display_order(df: DataFrame, keys: list[str], order: list, reset: Column, poc: str, out: str) -> DataFrame:
    """Display numbers from 0: by picture-order count within a coded sequence, sequences in decode order."""
    w = ordered(keys, order)
    d = df.withColumn("_cvs", F.sum(reset.cast("int")).over(w.rowsBetween(*UP_TO)))
    return d.withColumn(out, F.row_number().over(ordered(keys, ["_cvs", poc, *order])) - 1).drop("_cvs")


def clipped(df: DataFrame, keys: list[str], order: list, start: str, stop: str) -> DataFrame:
    """Cues laid end to end: each starts no earlier than all before it have ended, an empty one goes, and gaps get rows of their own (`gap` true).

    A cue that ends by then is dropped, so the running end is the running maximum of the ends of cues that have a length.
    """
    w = ordered(keys, order)
    d = df.where(F.col(stop) > F.col(start)).withColumn("_end", F.coalesce(F.max(stop).over(w.rowsBetween(*BEFORE)), F.lit(0)))
    d = d.withColumn("_start", F.greatest(F.col(start), F.col("_end"))).where(F.col(stop) > F.col("_start"))
    cue = F.struct(F.col("_start").alias("begin"), F.col(stop).alias("finish"), F.lit(False).alias("gap"))
    gap = F.struct(F.col("_end").alias("begin"), F.col("_start").alias("finish"), F.lit(True).alias("gap"))
    both = F.when(F.col("_start") > F.col("_end"), F.array(gap, cue)).otherwise(F.array(cue))
    return d.withColumn("_c", F.explode(both)).select(*[c for c in df.columns if c not in (start, stop)], "_c.*")


def cue_ends(df: DataFrame, keys: list[str], t: str, default: int, out: str) -> DataFrame:
    """A cue shows until the next composition starts, the last for `default`."""
    return df.withColumn(out, F.coalesce(F.lead(t).over(ordered(keys, [t])), F.col(t) + default))


def segments(df: DataFrame, keys: list[str], order: list, size: int, out: str, bucket: Column) -> DataFrame:
    """Segment numbers: `size` rows each. Rows are numbered in two levels, over ranges that `bucket` gives."""
    return numbered(df, keys, order, bucket, "_n").withColumn(out, F.expr(f"_n div {size}")).drop("_n")


def every_nth(df: DataFrame, keys: list[str], order: list, skip: int, every: int) -> DataFrame:
    """Rows skip, skip + every, ... of each key, counted from 0."""
    d = df.withColumn("_n", F.row_number().over(ordered(keys, order)) - 1)
    return d.where((F.col("_n") >= skip) & ((F.col("_n") - skip) % every == 0)).drop("_n")


def run_rate(df: DataFrame, keys: list[str], order: list, t: str, silence: int, last: int, least: int, unit: int, out: str) -> DataFrame:
    """Rows a unit over the last `last` rows of a run, a run broken by more than `silence`; 0 below `least` rows."""
    w = ordered(keys, order)
    new = (F.col(t) - F.lag(t).over(w) > silence).cast("int")
    d = df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("_run", F.sum("_new").over(w.rowsBetween(*UP_TO)))
    r = ordered([*keys, "_run"], order).rowsBetween(-(last - 1), 0)
    d = d.withColumns({"_n": F.count(F.lit(1)).over(r), "_span": F.col(t) - F.min(t).over(r)})
    rate = F.when((F.col("_n") >= least) & (F.col("_span") > 0), (F.col("_n") - 1) / (F.col("_span") / unit)).otherwise(0.0)
    return d.withColumn(out, rate).drop("_new", "_run", "_n", "_span")


def cut_ids(df: DataFrame, keys: list[str], order: list, thumb: str, limit: float, out: str, bucket: Column) -> DataFrame:
    """Shot numbers: a new shot where the mean absolute change of the thumbnail is above `limit`. Neighbours and counts go over ranges that `bucket` gives."""
    change = F.aggregate(F.zip_with(thumb, "_last", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(thumb)
    d = lagged(df, keys, order, bucket, {thumb: "_last"})
    cut = F.when(F.col("_last").isNotNull() & (change > limit), 1).otherwise(0)
    return running_sum(d, keys, order, bucket, cut, out).drop("_last")


def jitter(df: DataFrame, keys: list[str], order: list, ours: str, reference: str, scale: float, least: int) -> DataFrame:
    """Mean of |scale * change of ours - change of the reference| between neighbours, for keys with at least `least` of them: keys, n, jitter."""
    w = ordered(keys, order)
    d = df.withColumns({"_a": F.col(ours) - F.lag(ours).over(w), "_b": F.col(reference) - F.lag(reference).over(w)})
    d = d.where("_a IS NOT NULL AND _b IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(scale * F.col("_a") - F.col("_b"))), 6).alias("jitter"))
    return d.where(F.col("n") >= least)


def counters(df: DataFrame, keys: list[str], order: list, payload: Column, modulus: int, out: str) -> DataFrame:
    """Continuity counters renumbered, advancing on payload only."""
    n = F.sum(payload.cast("int")).over(ordered(keys, order).rowsBetween(*UP_TO))
    return df.withColumn(out, F.pmod(n - 1, F.lit(modulus)))


def clamped(df: DataFrame, keys: list[str], order: list, t: str, dropped: str, out: str) -> DataFrame:
    """A clock that never runs back: the running maximum, and whether the row's own time ran back."""
    w = ordered(keys, order)
    d = df.withColumn("_max", F.max(t).over(w.rowsBetween(*BEFORE)))
    return d.withColumn(dropped, F.coalesce(F.col(t) < F.col("_max"), F.lit(False))).withColumn(out, F.greatest(F.col(t), F.coalesce("_max", t))).drop("_max")


def unwrapped(df: DataFrame, keys: list[str], order: list, t: str, bits: int, out: str) -> DataFrame:
    """A clock of `bits` bits unwrapped: every step of more than half the range is taken as a wrap, forwards or back."""
    whole, w = 1 << bits, ordered(keys, order)
    d = df.withColumn("_d", F.col(t) - F.lag(t).over(w))
    turn = F.when(F.col("_d") < -(whole // 2), 1).when(F.col("_d") > whole // 2, -1).otherwise(0)
    return d.withColumn(out, F.col(t) + F.sum(turn).over(w.rowsBetween(*UP_TO)) * whole).drop("_d")


def run_lengths(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Run-length table: keys, run (from 0), value, count."""
    w = ordered(keys, order)
    d = df.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)).cast("int"))
    d = d.withColumn("run", F.sum("_new").over(w.rowsBetween(*UP_TO)))
    return d.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("count"))


def valid_prefix(df: DataFrame, keys: list[str], order: list, valid: Column) -> DataFrame:
    """The rows of each key before the first that is not valid."""
    ok = F.min(valid.cast("int")).over(ordered(keys, order).rowsBetween(*UP_TO))
    return df.withColumn("_ok", ok).where("_ok = 1").drop("_ok")


def look_ahead(df: DataFrame, keys: list[str], order: list, value: str, rows: int, out: str) -> DataFrame:
    """The greatest value from a row to `rows` rows after it."""
    return df.withColumn(out, F.max(value).over(ordered(keys, order).rowsBetween(0, rows)))
