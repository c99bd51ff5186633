"""Time-keyed lookups: as-of, nearest, interval, range counts.

All of them are equi joins or windows on (key, bucket of time), so a key with very many rows is spread over its buckets,
and no join compares all rows of a key. Times are integers (ticks, nanoseconds, microseconds).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], t: str, carry: dict[str, str], width: int) -> DataFrame:
    """left with, of the last right row at or before its time, the columns `carry` (right name -> name in the result); null where none is.

    Both sides have `keys` and `t`; of right rows of one time the greatest `carry` wins. Two levels: the last right row within (keys, t div width), else the
    last of an earlier bucket, found over one row a bucket. Only one shuffle of the rows, on (keys, bucket).
    """
    r = right.select(*keys, t, F.struct(*[F.col(c).alias(n) for c, n in carry.items()]).alias("_r"))
    bucket = F.floor(F.col(t) / width).alias("_b")
    both = left.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withColumn("_side", F.lit(1))
    both = both.unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True).withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(t, "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    ends = r.withColumn("_b", bucket).groupBy(*keys, "_b").agg(F.max_by("_r", F.struct(t, "_r")).alias("_end"))
    steps = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    asked = left.select(*keys, bucket).distinct().withColumn("_end", F.lit(None).cast(r.schema["_r"].dataType))
    before = asked.unionByName(ends).groupBy(*keys, "_b").agg(F.max("_end").alias("_end")).withColumn("_before", F.last("_end", ignorenulls=True).over(steps))
    found = F.coalesce(F.col("_near"), F.col("_before"))
    before = before.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "_b"])], "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, "_b"])])
    out = near.join(before, same, "left").withColumn("_f", found)
    return out.select(*left.columns, *[F.col(f"_f.{n}").alias(n) for n in carry.values()])


def offset_at(left: DataFrame, groups: DataFrame, keys: list[str], t: str, offsets: str, frame: int, width: int, out: str) -> DataFrame:
    """left with the offset in force at its time: of the last group at or before it the element of `offsets` by how many whole frames have passed since, the last one once the group has run out; null before the first group, and for a group without offsets."""
    found = as_of(left, groups.withColumn("_from", F.col(t)), keys, t, {"_from": "_from", offsets: "_offsets"}, width)
    place = F.least(F.floor((F.col(t) - F.col("_from")) / frame), F.size("_offsets") - 1).cast("int")
    return found.withColumn(out, F.get("_offsets", place)).drop("_from", "_offsets")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, tolerance: int, carry: dict[str, str]) -> DataFrame:
    """left with the columns of the right row nearest in time, at most `tolerance` away, the earlier one on a tie; null where none is.

    Right rows go to their bucket of width `tolerance` and the two beside it, so every match is an equi join on (keys, bucket). Nulls in any column of left are
    kept; null keys or times match nothing. left must not repeat a whole row.
    """
    width = max(1, tolerance)
    b = F.floor(F.col(t) / width)
    r = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.col(t).alias("_rt"), F.struct(*[F.col(c).alias(n) for c, n in carry.items()]).alias("_r"), F.explode(F.array(b - 1, b, b + 1)).alias("_rb"))
    l = left.withColumn("_b", b)
    away = F.abs(F.col("_rt") - F.col(t))
    met = l.join(r, _equal(keys, "_r") & (F.col("_b") == F.col("_rb")) & (away <= tolerance), "left")
    best = met.groupBy(*keys, "_b", *[c for c in left.columns if c not in keys]).agg(F.min_by("_r", F.when(F.col("_rt").isNotNull(), F.struct(away, "_rt", "_r"))).alias("_f"))
    return best.select(*left.columns, *[F.col(f"_f.{n}").alias(n) for n in carry.values()])


def _equal(keys: list[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{other}{i}") for i, k in enumerate(keys)])


def interval_last(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, line: str, width: int) -> DataFrame:
    """points with the greatest `line` of the spans [start, end) that contain them; end 0 is open; null where none does.

    Closed spans are joined on buckets of time of a width that suits their length: `width`, or 4, 16, ... times that, so a span is in two buckets or so however
    long it is, and a point in one bucket of each width in use. Open ones need no join, as the greatest line that has begun is a running maximum. Nulls in any
    column of points are kept. points must not repeat a whole row.
    """
    closed = spans.where((F.col(end) != 0) & (F.col(end) > F.col(start)))
    level = F.greatest(F.lit(0), F.ceil(F.log(4.0, (F.col(end) - F.col(start)) / width))).cast("int")
    closed = closed.withColumn("_l", level)
    levels = sorted(r["_l"] for r in closed.select("_l").distinct().collect())  # at most 32
    wide = lambda c: F.lit(width) * F.pow(F.lit(4), c).cast("long")
    own = [F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)]
    touched = F.sequence(F.floor(F.col(start) / wide(F.col("_l"))), F.floor((F.col(end) - 1) / wide(F.col("_l"))))
    s = closed.select(*own, F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(line).alias("_line"), F.col("_l").alias("_sl"), F.explode(touched).alias("_sb"))
    p = points.withColumn("_l", F.explode(F.array(*[F.lit(x) for x in levels or [0]])))
    p = p.withColumn("_b", F.floor(F.col(t) / wide(F.col("_l"))))
    inside = (F.col(t) >= F.col("_start")) & (F.col(t) < F.col("_end"))
    met = p.join(s, _equal(keys, "_s") & (F.col("_l") == F.col("_sl")) & (F.col("_b") == F.col("_sb")) & inside, "left")
    best = met.groupBy(*points.columns).agg(F.max("_line").alias("_closed"))
    opened = spans.where(F.col(end) == 0).groupBy(*keys, F.col(start).alias(t)).agg(F.max(line).alias(line))
    steps = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    opened = opened.select(*keys, t, F.max(line).over(steps).alias(line))
    with_open = as_of(best, opened, keys, t, {line: "_open"}, width * 64)
    return with_open.select(*points.columns, F.greatest("_open", "_closed").alias(line))


def counts_between(marks: DataFrame, rows: DataFrame, keys: list[str], t: str, mark: str, width: int) -> DataFrame:
    """marks with `n`: how many rows lie at or after each and before the next one of its key. Rows are assigned by as-of, so no range join is needed."""
    found = as_of(rows.select(*keys, t), marks.select(*keys, t, mark), keys, t, {mark: "_m"}, width)
    n = found.where("_m IS NOT NULL").groupBy(*keys, F.col("_m").alias(mark)).agg(F.count(F.lit(1)).alias("n"))
    return marks.join(n, [*keys, mark], "left").withColumn("n", F.coalesce("n", F.lit(0)))
