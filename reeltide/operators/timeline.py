"""Playlists: play times, trims, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reeltide.operators.sequence import BEFORE, ordered


def durations(items: DataFrame, keys: list[str], clip: list[str], length: Column) -> DataFrame:
    """keys, duration, unique_duration: the latter counts each distinct stretch of a clip once. Lengths below 0 count as 0."""
    each = items.groupBy(*keys, *clip).agg(F.count(F.lit(1)).alias("_n"), F.max(F.greatest(length, F.lit(0.0))).alias("_l"))
    return each.groupBy(*keys).agg(F.sum(F.col("_l") * F.col("_n")).alias("duration"), F.sum("_l").alias("unique_duration"))


def trimmed(items: DataFrame, keys: list[str], order: list, length: str, start: int, end: int | None) -> DataFrame:
    """items with `low`, `high` (what is left of each, from its own start) and `offset` (where it then starts); items outside are empty."""
    w = ordered(keys, order).rowsBetween(*BEFORE)
    d = items.withColumn("_at", F.coalesce(F.sum(length).over(w), F.lit(0)))
    low = F.greatest(F.lit(start) - F.col("_at"), F.lit(0))
    high = F.least(F.lit(end) - F.col("_at"), F.col(length)) if end is not None else F.col(length)
    d = d.withColumns({"_low": low, "_high": high})
    some = F.col("_high") > F.col("_low")
    d = d.withColumns({"low": F.when(some, F.col("_low")).otherwise(0), "high": F.when(some, F.col("_high")).otherwise(0)})
    return d.withColumn("offset", F.coalesce(F.sum(F.col("high") - F.col("low")).over(w), F.lit(0))).drop("_at", "_low", "_high")


def chapters(items: DataFrame, marks: DataFrame, keys: list[str], item: str, length: str, t: str) -> DataFrame:
    """Marks at the start of their item on the playlist plus their time inside it; marks before their item or of no item go."""
    w = ordered(keys, [item]).rowsBetween(*BEFORE)
    starts = items.select(*keys, item, F.coalesce(F.sum(length).over(w), F.lit(0)).alias("_start"))
    return marks.where(F.col(t) >= 0).join(starts, [*keys, item]).withColumn("at", F.col("_start") + F.col(t)).drop("_start")


def trimmed_chapters(marks: DataFrame, keys: list[str], t: str, order: list[str], start: int, end: int | None) -> DataFrame:
    """Chapters on the trimmed timeline: the one that holds the start begins at 0, those wholly before it and those at or after the end go."""
    following = F.lead(t).over(Window.partitionBy(*keys).orderBy(t, *order))
    d = marks.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") > start))
    if end is not None:
        d = d.where(F.col(t) < end)
    return d.withColumn("at", F.greatest(F.col(t) - start, F.lit(0))).drop("_next")
