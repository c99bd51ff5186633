"""The setting that meets a size: log-linear steps through measured points, a bounded number of them, for all groups at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The greatest setting, half the distance of the first two points, how near to an answer a point counts as measured, and what is allowed before the answer is rounded up.
MOST, APART, NEAR, SLACK = 51, 6, 1.5, 0.05
#: Settings that halve a size, where the points do not fall.
HALVES = 6.0


def _solved(points: Column, target: Column) -> Column:
    """Where the line through two of the points (setting, log size; sorted) meets log target: the first two that enclose it, beyond the last point the last two, else the first two."""
    n = F.size(points)
    log = F.log(target)
    at = lambda i: F.element_at(points, i)
    encloses = F.filter(F.sequence(F.lit(1), n - 1), lambda i: (at(i)["size"] >= log) & (at(i + 1)["size"] <= log))
    i = F.when(at(n)["size"] > log, n - 1).otherwise(F.coalesce(F.try_element_at(encloses, F.lit(1)), F.lit(1)))
    slope = (at(i + 1)["size"] - at(i)["size"]) / (at(i + 1)["setting"] - at(i)["setting"])
    slope = F.when(slope < 0, slope).otherwise(F.lit(-1.0) * F.log(F.lit(2.0)) / HALVES)
    return at(i)["setting"] + (log - at(i)["size"]) / slope


def setting_for_size(measured: DataFrame, keys: list[str], setting: str, size: str, target: Column, start: Column, most: int = MOST, refinements: int = 2) -> DataFrame:
    """keys, target, points (settings looked at), chosen: per group the least whole setting whose size is at most the target, as far as the points tell.

    `measured` has the size of every setting 0 to `most` of a group, one row each; the rule looks at two, APART on either side of `start`, and then at no more than `refinements`, each where the line says, if no point is near. `target` and `start` are aggregates
    over a group's rows. A size that is null or not above 0, or missing, ends the search of its group with what is known. A group holds at most `most` + 1 points, so it is one row from then on and nothing is joined.
    """
    kept = measured.where((F.col(size) > 0) & F.col(setting).between(0, most))
    by = kept.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(setting).cast("int"), F.log(F.col(size).cast("double"))))).alias("_m"), target.cast("double").alias("target"), start.cast("int").alias("_start"))
    point = lambda c: F.struct(c.cast("int").alias("setting"), F.try_element_at(F.col("_m"), c.cast("int")).alias("size"))
    first = F.array(point(F.greatest(F.col("_start") - APART, F.lit(0))), point(F.least(F.col("_start") + APART, F.lit(most))))
    rows = by.withColumn("_p", F.sort_array(F.array_distinct(F.filter(first, lambda p: p["size"].isNotNull())))).where((F.size("_p") > 1) & (F.col("target") > 0))
    rows = rows.withColumn("_s", _solved(F.col("_p"), F.col("target")))
    for _ in range(refinements):
        there = F.least(F.greatest(F.round("_s"), F.lit(0)), F.lit(most))
        near = F.exists("_p", lambda p: F.abs(p["setting"] - F.col("_s")) < NEAR)
        more = F.when(near, F.array().cast("array<struct<setting:int,size:double>>")).otherwise(F.filter(F.array(point(there)), lambda p: p["size"].isNotNull()))
        rows = rows.withColumn("_p", F.sort_array(F.array_distinct(F.concat("_p", more)))).withColumn("_s", _solved(F.col("_p"), F.col("target")))
    chosen = F.least(F.greatest(F.ceil(F.col("_s") - SLACK), F.lit(0)), F.lit(most)).cast("int")
    return rows.select(*keys, "target", F.transform("_p", lambda p: p["setting"]).alias("points"), chosen.alias("chosen"))
