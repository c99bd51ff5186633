"""Pooled summaries of per-picture measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reeltide.operators.measures import element_at_rank


def pool(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Mean, harmonic mean of (x+1) less 1, minimum and the element at n div 100 of the sorted values.

    The low element is an element, not an interpolated percentile; it is found between approximate bounds, so neither a group's values nor its running counts
    meet in one task. Nulls are left out; a group of nulls only gives no row.
    """
    v = df.select(*keys, value.alias("_v")).where(F.col("_v").isNotNull())
    means = v.groupBy(*keys).agg(
        F.round(F.avg("_v"), 6).alias("mean"),
        F.round(F.count(F.lit(1)) / F.sum(1 / (F.col("_v") + 1)) - 1, 6).alias("harmonic"),
        F.min("_v").alias("lowest"),
    )
    low = element_at_rank(v, keys, "_v", F.floor(F.col("n") / 100), "p1", near=0.01)
    low = low.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "p1")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return means.join(low, same).select(*keys, "n", "mean", "harmonic", "lowest", "p1")
