"""Order over a key that is too large for one task: numbers, running sums and neighbours in two levels.

`bucket` is a column that never falls along the order (a range of time, of bytes, of a value). Rows are ordered within (keys, bucket) only, by one shuffle; what the buckets before hold is a window
over one row a bucket. So a key with a third of all rows is spread over its buckets, and no window is partitioned by the key alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _back(rows: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of ends, which has one row a bucket; null keys are a key."""
    other = ends.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(by)], *[c for c in ends.columns if c not in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(by)])
    return rows.join(other, same, "left").drop(*[f"_o{i}" for i in range(len(by))])


def running_sum(df: DataFrame, keys: list[str], order: list, bucket: Column, value: Column, out: str) -> DataFrame:
    """df with the sum of `value` from the first row of the key to this one; nulls count 0."""
    by = [*keys, "_bucket"]
    rows = df.withColumns({"_bucket": bucket, "_value": F.coalesce(value, F.lit(0))})
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by).agg(F.sum("_value").alias("_all")).select(*by, F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    summed = _back(rows.withColumn("_inside", F.sum("_value").over(inside)), ends, by)
    return summed.withColumn(out, F.col("_before") + F.col("_inside")).drop("_bucket", "_value", "_inside", "_before")


def numbered(df: DataFrame, keys: list[str], order: list, bucket: Column, out: str) -> DataFrame:
    """df with each row's place in its key, from 0."""
    return running_sum(df, keys, order, bucket, F.lit(1), out).withColumn(out, F.col(out) - 1)


def lagged(df: DataFrame, keys: list[str], order: list, bucket: Column, columns: dict[str, str]) -> DataFrame:
    """df with columns of the row before it in its key (name -> name in the result); null for the first row."""
    by = [*keys, "_bucket"]
    rows = df.withColumns({"_bucket": bucket, "_own": F.struct(*[F.col(c).alias(n) for c, n in columns.items()])})
    inside = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumns({"_prev": F.lag("_own").over(inside), "_last": F.row_number().over(inside)})
    before = Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_first())
    ends = rows.groupBy(*by).agg(F.max_by("_own", "_last").alias("_end")).select(*by, F.lag("_end").over(before).alias("_before"))
    found = _back(rows, ends, by).withColumn("_p", F.when(F.col("_last") == 1, F.col("_before")).otherwise(F.col("_prev")))
    return found.select(*df.columns, *[F.col(f"_p.{n}").alias(n) for n in columns.values()])
