"""Pairing and merging of time-keyed streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reeltide.operators.ranges import running_sum


def paired(base: DataFrame, dependent: DataFrame, on: list[str], order: list[str], carry: dict[str, str]) -> DataFrame:
    """Every base row with the dependent row of equal keys, the first in `order` if there are several; null where none is."""
    one = dependent.groupBy(*on).agg(F.min(F.struct(*order, *[F.col(c).alias(n) for c, n in carry.items()])).alias("_d"))
    return base.join(one, on, "left").select(*base.columns, *[F.col(f"_d.{n}").alias(n) for n in carry.values()])


def paired_bounded(base: DataFrame, dependent: DataFrame, keys: list[str], t: str, seq: str, ident: str, bound: int, bucket: int, out: str = "dependent") -> DataFrame:
    """base with the dependent row of its key and time, as a reader finds it that waits for at most `bound` rows: null if the dependent comes after `bound` or more later base rows, or came before `bound` or more later dependents.

    Both sides arrive in the order of `seq`, an integer of its own in both. Of several dependents of a time the reader takes the first that it still holds, or the first to come; of those that it does not hold none. Arrivals are counted in two levels, over ranges of `bucket`.
    """
    both = base.select(*keys, F.col(t).alias("_t"), F.col(seq).alias("_s"), F.col(ident).alias("_i"), F.lit(0).alias("_kind"))
    both = both.unionByName(dependent.select(*keys, F.col(t).alias("_t"), F.col(seq).alias("_s"), F.col(ident).alias("_i"), F.lit(1).alias("_kind")))
    at = F.floor(F.col("_s") / bucket)
    counted = running_sum(running_sum(both, keys, ["_s"], at, F.lit(1) - F.col("_kind"), "_bases"), keys, ["_s"], at, F.col("_kind"), "_deps")
    b = counted.where("_kind = 0").select(*keys, "_t", F.col("_s").alias("_bs"), F.col("_i").alias(ident), F.col("_bases").alias("_bn"), F.col("_deps").alias("_bd"))
    d = counted.where("_kind = 1").select(*keys, "_t", F.col("_s").alias("_ds"), F.col("_i").alias(out), F.col("_bases").alias("_db"), F.col("_deps").alias("_dn"))
    held = (F.col("_ds") < F.col("_bs")) & (F.col("_bd") - F.col("_dn") < bound)
    later = (F.col("_ds") > F.col("_bs")) & (F.col("_db") - F.col("_bn") < bound)
    met = b.join(d, [*keys, "_t"], "left").withColumn("_ok", F.when(held | later, F.struct("_ds", out)))
    one = met.groupBy(*keys, "_bs", ident).agg(F.min("_ok").alias("_f"))
    return one.select(*keys, ident, F.col(f"_f.{out}").alias(out))


def zipped(a: DataFrame, b: DataFrame, keys: list[str], order_a: list, order_b: list, skip: int = 0) -> DataFrame:
    """Rows of a and b of the same place within their key, b counted from `skip`; it ends with the shorter."""
    n = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return a.withColumn("place", n(order_a)).join(b.withColumn("place", n(order_b) - skip).where("place >= 0"), [*keys, "place"])


def zipped_checked(a: DataFrame, b: DataFrame, keys: list[str], order_a: list, order_b: list, index_a: str, index_b: str) -> DataFrame:
    """zipped(), of layers whose display indexes must agree: the first pair that does not fails the query and says where."""
    said = F.concat(F.lit("place "), F.col("place"), F.lit(": indexes "), F.coalesce(F.col(index_a).cast("string"), F.lit("null")), F.lit(" and "), F.coalesce(F.col(index_b).cast("string"), F.lit("null")))
    pairs = zipped(a, b, keys, order_a, order_b)
    return pairs.withColumn(index_a, F.when(F.col(index_a).eqNullSafe(F.col(index_b)), F.col(index_a)).otherwise(F.raise_error(said)))


def merged(sources: list[DataFrame], keys: list[str], t: str, order: list[str], out: str) -> DataFrame:
    """All rows in the order of their times, the earlier source first on a tie: `source` and the place `out` within the key."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("source", F.lit(i))
        rows = s if rows is None else rows.unionByName(s)
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(t, "source", *order)))


def missing(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a without a match in b."""
    return a.join(b.select(*on).distinct(), on, "left_anti")


def first_wins(sources: list[DataFrame], on: list[str]) -> DataFrame:
    """One row a key of all sources, that of the earliest source that has it."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("source", F.lit(i))
        rows = s if rows is None else rows.unionByName(s)
    rest = [c for c in rows.columns if c not in on]
    top = rows.groupBy(*on).agg(F.min(F.struct("source", *[c for c in rest if c != "source"])).alias("_s"))
    return top.select(*on, *[F.col(f"_s.{c}").alias(c) for c in rest])


def window_keep(t: Column, start: Column, stop: Column) -> Column:
    """Whether a time is in the half-open window."""
    return (t >= start) & (t < stop)
