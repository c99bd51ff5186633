"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reeltide.llm.common import durable_in_loop


def _hop(rows: DataFrame, up: DataFrame, column: str = "root") -> DataFrame:
    """rows with `column` replaced by its root in `up`, where it has one."""
    above = up.select(F.col("node").alias(column), F.col("root").alias("_next"))
    return rows.join(above, column, "left").withColumn(column, F.coalesce("_next", column)).drop("_next")


def follow(labels: DataFrame, up: DataFrame) -> DataFrame:
    """labels (node, root) carried on by `up`, whose nodes are roots of labels or new."""
    return durable_in_loop(_hop(labels, up).select("node", "root").unionByName(up))


def flattened(up: DataFrame) -> DataFrame:
    """A forest (node, root), every node's root less than it or none, with each node's last root, by pointer jumping."""
    while True:
        twice = _hop(_hop(up.withColumn("_was", F.col("root")), up), up)
        up = durable_in_loop(twice.select("node", "root", (F.col("root") != F.col("_was")).alias("_moved")))
        still = up.where("_moved").isEmpty()
        up = up.select("node", "root")
        if still:
            return up


def components(links: DataFrame) -> DataFrame:
    """(x, y) -> (node, root) for every node that is not the least of its component.

    Every node hooks to its least neighbour if that is less than itself; the forest is flattened by pointer jumping, links are put between its roots, and
    this goes on until none is left: a number of rounds like the logarithm of the longest chain. Sums are combined before they are shuffled, and the joins
    are left joins to one row a node, whose hot keys AQE splits.
    """
    ends = lambda d: durable_in_loop(d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    e, labels = ends(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = flattened(durable_in_loop(both.groupBy("a").agg(F.min("b").alias("p")).where("p < a").select(F.col("a").alias("node"), F.col("p").alias("root"))))
        labels = up if labels is None else follow(labels, up)
        e = ends(_hop(_hop(e, up, "a"), up, "b"))
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
