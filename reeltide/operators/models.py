"""Models kept as JSON, scored with column functions: tree ensembles walked level by level, kernel machines as array products.

A model is a table of one row that is read with from_json; its size is checked before it is broadcast to the rows that it scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of JSON of a model that may be broadcast.
MOST = 16_000_000
TREES = "base double, trees array<array<struct<feature: int, threshold: double, left: int, right: int, nan_left: boolean, value: double>>>"
KERNEL = "gamma double, rho double, slope array<double>, intercept array<double>, out_slope double, out_intercept double, vectors array<struct<weight: double, x: array<double>>>"


def model(spark: SparkSession, json: str, schema: str) -> DataFrame:
    """The model as one row with the column `model`; fails on text that is not such a model, or too large."""
    if len(json) > MOST:
        raise ValueError(f"a model of {len(json)} characters is not broadcast; the most is {MOST}")
    rows = spark.createDataFrame([(json,)], "json string")
    return rows.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("model"))


def depth(tree: list[dict]) -> int:
    """The most steps from the root (node 0) to a leaf, which has no left child; fails on a tree that goes round."""
    deep, now = 0, [0]
    while now := [tree[i][side] for i in now for side in ("left", "right") if tree[i]["left"] is not None and tree[i]["left"] >= 0]:
        deep += 1
        if deep > len(tree):
            raise ValueError("a tree that goes round")
    return deep


def tree_score(rows: DataFrame, trees: DataFrame, features: Column, out: str) -> DataFrame:
    """rows with the probability 1 / (1 + exp(-(base + the sum of the leaves' values))).

    Nodes have a feature (counted from 0), a threshold (below it is left), and the side of a missing value: null and NaN features go where `nan_left` says. All trees step together, one level a step, as many steps as the deepest tree has levels.
    """
    held = trees.first()["model"]
    steps = max((depth([n.asDict() for n in t]) for t in held["trees"]), default=0)
    both = rows.join(F.broadcast(trees.select(F.col("model.base").alias("_base"), F.col("model.trees").alias("_trees"))))  # one row
    both = both.withColumn("_x", features)

    def step(tree: Column, at: Column) -> Column:
        node = F.get(tree, at)
        x = F.get("_x", node["feature"])
        left = F.when(x.isNull() | F.isnan(x), node["nan_left"]).otherwise(x < node["threshold"])
        return F.when(node["left"].isNull() | (node["left"] < 0), at).when(left, node["left"]).otherwise(node["right"])

    places = F.transform("_trees", lambda _: F.lit(0))
    for _ in range(steps):
        both = both.withColumn("_at", places)
        both = both.withColumn("_at", F.zip_with("_trees", "_at", step))
        places = F.col("_at")
    leaves = F.zip_with("_trees", places, lambda t, i: F.get(t, i)["value"])
    total = F.aggregate(leaves, F.col("_base"), lambda s, v: s + v)
    return both.withColumn(out, 1 / (1 + F.exp(-total))).select(*rows.columns, out)


def kernel_score(rows: DataFrame, machine: DataFrame, features: Column, out: str, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """rows with the score of a Gaussian kernel machine: features are scaled, the weighted kernels summed less rho, the sum scaled back and kept within bounds; null where a feature is."""
    both = rows.join(F.broadcast(machine.select("model"))).withColumn("_f", features)  # one row
    both = both.withColumn("_x", F.zip_with(F.zip_with("_f", "model.slope", lambda v, s: v * s), "model.intercept", lambda v, i: v + i))
    square = lambda v: F.aggregate(F.zip_with(v["x"], F.col("_x"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    total = F.aggregate(F.transform("model.vectors", lambda v: v["weight"] * F.exp(-F.col("model.gamma") * square(v))), -F.col("model.rho"), lambda s, v: s + v)
    score = (total - F.col("model.out_intercept")) / F.col("model.out_slope")
    whole = ~F.exists("_f", lambda v: v.isNull())
    return both.withColumn(out, F.when(whole, F.greatest(F.lit(low), F.least(F.lit(high), score)))).select(*rows.columns, out)
