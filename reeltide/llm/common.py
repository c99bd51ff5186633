"""What the operators of this subpackage share: tables, durable cuts, chains, range buckets."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table of so many narrow rows (a few numbers and short strings) may be broadcast: under 100 MB.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint directory, from spark.checkpoint.dir. Where that is unset and all run on one machine, a temporary one is set; on a cluster
    that is an error. Spark removes checkpoints that nothing refers to any more if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="reeltide-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder of spark.checkpoint.dir, without lineage; the shuffles that made it are removed at once."""
    spark = df.sparkSession
    shared_dir(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan reads the setting when it is made
    finally:
        spark.conf.set(name, before)


def durable_in_loop(df: DataFrame) -> DataFrame:
    """durable(), for tables that are made from one another round after round.

    A checkpointed table keeps its plan's estimated size, and a join's estimate is the product of its sides', so in a loop of joins the number's digits
    double in every round until they fill the driver's memory. Made anew from its rows, the table has no estimate.
    """
    spark = df.sparkSession
    kept = durable(df)
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)


def release(spark: SparkSession) -> None:
    """Asks for what no plan refers to any more, such as shuffles behind a durable cut, to be cleaned from the executors' disks now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def look_up(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Left join to a table with one row a key: broadcast up to BROADCAST_ROWS rows, else shuffled, where AQE splits hot keys."""
    held = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(small) if held else small, on, "left")


def strength(groups: DataFrame, rate: Column) -> float:
    """The prior strength of groups (n, bad) about `rate`, by moments: 1 / rho - 1 with the intraclass correlation rho kept in 0.02 to 0.9."""
    sums = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") * (F.col("bad") / F.col("n") - rate) ** 2).alias("v"), F.sum(F.col("n") * rate * (1 - rate)).alias("u")).first()
    if not sums["n"] or not sums["u"] or sums["n"] == sums["g"]:
        return 2.0
    share = sums["g"] / sums["n"]
    rho = (sums["v"] / sums["u"] - share) / (1 - share)
    return 1 / min(0.9, max(0.02, rho)) - 1


def root_buckets(n: int) -> int:
    """How many parts n rows are cut into so that neither a part nor the list of parts grows beyond about sqrt(n)."""
    return max(1, int(n**0.5))


def neighbours(df: DataFrame, keys: list[str], order: list[str], carry: list[str], salts: int, salt_of: Column, reach: int = 1) -> DataFrame:
    """Pairs of rows at most `reach` places apart within `keys`: every group becomes connected, and a row is in at most 4 * reach pairs.

    A group is chained in two levels, so that a hot key never meets in one task: first within (keys, salt),
    then the first rows of its salts. Rows come as x_<column> and y_<column> for `carry`, ordered by `order`.
    """
    cols = list(dict.fromkeys([*order, *carry]))
    base = df.select(*keys, *cols, (F.pmod(salt_of, F.lit(salts))).alias("_salt"))

    def chain(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        lags = F.array(*[F.lag(F.struct(*carry), k).over(w) for k in range(1, reach + 1)])
        return rows.withColumn("_x", F.filter(lags, lambda x: x.isNotNull()))

    def pairs(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_x", F.explode("_x"))
        return rows.select(*keys, *[F.col(f"_x.{c}").alias(f"x_{c}") for c in carry], *[F.col(c).alias(f"y_{c}") for c in carry])

    first = chain(base, [*keys, "_salt"])
    heads = chain(first.where("size(_x) = 0").drop("_x"), keys)
    return pairs(first).unionByName(pairs(heads))
