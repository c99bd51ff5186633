"""Runs that can be broken off: a content key, a sink of segments with a manifest, joined parts, watched folders.

The key tells what a result was made from (inputs and settings). Segments are written with the key in their path, and count only once the manifest names their batch; a manifest entry appears at once, by a rename. So a run that
was killed anywhere goes on with the segments that are whole, does no finished one again, and never reads half of one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DONE = "source string, status string"


def content_key(inputs: DataFrame, settings: dict) -> str:
    """A digest of the rows of inputs (any columns, in no order, repeats counted) and of settings: equal exactly if both are, wherever columns keep their names and types.

    Rows are digested where they are and summed up in 256 buckets; the driver sees one digest a bucket.
    """
    columns = sorted(inputs.columns)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    counted = inputs.select(row.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    pair = F.sha2(F.concat_ws(":", "d", "n"), 256)
    lanes = [F.sum(F.conv(F.substring(pair, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(8)]  # sums do not depend on the order
    told = counted.groupBy(F.substring("d", 1, 2).alias("b")).agg(F.count(F.lit(1)).alias("k"), *lanes).orderBy("b").collect()
    return hashlib.sha256(json.dumps([columns, [[str(v) for v in r] for r in told], settings], sort_keys=True, default=str).encode()).hexdigest()


class Segments:
    """Finished segments below a folder of any store of Spark's: rows with a column `segment`, under one content key."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder, key
        self.jvm = spark._jvm
        self.fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _entries(self, key: str) -> list[str]:
        at = self._path(f"{self.folder}/manifest/{key}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at) if not s.getPath().getName().endswith(".tmp")) if self.fs.exists(at) else []

    def rows(self) -> DataFrame | None:
        """All rows of this key's committed batches; None if there is none."""
        parts = [f"{self.folder}/parts/{self.key}/{e}" for e in self._entries(self.key)]
        return self.spark.read.parquet(*parts) if parts else None

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows of segments that are not finished."""
        done = self.rows()
        return rows if done is None else rows.join(done.select("segment").distinct(), "segment", "left_anti")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Writes what is missing of a batch and commits it. The same batch again does nothing; one that was broken off is written over."""
        name = f"{batch:012d}"
        if name in self._entries(self.key):
            return
        self.missing(rows).write.mode("overwrite").parquet(f"{self.folder}/parts/{self.key}/{name}")
        self.fs.mkdirs(self._path(f"{self.folder}/manifest/{self.key}"))
        held = f"{self.folder}/manifest/{self.key}/{name}"
        self.fs.create(self._path(f"{held}.tmp"), True).close()
        if not self.fs.rename(self._path(f"{held}.tmp"), self._path(held)):
            raise OSError(f"{held} cannot be committed")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch."""
        return self.write

    def drop_stale(self) -> list[str]:
        """Deletes what was made under other keys, parts no batch has committed included; the keys."""
        at = self._path(f"{self.folder}/parts")
        stale = [s.getPath().getName() for s in self.fs.listStatus(at) if s.getPath().getName() != self.key] if self.fs.exists(at) else []
        for key in stale:
            for kind in ("manifest", "parts"):
                self.fs.delete(self._path(f"{self.folder}/{kind}/{key}"), True)
        return sorted(stale)


def joined(parts: DataFrame, keys: list[str], segment: str, order: list[str], header: Column, out: str = "place") -> DataFrame:
    """The rows of segments one after the other as one stream with their place: headers of all segments but the first of their key are left out."""
    first = parts.groupBy(*keys).agg(F.min(segment).alias("_first"))
    kept = parts.join(first, keys).where((F.col(segment) == F.col("_first")) | ~header).drop("_first")
    sizes = kept.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, segment).orderBy(*order)) - 1
    return kept.withColumn("_i", inside).join(before, [*keys, segment]).withColumn(out, F.col("_before") + F.col("_i")).drop("_i", "_before")


def round_of(sources: DataFrame, done_path: str, work: Callable[[DataFrame], DataFrame], retry: bool = False) -> DataFrame:
    """One round over settled sources (rows with a column `source`) that are not done, all as one job: work(sources) gives rows of source and error, null where it went well; they are appended to the done table at once and returned as source, status.

    As the rule has it, failed sources count as done too, unless `retry` is asked for. A source that work gives no row for is not done.
    """
    spark = sources.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(done_path)
    known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    done = spark.read.schema(DONE).parquet(done_path) if known else spark.createDataFrame([], DONE)
    seen = done.where("status = 'ok'") if retry else done
    now = work(sources.join(seen.select("source").distinct(), "source", "left_anti"))
    status = F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.concat(F.lit("failed: "), "error"))
    name = spark.sparkContext.applicationId + hashlib.md5(str(spark.range(1).select(F.uuid()).first()[0]).encode(), usedforsecurity=False).hexdigest()
    told = now.groupBy("source").agg(F.max("error").alias("error")).select("source", status.alias("status"), F.lit(name).alias("round"))
    told.write.mode("append").partitionBy("round").parquet(done_path)
    return spark.read.schema(DONE).parquet(f"{done_path}/round={name}") if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{done_path}/round={name}")) else spark.createDataFrame([], DONE)
