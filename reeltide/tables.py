"""Reading the driver's tables; every query takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`, lazily, with Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
