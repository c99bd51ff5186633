"""Pooled scores over `events` (E03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.operators.pooling import pool
from reeltide.tables import table


def pool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "value")
    return pool(events, ["event_type"], F.col("value"))


QUERIES = {"pool_scores": pool_scores}

ORACLES = {
    "pool_scores": """
        SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean,
               round(count(*) / sum(1 / (value + 1)) - 1, 6) AS harmonic,
               min(value) AS lowest, list_sort(list(value))[count(*) // 100 + 1] AS p1
        FROM events WHERE value IS NOT NULL GROUP BY event_type
    """,
}
