"""A corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, mixing.

Each stage works on all that its predecessor kept. The first three drop documents, the fourth masks secrets in place, the last tells
how many words of each document the mix takes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reeltide.llm import decontaminate, mixing, neardup, quality, secrets
from reeltide.llm.common import durable, read, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good(docs, read(spark, sf_dir, "labels"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.deduplicated(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document that is left."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("decontamination", no_leaks),
    ("secrets", no_secrets),
    ("mixing", mixed),
]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`; what stands between them is written as Parquet in the shared folder, and removed once read.

    The last stage's rows, which are narrow, are kept as a checkpoint, so that nothing refers to the folder any more. Nulls, empty and long texts, repeated rows, empty
    tables and further columns are each operator's to define; a stage that keeps nothing hands on an empty table.
    """
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    out = durable(STAGES[-1][1](spark, docs, sf_dir))
    _remove(spark, folder)
    return out


#: No SQL: the classifier, the sketches and the forest cannot be expressed in it; tests hold the stages against brute force.
ORACLE_SQL = None


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
