"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Keys order the documents of a source; ranges of keys are buckets, whose
totals are summed up per source (a distributed prefix sum), and the documents before a source's budget are taken,
the one that straddles it in part. A budget above a source's size first takes whole epochs of it.

Scale: the text is read once, for its size; afterwards rows are narrow. Buckets are equal ranges of a uniform hash,
about sqrt(rows) of them, so a source with a third of all rows is spread over as many tasks as any other. Only the
list of sources (one row each, so a column of tens or thousands of values, not of hosts) meets in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reeltide.llm.common import durable, read, root_buckets

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """(skey, source_size) -> with target: `share` of all sizes dealt by weight, none above cap * source_size.

    Sources take the weights in turn, in the order of skey. The excess of capped sources is dealt again by weight until none is
    above; that level is found in closed form from running sums over the sources ordered by cap / weight.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("place", F.row_number().over(Window.orderBy("ratio", "skey")))
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)["level"]
    return s.withColumn("target", F.least(F.col("most"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("skey", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """How many words of each document a mix takes: doc_id, source, size, source_size, target, taken.

    A size is the number of runs without ASCII white space; null and empty texts have 0 and take 0. Documents of a null source form
    a source of their own, after all others. Rows with the same doc_id are separate rows, ordered by their text's hash too, so the rows of
    the result are the same in every run and a repeated or null id is spread as other rows are. An empty table gives an empty result. Columns other than doc_id, text and source are not read.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    sized = durable(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("skey"),
            key.alias("key"),
        )
    )
    n = root_buckets(sized.count())
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n / F.lit(2**32)).cast("int"))

    totals = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    sizes = totals.groupBy("skey").agg(F.sum("words").alias("source_size"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    starts = starts.join(source_targets(sizes, weights, share, cap), "skey")
    starts = starts.withColumn("budget", F.floor("target"))
    starts = starts.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
    starts = starts.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))

    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(starts, ["skey", "bucket"]).withColumn("begin", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.least(F.greatest(F.col("rest") - F.col("begin"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).drop("source")


#: DuckDB SQL over a relation `docs` (doc_id, text, source), for the query above and the last stage of the pipeline.
MIX_SQL = r"""
    sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
        FROM docs),
    sizes AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
    weighed AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY skey) - 1) % 3 + 1) AS weight, (source_size * 2)::DOUBLE AS most FROM sizes),
    placed AS (SELECT *, most / weight AS ratio, row_number() OVER (ORDER BY most / weight, skey) AS place FROM weighed),
    levelled AS (
        SELECT *, ((SELECT sum(source_size) FROM sizes)::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0)) / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0)) AS level
        FROM placed WINDOW w AS (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (
        SELECT skey, source_size, least(most, coalesce((SELECT arg_min(level, place) FROM levelled WHERE level <= ratio), 'inf'::DOUBLE) * weight) AS target FROM levelled),
    budgets AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
    begun AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM sized),
    mixed AS (
        SELECT doc_id, source, size, source_size, target, (epochs * size + least(greatest(budget - epochs * source_size - begin, 0), size))::BIGINT AS taken
        FROM begun JOIN budgets USING (skey))
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": "WITH docs AS (SELECT doc_id, text, source FROM documents)," + MIX_SQL + "SELECT doc_id, size, source_size, target, taken FROM mixed"}
