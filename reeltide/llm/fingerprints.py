"""Document fingerprints by winnowing.

Letters and digits are folded to lower case, all else is left out; every K of them in a row get a rolling hash; of every W hashes in a
row the least is kept, the rightmost on a tie. So two texts that share K + W - 1 folded characters in a row share a kept hash, and the kept
positions (of code points in the text) say where.

Scale: a document and the one after it meet by a range of doc_id. Ranges are cut at approximate quantiles (a bounded list), each is
sorted and streamed with two texts in memory, and the first document of a range is also sent to the range before. Every text is shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.llm.common import read
from reeltide.llm.kernels import codepoints, fold_table, mixed, powers

#: Both powers of two, so that hashes and minima come by doubling.
K, W = 16, 32


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hash uint32, position uint32) of the kept k-grams, in order. A text of fewer than k folded characters is one gram; an empty one has none."""
    cp = codepoints(text)
    f = fold_table()[cp]
    at = np.flatnonzero(f)
    if not at.size:
        f, at = cp, np.arange(cp.size)
    if not at.size:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    h = f[at].astype(np.uint64) + np.uint64(1)
    step, base = 1, np.full(1, 0x9E3779B97F4A7C15, np.uint64)  # an array: its products may wrap round
    if h.size < k:
        h = np.add.reduce(h * powers(h.size), keepdims=True)
    else:
        while step < k:
            h = h[:-step] * base + h[step:]
            base, step = base * base, 2 * step
    high = mixed(h) & np.uint64(0xFFFFFFFF00000000)
    least = high | (np.uint64(0xFFFFFFFF) - np.arange(h.size, dtype=np.uint64))  # the rightmost of equal hashes is least
    step, full = 1, min(w, h.size)
    while 2 * step <= full:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    if step < full:
        least = np.minimum(least[: least.size - (full - step)], least[full - step :])
    least = least[np.r_[True, least[1:] != least[:-1]]]
    gram = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return (least >> np.uint64(32)).astype(np.uint32), at[gram].astype(np.uint32)


def packed(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Hashes, then positions, as little-endian 32-bit numbers in base 64."""
    return base64.b64encode(found[0].astype("<u4").tobytes() + found[1].astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of hashes (sorted, unique); 1 for two empty ones."""
    if not a.size and not b.size:
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both)


def range_of(col: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or below the column, by a two-level search; 0 for null."""
    if not cuts:
        return F.lit(0)
    g = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + g] for i in range(0, len(cuts), g)]
    below = lambda cs: F.size(F.filter(cs, lambda c: c <= col))
    top = below(F.array(*[F.lit(p[0]) for p in parts]))
    inner = below(F.element_at(F.array(*[F.array(*[F.lit(c) for c in p]) for p in parts]), F.greatest(top, F.lit(1))))
    return F.when(col.isNull() | (top == 0), 0).otherwise((top - 1) * g + inner)


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, extra, doc_id, text), partitioned and sorted so that every document is followed by the next one; extra rows only follow."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    at = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 4 * n)).first()[0] if n > 1 else None
    cuts = sorted({int(c) for c in at or []})
    bucket = range_of(F.col("doc_id"), cuts)
    firsts = ids.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("none")).orderBy("bucket").collect()  # at most n rows
    order = [(r["bucket"], None if r["none"] else r["head"]) for r in firsts]
    before = [(order[i][1], order[i - 1][0]) for i in range(len(order))]
    heads = spark.createDataFrame(before, "head long, before int")
    rows = docs.select("doc_id", "text", bucket.cast("int").alias("bucket"))
    sent = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    to = F.array(F.struct(F.col("bucket"), F.lit(False).alias("extra")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("extra"))))
    sent = sent.select(F.explode(F.filter(to, lambda x: x.isNotNull())).alias("to"), "doc_id", "text").select("to.*", "doc_id", "text")
    return sent.repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES, strict=True)], NAMES)

    held, out, size = None, [], 0
    for batch in batches:
        cols = [batch.column(c) for c in ("bucket", "extra", "doc_id", "text")]
        for i in range(batch.num_rows):
            bucket, extra, doc, text = (c[i].as_py() for c in cols)
            text = text or ""
            found = winnow(text)
            now = (bucket, extra, doc, text, found, np.unique(found[0]))
            if held and held[0] == bucket and not held[1]:
                _, _, doc, text, found, mine = held
                cut = len(text) // 4
                edited = text[: len(text) - cut] + now[3][:cut]
                again = winnow(edited)
                out.append((doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), packed(found), packed(again), likeness(mine, np.unique(again[0])), likeness(mine, now[5])))
                size += len(out[-1][3]) + len(out[-1][4])
                if size > 8_000_000:
                    yield done(out)
                    out, size = [], 0
            held = now
    if out:
        yield done(out)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    The next document is that of the next doc_id (null ids come first, equal ids in the order of their texts), after the last the first. In the
    edited text the last quarter of the code points, rounded down, is replaced by the first as many of the next document, or all it has.
    A null text counts as empty: n_chars 0, an empty fingerprint, alike (1) to another empty one and else 0. An empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    return with_next(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(_marks, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
ORACLES: dict[str, str] = {}
