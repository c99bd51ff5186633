"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of five-word shingles into powers of two. Every document's shingles are read in windows just
as long as the items of a partition, at every STEP-th shingle, so that an item that stands in a long document fills most of some window; window and
item are compared by HASHES min-hashes, and one equal min-hash makes a candidate. Candidates are verified by exact containment: the share of
the item's shingles that the document has.

A min-hash that more than HOT items share (a common prompt line) makes no candidates: documents that have it are held against all items of such min-hashes
at once, by an index of the items' shingles, which is exact.

Scale: one map over the documents, no shuffle. The items are a test set, read one block after the other, each a stated query set against all
documents; a block has at most ITEMS items and about BYTES of text, which bounds its sketches, which are what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.llm.common import read
from reeltide.llm.kernels import codepoints, multipliers, shingles, words

SHINGLE, HASHES, STEP, ITEMS, CHUNK, TINY = 5, 24, 8, 20_000, 1 << 15, 4
SIMILARITY = 0.8
#: Bytes of text of a block of items; of one item more if that is longer.
BYTES = 16_000_000
#: Items that share a min-hash and are still candidates one by one.
HOT = 32

#: (item_id, text) rows of a block of items
Items = list[tuple[object, str | None]]


class Sketches:
    """The items of a block, by shingle length and size partition."""

    def __init__(self, items: Items):
        self.ids, self.sets = [], []
        self.parts: dict[tuple[int, int], list[int]] = {}
        for item, text in items:
            h, _, _ = words(codepoints(text or ""))
            if not h.size:
                continue
            k = min(SHINGLE, h.size)
            own = np.unique(shingles(h, k))
            self.parts.setdefault((k, 1 << int(own.size - 1).bit_length()), []).append(len(self.ids))
            self.ids.append(item)
            self.sets.append(own)
        self.factors = multipliers(HASHES, 8)
        self.values, self.owners, self.bits = {}, {}, {}
        for part, members in self.parts.items():
            if part[1] <= TINY:  # of so few shingles a window would hold mostly others; each of them is looked up
                sig = np.concatenate([self.sets[i] for i in members])
                own = np.repeat(np.array(members), [self.sets[i].size for i in members])
            else:
                sig = np.concatenate([(self.sets[i][None, :] * self.factors[:, None]).min(1) for i in members])
                own = np.repeat(np.array(members), HASHES)
            order = np.argsort(sig, kind="stable")
            self.values[part], self.owners[part] = sig[order], own[order]
            bits = np.zeros(1 << 20, bool)
            bits[sig & np.uint64((1 << 20) - 1)] = True
            self.bits[part] = bits
        self._index()

    def _index(self) -> None:
        """By shingle length: the shingles of the items of hot min-hashes, and who has each."""
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        hot: dict[int, set[int]] = {}
        for part, values in self.values.items():
            new = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            for at, n in zip(new.tolist(), np.diff(np.r_[new, values.size]).tolist(), strict=True):
                if n > HOT:
                    hot.setdefault(part[0], set()).update(self.owners[part][at : at + n].tolist())
        for k, members in hot.items():
            items = np.array(sorted(members))
            every = np.concatenate([self.sets[i] for i in items.tolist()])
            own = np.repeat(np.arange(items.size), [self.sets[i].size for i in items.tolist()])
            order = np.argsort(every, kind="stable")
            values, begin = np.unique(every[order], return_index=True)
            self.index[k] = values, np.append(begin, every.size), own[order], items

    def held(self, k: int, mine: np.ndarray, similarity: float) -> list[int]:
        """The items of hot min-hashes of which the distinct shingles `mine` are `similarity` or more."""
        values, begin, own, items = self.index[k]
        at = np.minimum(np.searchsorted(values, mine), values.size - 1)
        at = at[values[at] == mine]
        n = begin[at + 1] - begin[at]
        places = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        count = np.bincount(own[places], minlength=items.size)
        sizes = np.array([self.sets[i].size for i in items.tolist()])
        return items[count / sizes >= similarity - 1e-12].tolist()

    def candidates(self, s: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end): an item and a range of s whose window shares a min-hash with it; -1 for the items of a hot min-hash."""
        sizes = sorted(size for kk, size in self.parts if kk == k)
        for size in [x for x in sizes if x <= TINY]:
            for item, at in self._owners((k, size), s[None, :]):
                yield item, at, at + 1
        sizes = [x for x in sizes if x > TINY]
        if not sizes or not s.size:
            return
        reach = (-(-(sizes[-1] - 1) // STEP) + 1) * STEP
        for at in range(0, s.size, CHUNK):
            piece = s[at : at + CHUNK + reach]
            pad = -piece.size % STEP
            v = piece[None, :] * self.factors[:, None]
            if pad:
                v = np.concatenate([v, np.full((HASHES, pad), np.uint64(2**64 - 1))], axis=1)
            for _ in range(3):  # STEP is 8
                v = np.minimum(v[:, 0::2], v[:, 1::2])
            held, low = 1, v
            for size in sizes:
                m = min(-(-(size - 1) // STEP) + 1, v.shape[1])
                while 2 * held <= m:
                    low, held = np.minimum(low[:, :-held], low[:, held:]), 2 * held
                now = np.minimum(low[:, : low.shape[1] - (m - held)], low[:, m - held :]) if m > held else low
                for item, c in self._owners((k, size), now):
                    yield item, at + c * STEP, at + (c + m) * STEP

    def _owners(self, part: tuple[int, int], found: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, column) of the values (hashes by places) that belong to items of the part."""
        rows, cols = np.nonzero(self.bits[part][(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not rows.size:
            return
        values, where = np.unique(found[rows, cols], return_inverse=True)
        a, b = (np.searchsorted(self.values[part], values, side) for side in ("left", "right"))
        for u in np.flatnonzero(b > a):
            seen = np.unique(cols[where == u]).tolist()
            for item in self.owners[part][a[u] : b[u]].tolist() if b[u] - a[u] <= HOT else (-1,):
                for c in seen:
                    yield item, c


def contained(texts: list[str], sketches: Sketches, similarity: float = SIMILARITY) -> list[tuple[int, int, float]]:
    """(text, item, containment) of every pair found at `similarity` or more."""
    found: dict[tuple[int, int], float] = {}
    hashes = [words(codepoints(t))[0] for t in texts]
    for k in sorted({k for k, _ in sketches.parts}):
        own = [shingles(h, k) if h.size >= k else h[:0] for h in hashes]
        ends = np.cumsum([s.size for s in own])
        pairs: set[tuple[int, int]] = set()
        for item, begin, end in sketches.candidates(np.concatenate(own) if own else np.zeros(0, np.uint64), k):
            for doc in range(int(np.searchsorted(ends, begin, "right")), min(len(own) - 1, int(np.searchsorted(ends, end - 1, "right"))) + 1):
                pairs.add((doc, item))
        sets: dict[int, np.ndarray] = {}
        for doc, item in sorted(pairs):
            if doc not in sets:
                sets = {doc: np.unique(own[doc])}
            if item < 0:
                for other in sketches.held(k, sets[doc], similarity):
                    found[doc, other] = float(np.isin(sketches.sets[other], sets[doc], assume_unique=True).mean())
                continue
            share = np.isin(sketches.sets[item], sets[doc], assume_unique=True).mean()
            if share >= similarity - 1e-12:
                found[doc, item] = float(share)
    return [(d, i, s) for (d, i), s in sorted(found.items())]


def item_blocks(benchmark: DataFrame, size: int = ITEMS, most: int = BYTES) -> Iterator[Items]:
    """The items, at most `size` at a time, and no more once they have `most` characters of text."""
    held: Items = []
    chars = 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        chars += len(r["text"] or "")
        if len(held) >= size or chars >= most:
            yield held
            held, chars = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of a document and a test item that it contains: doc_id, item_id, containment (the share of the item's distinct shingles).

    Words are runs of letters, digits and marks, without regard to case. An item of fewer than five words is one shingle of all its
    words; items and documents without words are in no pair. Null texts count as empty. Rows with the same id are told of each. Empty tables give
    no rows. Columns other than doc_id, item_id and text are not read.
    """
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows, out = docs.select("doc_id", "text"), None
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Sketches(block))

        def told(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sketches = shared.value
            for batch in batches:
                for at in _parts(batch.column("text")):
                    found = contained([batch.column("text")[i].as_py() or "" for i in at], sketches, similarity)
                    if found:
                        docs_at = pa.array([at[d] for d, _, _ in found], pa.int64())
                        items = [None if (x := sketches.ids[i]) is None else str(x) for _, i, _ in found]
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(docs_at), pa.array(items, pa.string()), pa.array([s for _, _, s in found], pa.float64())], ["doc_id", "item_id", "containment"])

        more = rows.mapInArrow(told, f"doc_id {doc_type}, item_id string, containment double")
        out = more if out is None else out.unionByName(more)
    if out is None:
        out = rows.limit(0).select("doc_id", F.lit("").alias("item_id"), F.lit(0.0).alias("containment"))
    return out.withColumn("item_id", F.col("item_id").cast(id_type))


def _parts(texts: pa.Array, most: int = 400_000) -> Iterator[list[int]]:
    """Row numbers in groups of about `most` bytes of text."""
    held, size = [], 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        held.append(i)
        size += n or 0
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that contain a test item; all columns stay, and so do rows of null or empty text. No shuffle.

    Repeated rows go or stay alike; with an empty table of items all stay, and an empty table of documents stays empty.
    """
    out = docs
    names = docs.columns
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Sketches(block))

        def told(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            at_text = names.index("text")
            for batch in batches:
                texts = batch.column(at_text)
                keep = np.ones(batch.num_rows, bool)
                for at in _parts(texts):
                    for d, _, _ in contained([texts[i].as_py() or "" for i in at], shared.value, similarity):
                        keep[at[d]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(told, docs.schema)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict[str, str] = {}
