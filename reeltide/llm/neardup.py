"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Equal texts are one node. A text's five-word shingles are labelled with their occurrence number; each of SKETCHES hash functions takes the
ORDER least of them, kept in the order of the text. Texts that share a sketch are candidates. A pair is linked if the Jaccard
similarity of their shingles is SIMILARITY or more, or if at least ALIGNED of the longer text's words are aligned with the other's within a band. Classes are the connected
components of the links.

Scale: sketches are computed in one map. In a bucket of equal sketches all texts are first compared with one of them, that which has most texts in its buckets (a star: one pair a
text, the one that most sketches agree on), never all pairs: copies of a text are nearer to what they were made from than to one another. Then texts of each class are compared with those of a centre. This only saves work, no link depends on it. What is left are texts in buckets that still hold several classes.
Those of small buckets are compared one by one, by outlines that no linked pair fails. Those of larger ones
meet by an exact prefix filter: a text's shingles, and its words with their occurrence numbers, are ordered from rare to frequent (by counts of hashed SLOTS over these texts), and two texts can only be linked if they share one of the rarest fifth of their
shingles or the rarest tenth of their words, at places that leave room for the overlap asked for. Texts of a template share its frequent shingles, not rare ones, so their pairs never become rows. Texts move once to be turned into word numbers, of candidates only afterwards.
Hot texts of stars, and hot shingles, are joined as one row a key against many, which AQE splits.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reeltide.llm.common import durable, durable_in_loop, read, release
from reeltide.llm.components import components, flattened, follow
from reeltide.llm.kernels import codepoints, mixed, multipliers, occurrences, shingles, words

SHINGLE, SKETCHES, ORDER, SIMILARITY = 5, 32, 2, 0.8
#: Share of aligned words. A text with every twelfth word changed has 0.92 of them aligned, and 0.4 of its shingles in common; below 0.9 short texts
#: with a line in common would be taken for copies.
ALIGNED = 0.9
#: Texts of more words are first aligned between shared unique shingles, which is enough where it finds what is asked for.
DIRECT = 4096
#: Sketches of so many shingles are made at once.
PIECE = 1 << 15
#: Counters of shingles and words by hash, one table of 1 MB. Any counts give a right order; true ones give short lists.
SLOTS = 1 << 18
#: Numbers of 64 bins each that outline a text's shingles, and its words; texts of a bucket whose pairs are looked at one by one.
LANES, BLOCK = 16, 64
#: Rarer parts of its text that a part carries, so that a pair that shares many leaves few rows.
EARLIER = 16
#: Rounds of stars around the centres of classes, after the first one.
ROUNDS = 1
#: Where the text id begins in a node, counted from 1.
NODE = 9

_FACTORS = multipliers(SKETCHES, 5)


def order_sketches(h: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of the ORDER (two) least occurrence-labelled shingles, in the order of the text; none for a text without words."""
    s = shingles(h, SHINGLE)
    if not s.size:
        return s
    label = mixed(s + occurrences(s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    least, places = [], []
    rows = np.arange(SKETCHES)
    for at in range(0, label.size, PIECE):  # the two least of each piece, of which the two least of all are
        v = label[None, at : at + PIECE] * _FACTORS[:, None]
        for _ in range(min(ORDER, v.shape[1])):
            first = v.argmin(axis=1)
            least.append(v[rows, first])
            places.append(first + at)
            v[rows, first] = np.uint64(2**64 - 1)
    least, places = np.array(least), np.array(places)
    two = np.sort(np.take_along_axis(places, np.argsort(least, axis=0, kind="stable")[:ORDER], 0), axis=0)
    return mixed((label[two[0]] ^ np.arange(SKETCHES, dtype=np.uint64)) ^ (label[two[-1]] >> np.uint64(1)))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tids, found = [], []
        for x in batch.column("text"):
            text = x.as_py() or ""
            tids.append(hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
            found.append(order_sketches(words(codepoints(text))[0]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tids, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "tid", "sketches"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [(words(codepoints(x.as_py() or ""))[0] >> np.uint64(32)).astype("<u4") for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array([x.tobytes() for x in told], pa.binary()), pa.array([outline(x) for x in told], pa.binary())], ["tid", "words", "outline"])


def parts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a text as word numbers: its distinct shingles, and its words with their occurrence numbers, as two kinds of hashes."""
    s = np.unique(shingles(a.astype(np.uint64), SHINGLE)) | np.uint64(1)
    w = mixed(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + occurrences(a).astype(np.uint64)) & ~np.uint64(1)
    return np.unique(s), w


def slots(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(SLOTS)).astype(np.int64)


def rarest(a: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For shingles and for words the hashes, rare ones first, of which linked texts share one, and how many the text has."""
    out = []
    for h, share in zip(parts(a), (SIMILARITY, ALIGNED), strict=True):
        order = np.lexsort((h, counts[slots(h)]))
        out.append((h[order[: h.size - int(np.ceil(share * h.size - 1e-9)) + 1]], h.size))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, some, size = np.zeros(SLOTS, np.int64), [], 0
    for batch in batches:
        for x in batch.column("words"):
            some += [slots(h) for h in parts(np.frombuffer(x.as_py(), "<u4"))]
            size += some[-1].size + some[-2].size
            if size > SLOTS:
                total += np.bincount(np.concatenate(some), minlength=SLOTS)
                some, size = [], 0
    if some:
        total += np.bincount(np.concatenate(some), minlength=SLOTS)
    at = np.flatnonzero(total)
    for i in range(0, at.size, 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000].astype(np.int32)), pa.array(total[at[i : i + 50_000]])], ["slot", "n"])


def bits(h: np.ndarray) -> np.ndarray:
    """Which of 64 * LANES bins the hashes are in, as LANES numbers."""
    out = np.zeros(64 * LANES, np.uint8)
    out[((h >> np.uint64(40)) % np.uint64(64 * LANES)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view("<u8")


def outline(a: np.ndarray) -> bytes:
    """How many distinct shingles and how many words a text has, and the bins of both."""
    s, w = parts(a)
    return np.array([s.size, w.size], "<u8").tobytes() + bits(s).tobytes() + bits(w).tobytes()


def possible(x: np.ndarray) -> np.ndarray:
    """Which pairs of outlines (rows of numbers) may be linked: no pair that alike() links is left out, as what is in a bin that the other has not cannot be shared."""
    n = x[:, :2].astype(np.int64)
    out = np.zeros((len(x), len(x)), bool)
    for kind, (share, both) in enumerate(((SIMILARITY, True), (ALIGNED, False))):
        b, size = x[:, 2 + kind * LANES : 2 + (kind + 1) * LANES], n[:, kind]
        for i in range(len(x)):
            mine, theirs = np.bitwise_count(b[i] & ~b).sum(axis=1, dtype=np.int64), np.bitwise_count(b & ~b[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(size[i] - mine, size - theirs)
            out[i] |= most >= (share * (size[i] + size - most) if both else share * np.maximum(size[i], size)) - 1e-6
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y) of small buckets: what is of different classes and may be linked."""
    for batch in batches:
        found: set[tuple[bytes, bytes]] = set()
        for texts in batch.column("texts"):
            tids, roots, outlines = texts.values.flatten()
            x = np.frombuffer(b"".join(outlines.to_pylist()), "<u8").reshape(len(outlines), -1)
            roots = roots.to_numpy()
            ok, tids = np.triu(possible(x), 1) & (roots[:, None] != roots[None, :]), tids.to_pylist()
            found.update((min(tids[i], tids[j]), max(tids[i], tids[j])) for i, j in zip(*np.nonzero(ok), strict=True))
        if found:
            x, y = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["x", "y"])


def _remaining(shared: DataFrame, labels: DataFrame, numbers: DataFrame) -> DataFrame:
    """(x, y): of the texts in buckets with several classes, all pairs of different classes that may be linked. Small buckets are looked at one by one, larger ones by the rare parts of their texts."""
    rows = shared.select("sketch", "tid").join(labels.withColumnRenamed("node", "tid"), "tid", "left").select("sketch", "tid", F.xxhash64(F.coalesce("root", "tid")).alias("root"))
    several = rows.groupBy("sketch").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("sketch", (F.col("n") > BLOCK).alias("large"))
    rows = durable_in_loop(rows.join(several, "sketch"))
    small = rows.where("NOT large").select("sketch", "tid", "root").join(numbers.select("tid", "outline"), "tid")
    small = small.groupBy("sketch").agg(F.collect_list(F.struct("tid", "root", "outline")).alias("texts")).select("texts").mapInArrow(_near, "x binary, y binary")
    large = _by_rare_parts(rows.where("large").select("tid", "root").distinct().join(numbers.select("tid", "words"), "tid"))
    return small.unionByName(large).distinct()


def _by_rare_parts(texts: DataFrame) -> DataFrame:
    """(x, y) of all texts (tid, root, words) of different classes that may be linked: those that share one of their rarest parts, at places and with bins that leave room for the overlap asked for."""
    texts = durable_in_loop(texts.select("tid", "root", "words"))
    counts = np.zeros(SLOTS, np.uint32)
    found = texts.select("words").mapInArrow(_counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows of two numbers
    counts[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), 2**32 - 1)
    table = texts.sparkSession.sparkContext.broadcast(counts)
    lanes = [f"b{i}" for i in range(LANES)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            n = [h.size for _, _, h, _, _ in held]
            cols = [pa.array(np.concatenate([x[2] for x in held]).view(np.int64)), pa.array([x[0] for x, k in zip(held, n, strict=True) for _ in range(k)], pa.binary())]
            cols += [pa.array(np.repeat([x[i] for x in held], n)) for i in (1, 3)]
            bins = np.repeat(np.array([x[4] for x in held]).view(np.int64), n, axis=0)
            earlier = pa.array([x[2].view(np.int64)[max(0, i - EARLIER) : i] for x in held for i in range(x[2].size)], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([np.arange(k) for k in n])), *[pa.array(bins[:, i]) for i in range(LANES)], earlier], ["part", "tid", "root", "size", "place", *lanes, "earlier"])

        held, rows = [], 0
        for batch in batches:
            for tid, root, x in zip(batch.column("tid").to_pylist(), batch.column("root").to_pylist(), batch.column("words"), strict=True):
                a = np.frombuffer(x.as_py(), "<u4")
                for (h, size), whole in zip(rarest(a, table.value), parts(a), strict=True):
                    held.append((tid, root, h, size, bits(whole)))
                    rows += h.size
                if rows > 20_000:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    listed = durable_in_loop(texts.mapInArrow(first, "part long, tid binary, root long, size long, place long, " + ", ".join(f"{b} long" for b in lanes) + ", earlier array<long>"))
    table.destroy()
    here = Window.partitionBy("part")
    met = listed.withColumns({"a": F.min("root").over(here), "b": F.max("root").over(here)}).where("a <> b").drop("a", "b")
    x, y = (met.select("part", *[F.col(c).alias(f"{n}_{c}") for c in ("tid", "root", "size", "place", *lanes, "earlier")]) for n in "xy")
    word = F.col("part") % 2 == 0
    alone = lambda n, m: reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{n}_{b}").bitwiseAND(F.bitwise_not(F.col(f"{m}_{b}")))) for b in lanes])
    most = F.least(F.col("x_size") - F.greatest(F.col("x_place"), alone("x", "y")), F.col("y_size") - F.greatest(F.col("y_place"), alone("y", "x")))  # what can be shared from here on
    longer, both = F.greatest("x_size", "y_size"), F.col("x_size") + F.col("y_size")
    room = most >= F.when(word, ALIGNED * longer).otherwise(SIMILARITY / (1 + SIMILARITY) * both) - 1e-6
    new = ~F.arrays_overlap("x_earlier", "y_earlier")  # a pair that shares an earlier part has met there, with more room
    pairs = x.join(y, "part").where((F.col("x_root") < F.col("y_root")) & room & new)
    return pairs.select(F.least("x_tid", "y_tid").alias("x"), F.greatest("x_tid", "y_tid").alias("y"))


def _centred(shared: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """(x, y, root, centre): texts of each class in a bucket and of the bucket's centre, the class whose root is first.

    A class has at most three pairs with a centre, however many buckets they share: of the first texts of both, and two that hashes of the round name. Centres are
    before their classes, so that links to one centre a class are a forest.
    """
    now = shared.select("sketch", "tid").join(labels.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    some = now.groupBy("sketch", "root").agg(F.min("tid").alias("tid"), F.min(F.struct(F.xxhash64("tid", F.lit(turn)).alias("h"), "tid")).alias("m")).select("sketch", "root", "tid", F.col("m.tid").alias("other"))
    centres = some.groupBy("sketch").agg(F.min(F.struct("root", "tid", "other")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sketch", "c")
    met = some.join(centres, "sketch").where("root <> c.root")
    ends = [F.struct(F.least(n, f"c.{n}").alias("x"), F.greatest(n, f"c.{n}").alias("y")) for n in ("tid", "other")]
    drawn = [F.min(F.struct(F.xxhash64("other", "c.other", F.lit(2 * turn + k)).alias("h"), ends[1].alias("e"))).alias(f"e{k}") for k in range(2)]
    one = met.groupBy("root", F.col("c.root").alias("centre")).agg(F.min(ends[0]).alias("e"), *drawn)
    return one.select("root", "centre", F.explode(F.array_distinct(F.array("e", "e0.e", "e1.e"))).alias("e")).select("e.x", "e.y", "root", "centre")


def aligned(a: np.ndarray, b: np.ndarray, band: int, least: int = 0) -> int:
    """The most words of a and b that can be matched in order with positions at most `band` apart, by bit-parallel dynamic programming.

    Of texts of more than DIRECT words, where fewer than `least` matches turn out to be possible, a number below `least` is given.
    """
    if not a.size or not b.size:
        return 0
    if a.size > DIRECT:
        return _aligned_in_band(a, b, band, least)
    bits: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        bits[x] = bits.get(x, 0) | (1 << i)
    full, wide = (1 << a.size) - 1, (1 << (2 * band + 1)) - 1
    v = full
    for j, x in enumerate(b.tolist()):
        m = bits.get(x)
        if m is None:
            continue
        m &= wide << (j - band) if j >= band else wide >> (band - j)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return a.size - v.bit_count()


def _aligned_in_band(a: np.ndarray, b: np.ndarray, band: int, least: int) -> int:
    """aligned() with only those bits of a held that the band reaches, so that memory grows with the band."""
    order = np.argsort(a, kind="stable")
    values, first = np.unique(a[order], return_index=True)
    first = np.append(first, a.size)
    at = np.minimum(np.searchsorted(values, b), values.size - 1)
    known = (values[at] == b).tolist()
    low, high, found = 0, min(a.size, band + 1), 0
    v = (1 << high) - 1  # of places low to high - 1 of a; a zero is a match
    for j in range(b.size):
        down = min(j - band, a.size) - low
        if down > 0:
            found += down - (v & ((1 << down) - 1)).bit_count()
            v >>= down
            low += down
            if low >= a.size:
                return found
        up = min(a.size, j + band + 1) - high
        if up > 0:
            v |= ((1 << up) - 1) << (high - low)
            high += up
        if not j % 1024 and found + (high - low - v.bit_count()) + b.size - j < least:
            return 0
        if not known[j]:
            continue
        where = order[first[at[j]] : first[at[j] + 1]]
        where = where[np.searchsorted(where, low) : np.searchsorted(where, high)]
        if where.size <= 64:
            m = 0
            for p in where.tolist():
                m |= 1 << (p - low)
        else:
            held = np.zeros(high - low, np.uint8)
            held[where - low] = 1
            m = int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
        u = v & m
        if u:
            v = ((v + u) | (v - u)) & ((1 << (high - low)) - 1)
    return found + high - low - v.bit_count()


def alignment(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Aligned words over the words of the longer text; the band is what `similarity` leaves for insertions and deletions.

    The share is exact where the texts are short; else it may be a bound, on the same side of `similarity` as the exact one.
    """
    longer = max(a.size, b.size)
    if not longer:
        return 1.0
    n = min(a.size, b.size)
    if n < similarity * longer:
        return n / longer * 0.999
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    most = int(np.minimum(ca[ia], cb[ib]).sum())
    if most < similarity * longer:
        return most / longer  # an upper bound, below what is asked for
    band = int((1 - similarity) * longer) + 1
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if differ.size else n
    differ = np.flatnonzero(a[head:][::-1][: n - head] != b[head:][::-1][: n - head])
    tail = int(differ[0]) if differ.size else n - head
    x, y = a[head : a.size - tail], b[head : b.size - tail]
    need = int(np.ceil(similarity * longer)) - head - tail
    if max(x.size, y.size) > DIRECT and (some := _between_anchors(x, y, band)) >= need:
        return (head + tail + some) / longer  # a lower bound, not below what is asked for
    return (head + tail + aligned(x, y, band, need)) / longer


def _between_anchors(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """A lower bound of aligned(): between shingles that are unique in both, taken in an order that rises in both."""
    sx, sy = shingles(x.astype(np.uint64), SHINGLE), shingles(y.astype(np.uint64), SHINGLE)
    ux, ix, cx = np.unique(sx, return_index=True, return_counts=True)
    uy, iy, cy = np.unique(sy, return_index=True, return_counts=True)
    _, px, py = np.intersect1d(ux[cx == 1], uy[cy == 1], assume_unique=True, return_indices=True)
    px, py = ix[cx == 1][px], iy[cy == 1][py]
    near = np.abs(px - py) <= band
    order = np.argsort(px[near])
    px, py = px[near][order], py[near][order]
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * px.size
    for k, j in enumerate(py.tolist()):
        p = bisect_left(ends, j)
        back[k] = at[p - 1] if p else -1
        ends[p : p + 1], at[p : p + 1] = [j], [k]
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    total, i, j = 0, 0, 0
    for k in [*reversed(chain), None]:
        ni, nj = (int(px[k]), int(py[k])) if k is not None else (x.size, y.size)
        if ni < i or nj < j:
            continue
        gx, gy = x[i:ni], y[j:nj]
        if max(gx.size, gy.size) <= DIRECT:
            total += aligned(gx, gy, band)
        else:  # nothing unique in common: a stretch of repeats, aligned in pieces of a size
            total += sum(aligned(gx[o : o + DIRECT], gy[o : o + DIRECT], band) for o in range(0, max(gx.size, gy.size), DIRECT))
        if k is not None:
            total, i, j = total + 1, ni + 1, nj + 1
    return total


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, share: float = ALIGNED) -> int:
    """2 if two texts, as word numbers, are near duplicates by their shingles, 1 if only by alignment, else 0."""
    sa, sb = np.unique(shingles(a.astype(np.uint64), SHINGLE)), np.unique(shingles(b.astype(np.uint64), SHINGLE))
    both = np.intersect1d(sa, sb, assume_unique=True).size
    if both >= similarity * (sa.size + sb.size - both):
        return 2
    return int(alignment(a, b, share) >= share)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [alike(np.frombuffer(a.as_py(), "<u4"), np.frombuffer(b.as_py(), "<u4")) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array([g > 0 for g in got]), pa.array([g > 1 for g in got])], ["x", "y", "ok", "strong"])


def _verify(pairs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(x, y, ok, strong) of pairs of text ids: whether they are linked, and by their shingles."""
    first = pairs.join(numbers.select(F.col("tid").alias("x"), F.col("words").alias("a")), "x")
    both = first.join(numbers.select(F.col("tid").alias("y"), F.col("words").alias("b")), "y").select("x", "y", "a", "b")
    return durable_in_loop(both.mapInArrow(_verified, "x binary, y binary, ok boolean, strong boolean"))


def text_id() -> Column:
    """MD5 of the whole text, null counting as empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _node(n: Column, tid: Column) -> Column:
    """A text id behind what makes texts with more company (n texts in their buckets, repeats counted) come first in order."""
    return F.concat(F.unhex(F.lpad(F.hex(F.lit(2**62) - n), 16, "0")), tid)


def named(column: str) -> Column:
    """An id of any type, null too, as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a document: doc_id, tid, class_id, class_size; one row a class: root, class_id, tid of its keeper).

    class_id is the least doc_id of the class, null if all are null. The keeper is the row of that id, of the least text id among several texts.
    """
    rows = docs.select("doc_id", "text")
    sketched = durable(rows.mapInArrow(_sketched, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tid binary, sketches array<bigint>"))
    texts = durable(sketched.groupBy("tid").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("sketches").alias("sketches")))
    buckets = texts.select("tid", F.explode(F.array_distinct("sketches")).alias("sketch"))
    met = durable(buckets.join(buckets.groupBy("sketch").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sketch"))
    nodes = durable(met.groupBy("tid").agg(F.sum("n").alias("n")).select("tid", _node(F.col("n"), F.col("tid")).alias("node")))
    ranked = met.join(nodes, "tid").select("sketch", F.col("node").alias("tid"))
    shared = durable(ranked.join(ranked.groupBy("sketch").agg(F.min("tid").alias("x")), "sketch"))
    votes = shared.where("x <> tid").groupBy("x", F.col("tid").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    pairs = durable(votes.groupBy("y").agg(F.min(F.struct(-F.col("n"), "x")).alias("best")).select(F.col("best.x").alias("x"), "y"))

    needed = nodes.join(texts.select("tid", named("id").alias("own")), "tid")
    own = rows.select(text_id().alias("tid"), named("doc_id").alias("own"), "text")
    numbers = durable(own.join(needed, ["tid", "own"]).select(F.col("node").alias("tid"), "text").mapInArrow(_numbered, "tid binary, words binary, outline binary").dropDuplicates(["tid"]))

    release(docs.sparkSession)  # the shuffled texts
    tested = _verify(pairs, numbers)
    labels = flattened(tested.where("ok").select(F.col("y").alias("node"), F.col("x").alias("root")))  # stars: x is less than y, one x a y
    for turn in range(ROUNDS):
        fresh = durable_in_loop(_centred(shared, labels, turn))
        more = _verify(fresh.select("x", "y"), numbers)
        release(docs.sparkSession)
        if more.where("ok").isEmpty():
            break
        up = more.where("ok").join(fresh, ["x", "y"]).groupBy("root").agg(F.min("centre").alias("centre"))
        up = flattened(durable_in_loop(up.select(F.col("root").alias("node"), F.col("centre").alias("root"))))
        labels, tested = follow(labels, up), tested.unionByName(more)

    done = tested.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    more = _verify(durable_in_loop(_remaining(shared, labels, numbers).join(done, ["x", "y"], "left_anti")), numbers).where("ok")
    release(docs.sparkSession)
    if not more.isEmpty():
        a, b = (labels.select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("x", "a"), ("y", "b")))
        ends = more.join(a, "x", "left").join(b, "y", "left").select(F.coalesce("a", "x").alias("a"), F.coalesce("b", "y").alias("b"))
        labels = follow(labels, components(ends.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))))

    told = labels.select(F.substring("node", NODE, 16).alias("tid"), F.substring("root", NODE, 16).alias("root"))
    rooted = texts.select("tid", "id", "copies").join(told, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    whole = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("id").isNull(), "id", "tid")).alias("keeper"))
    whole = durable(whole.select("root", "class_id", "class_size", F.col("keeper.tid").alias("keeper")))
    by_text = rooted.select("tid", "root").join(whole.select("root", "class_id", "class_size"), "root").select("tid", "class_id", "class_size")
    return sketched.select("doc_id", "tid").join(by_text, "tid"), whole


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id (the least doc_id of its class), class_size (its rows), kept (whether it is the one that stays).

    Equal texts are of one class, null counting as empty; texts without words are alike only if equal. Rows of a null doc_id are kept only if their class
    has no other; repeated rows are told of each, and kept alike. Ids may be of any type that can be ordered and written as a string. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    rows, _ = classes(docs)
    return rows.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: all its columns, none else. Of rows that repeat id and text, one stays."""
    rows, whole = classes(docs)
    keepers = whole.select(F.col("keeper").alias("__tid"), named("class_id").alias("__own"))
    repeated = not rows.select("doc_id", "tid").join(whole.select(F.col("keeper").alias("tid"), F.col("class_id").alias("id")), "tid").where("doc_id <=> id").groupBy("tid").count().where("count > 1").isEmpty()
    own = docs.withColumns({"__tid": text_id(), "__own": named("doc_id")})
    kept = own.join(keepers, ["__tid", "__own"], "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["__tid", "__own"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op5_neardup": op5_neardup}
ORACLES: dict[str, str] = {}
