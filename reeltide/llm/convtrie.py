"""A trie of conversation prefixes, by polynomial fingerprints that are verified turn by turn.

Conversations are rebuilt: c begins with the first h turns of its base, c - c % 100, and goes on with its own turns after its first h. The fingerprint
of the first d turns is the sum of hash(turn i) * P**i in two prime fields, a prefix sum that numpy takes over chunks of CHUNK turns; rebuilt prefixes come from sums of base and conversation,
without moving a text. Prefixes of one depth and fingerprint are candidates for one node. A group of candidates is then held, turn by turn, against its representative: the texts of its last turns are compared
with one another, and its parents' fingerprints. Where they differ, the group's members get further fingerprints of another seed, which split it, and all is verified again.

The rollup needs no walk from level to level: a node belongs to its least member, and a conversation's own nodes are the lower end of its path. What lies in a node's subtree is then
the sum, over its members, of what they own at or below its depth: one suffix sum along each conversation and one grouped sum.

Scale: turns are put in order by ranges of (conv_id, turn), so a conversation of very many turns is cut into ranges and chunks, and texts move once for that, once more (only those of groups with several
texts) to be verified. Groups of members are counted and summed with map-side combination; texts of one group are compared under about sqrt(n) salts, then one a salt. Ids of the members that end in one node are joined to pieces by range of id first,
and only the pieces meet. Joins of members to their nodes have one row a node on one side; AQE splits hot nodes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reeltide.llm.common import durable, durable_in_loop, read

#: Turns of a chunk; the base's turns that a conversation may begin with; conversations of a base; characters of a piece of joined ids.
CHUNK, HEADS, FAMILY, PIECE = 1024, 6, 100, 1 << 16
#: The field of the fingerprints and two generators of it.
PRIME, POINTS = (1 << 31) - 1, (48271, 16807)


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, n, chunk, role, text): turns in ascending order of turn (null first), role and text, counted from 0, written durably.

    Sorted ranges are counted one by one; only the conversations that cross a border, at most one a range, get what lies in the ranges before.
    """
    spark = turns.sparkSession
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).where("conv_id IS NOT NULL")
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)]  # bounds of ranges go through the driver
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = clean.repartitionByRange(n, *by).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").drop("turn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, so_far = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            place = np.arange(ids.size) - np.repeat(first, np.diff(np.r_[first, ids.size]))
            place[: first[1] if first.size > 1 else ids.size] += so_far if ids[0] == last else 0
            last, so_far = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(ids.size, part, np.int32)), pa.array(place), batch.column("role"), batch.column("text")], ["conv_id", "part", "place", "role", "text"])

    counted = durable(ranged.mapInArrow(count, "conv_id long, part int, place long, role string, text string"))
    held = counted.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    late = held.withColumn("before", F.sum("k").over(before)).where("before IS NOT NULL").select("conv_id", "part", "before")
    placed = counted.join(F.broadcast(late), ["conv_id", "part"], "left").withColumn("n", F.col("place") + F.coalesce("before", F.lit(0)))  # at most one row a range
    return placed.select("conv_id", "n", F.expr(f"n div {CHUNK}").alias("chunk"), "role", "text")


@functools.cache
def _powers(base: int) -> np.ndarray:
    """base**0 to base**(CHUNK - 1) modulo PRIME."""
    out = np.ones(CHUNK, np.int64)
    for i in range(1, CHUNK):
        out[i] = out[i - 1] * base % PRIME
    return out


def _scan(hashes: pa.Array, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of hashes, each a chunk of turns or its beginning: (list, place, term, running sum) of every hash, the latter two in both fields, and every list's sums.

    A term is hash * point**n with n = chunk * CHUNK + place; all lists are scanned at once.
    """
    sizes = np.diff(hashes.offsets.to_numpy())
    flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(sizes.size), sizes)
    place = np.arange(flat.size) - start[which]
    known, row = np.unique(chunks, return_inverse=True)
    term, run, whole = np.empty((2, flat.size), np.int64), np.empty((2, flat.size), np.int64), np.zeros((2, sizes.size), np.int64)
    for i, point in enumerate(POINTS):
        far = np.array([pow(point, int(c) * CHUNK, PRIME) for c in known], np.int64)[row] if known.size else np.zeros(0, np.int64)
        h = (flat >> (31 * i)) % PRIME  # another part of the hash in each field
        term[i] = h * (_powers(point)[place] * far[which] % PRIME) % PRIME
        total = np.r_[0, np.cumsum(term[i])]  # of fewer than 2**32 terms below 2**31
        run[i] = (total[1:] - total[start][which]) % PRIME
        whole[i] = (total[start + sizes] - total[start]) % PRIME
    return which, place, term, run, whole


def _cut(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose lists have about 64 * CHUNK entries."""
    upto = np.cumsum(np.diff(batch.column(column).offsets.to_numpy())) // (64 * CHUNK)
    edges = np.r_[0, np.flatnonzero(np.diff(upto)) + 1, batch.num_rows]
    for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if e > b:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(b, e - b)]) for c in batch.columns], batch.schema.names)


def chunked(placed: DataFrame, seed: int) -> DataFrame:
    """(conv_id, chunk, hashes, chars, s1, s2, b1, b2): a chunk's turns in order, its sums in both fields, and those of the chunks before it."""
    turn = F.struct("n", F.xxhash64(F.lit(seed), "role", F.lit(seed + 1), "text").bitwiseAND(F.lit((1 << 62) - 1)).alias("h"), F.char_length("text").cast("long").alias("c"))
    rows = placed.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(turn)).alias("t"))  # at most CHUNK narrow entries
    rows = rows.select("conv_id", "chunk", F.col("t.h").alias("hashes"), F.col("t.c").alias("chars"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _cut(batch, "hashes"):
                whole = _scan(some.column("hashes"), some.column("chunk").to_numpy())[4]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(whole[0]), pa.array(whole[1])], [*some.schema.names, "s1", "s2"])

    summed = durable(rows.mapInArrow(sums, "conv_id long, chunk long, hashes array<long>, chars array<long>, s1 long, s2 long"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = summed.select("conv_id", "chunk", *[F.pmod(F.coalesce(F.sum(s).over(before), F.lit(0)), F.lit(PRIME)).alias(b) for s, b in (("s1", "b1"), ("s2", "b2"))])
    return summed.join(earlier, ["conv_id", "chunk"])


def rebuilt(placed: DataFrame, seed: int = 0, bits: int = 62) -> DataFrame:
    """(conv_id, d, n, fp, parent, chars): every rebuilt conversation's prefixes from d = 1, with `bits` bits of fingerprint.

    n is the place of the last turn in the conversation itself, null if it is the base's. parent is the fingerprint of d - 1 turns, 0 for none.
    """
    chunks = chunked(placed, seed)
    heads = chunks.where("chunk = 0").select("conv_id", F.slice("hashes", 1, HEADS).alias("hashes"), F.slice("chars", 1, HEADS).alias("chars"), F.size("hashes").alias("size"))
    own = F.when(F.col("conv_id") % FAMILY == 0, 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % HEADS)
    convs = heads.select(F.col("conv_id").alias("c"), "hashes", own.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    convs = convs.join(heads.select(F.col("conv_id").alias("base"), F.col("hashes").alias("base_hashes"), F.col("chars").alias("base_chars")), "base", "left")
    begin = convs.select(F.col("c").alias("conv_id"), "h", F.slice("hashes", F.lit(1), F.col("h").cast("int")).alias("skipped"), *[F.coalesce(F.slice(x, F.lit(1), F.col("h").cast("int")), F.array().cast("array<long>")).alias(x) for x in ("base_hashes", "base_chars")])
    inverse = [[pow(p, -i, PRIME) for i in range(HEADS)] for p in POINTS]
    mask = np.int64((1 << bits) - 1)

    names = ["conv_id", "d", "n", "fp", "parent", "chars"]

    def print_of(sums: np.ndarray) -> np.ndarray:
        return ((sums[0] << 31) | sums[1]) & mask

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _cut(batch, "hashes"):
                conv, h, chunk, before = some.column("conv_id").to_numpy(), some.column("h").to_numpy(), some.column("chunk").to_numpy(), np.array([some.column(b).to_numpy() for b in ("b1", "b2")])
                zero = np.zeros(conv.size, np.int64)
                which, place, term, run, top = _scan(some.column("base_hashes"), zero)
                k = np.bincount(which, minlength=conv.size)
                first = chunk[which] == 0  # the base's turns stand before the first chunk only
                chars = some.column("base_chars").flatten().to_numpy(zero_copy_only=False)
                above = np.where(place > 0, print_of((run - term) % PRIME), 0)
                cols = [conv[which], place + 1, None, print_of(run), above, chars]
                yield pa.RecordBatch.from_arrays([pa.nulls(int(first.sum()), pa.int64()) if c is None else pa.array(c[first]) for c in cols], names)

                gone = _scan(some.column("skipped"), zero)[4]
                shift = np.array([np.array(inverse[i], np.int64)[h - k] for i in range(2)])
                which, place, term, run, _ = _scan(some.column("hashes"), chunk)
                own = place >= np.where(chunk == 0, h, 0)[which]
                chars = some.column("chars").flatten().to_numpy(zero_copy_only=False)
                at = lambda sums: (top[:, which] + (before[:, which] + sums - gone[:, which]) % PRIME * shift[:, which] % PRIME) % PRIME
                n = place + chunk[which] * CHUNK
                d = n - h[which] + k[which] + 1
                above = np.where(d > 1, print_of(at(run - term)), 0)
                yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in (conv[which], d, n, print_of(at(run)), above, chars)], names)

    ready = chunks.drop("s1", "s2").join(begin, "conv_id")  # one row a chunk
    return ready.mapInArrow(scan, "conv_id long, d long, n long, fp long, parent long, chars long")


def _unlike(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by keys: the first of each, its representative, and whether any other has another turn."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = [row[k] for k in keys]
            if now is None or now[0] != key:
                if now:
                    rows.append(now[1])
                now = (key, row)
            else:
                first = now[1]
                first["bad"] = first["bad"] or row["bad"] or row["role"] != first["role"] or row["text"] != first["text"]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, batch.schema)
            rows = []
        schema = batch.schema
    if now:
        yield pa.RecordBatch.from_pylist([now[1]], schema)


def wrong_groups(prefixes: DataFrame, placed: DataFrame) -> DataFrame:
    """(d, fp, more) of groups that hold prefixes which are not equal: their last turns or their parents differ."""
    key = ["d", "fp", "more"]
    parents = prefixes.groupBy(*key).agg(F.min(F.struct("parent", "parent_more")).alias("a"), F.max(F.struct("parent", "parent_more")).alias("b"), F.count("n").alias("texts"))
    parents = durable_in_loop(parents.where("a <> b OR texts > 1").select(*key, "texts", (F.col("a") != F.col("b")).alias("bad")))
    several = prefixes.where("n IS NOT NULL").join(parents.where("texts > 1").drop("bad"), key)  # prefixes that end in a base's turn end in the very row of the base's own prefix
    salts = F.ceil(F.sqrt(F.col("texts"))).cast("long")
    several = several.select("conv_id", "n", *key, F.pmod(F.xxhash64("conv_id", "n"), salts).alias("salt"))
    texts = several.join(placed.select("conv_id", "n", "role", "text"), ["conv_id", "n"]).select(*key, "salt", "role", "text", F.lit(False).alias("bad"))
    form = "d long, fp long, more long, salt long, role string, text string, bad boolean"
    by = [*key, "salt"]
    some = texts.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda b: _unlike(b, by), form)
    ones = some.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda b: _unlike(b, key), form)
    return ones.where("bad").select(*key).unionByName(parents.where("bad").select(*key)).distinct()


def verified(placed: DataFrame, bits: int = 62) -> DataFrame:
    """Prefixes whose (d, fp, more) are equal exactly if their turns are, with their parents' (parent, parent_more).

    A prefix at or below the first wrong group of its conversation gets one more fingerprint a round; equal prefixes pass through the same groups, so they stay together.
    """
    zero = F.lit(0).cast("long")
    prefixes = durable_in_loop(rebuilt(placed, 0, bits).withColumns({"more": zero, "parent_more": zero}))
    seed = 0
    while True:
        wrong = durable_in_loop(wrong_groups(prefixes, placed))
        if wrong.isEmpty():
            return prefixes
        seed += 2
        first = prefixes.join(wrong, ["d", "fp", "more"]).groupBy("conv_id").agg(F.min("d").alias("from"))
        again = rebuilt(placed, seed).select("conv_id", "d", F.col("fp").alias("fp_"), F.col("parent").alias("parent_"))
        both = prefixes.join(first, "conv_id", "left").join(again, ["conv_id", "d"])
        split = {"more": F.when(F.col("d") >= F.col("from"), F.xxhash64("more", "fp_")).otherwise(F.col("more")), "parent_more": F.when(F.col("d") > F.col("from"), F.xxhash64("parent_more", "parent_")).otherwise(F.col("parent_more"))}
        prefixes = durable_in_loop(both.withColumns(split).select(*prefixes.columns))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of comma-joined ids of each node, in order, of rows sorted by node and id."""
    part, now, ids, piece, size, rows = TaskContext.get().partitionId(), None, [], 0, 0, []
    names = ["d", "fp", "more", "part", "piece", "ids"]

    def close() -> None:
        nonlocal ids, piece, size
        if ids:
            rows.append((*now, part, piece, ",".join(ids)))
        ids, piece, size = [], piece + 1, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) if n == "ids" else pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    for batch in batches:
        for key in zip(*(batch.column(c).to_pylist() for c in ("d", "fp", "more", "conv_id")), strict=True):
            if key[:3] != now:
                close()
                now, piece = key[:3], 0
            ids.append(str(key[3]))
            size += len(ids[-1]) + 1
            if size > PIECE:
                close()
        if rows:
            yield out()
            rows = []
    close()
    if rows:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, joined by commas, of rows sorted by node and piece."""
    now, sha, rows = None, None, []

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], ["d", "fp", "more", "ends_sha256"])

    for batch in batches:
        for key in zip(*(batch.column(c).to_pylist() for c in ("d", "fp", "more", "ids")), strict=True):
            if key[:3] != now:
                if now:
                    rows.append((*now, sha.hexdigest()))
                now, sha = key[:3], hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(key[3].encode())
        if rows:
            yield out()
            rows = []
    if now:
        rows.append((*now, sha.hexdigest()))
        yield out()


def ends(members: DataFrame) -> DataFrame:
    """(d, fp, more, ends_sha256) of nodes in which conversations end: first pieces of ids by range of id, then the digest over a node's pieces."""
    last = members.groupBy("conv_id").agg(F.max(F.struct("d", "fp", "more")).alias("e")).select("conv_id", "e.*")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = last.repartitionByRange(n, "conv_id").sortWithinPartitions("d", "fp", "more", "conv_id")
    pieces = ranged.mapInArrow(_joined, "d long, fp long, more long, part long, piece long, ids string")
    node = ["d", "fp", "more"]
    return pieces.repartition(*node).sortWithinPartitions(*node, "part", "piece").mapInArrow(_digests, "d long, fp long, more long, ends_sha256 string")


def trie(turns: DataFrame, bits: int = 62) -> DataFrame:
    """One row a node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are in the order of turn, null first, ties by role and text; null role or text counts as empty, texts are taken whole. Rows without a conv_id belong to no conversation and are left out; rows that repeat are turns
    of their own. A conversation whose rebuilt form has no turns is a member of the root. An empty table has no conversations and so no nodes, not even a root. Columns other than conv_id, turn, role and text are not read.
    """
    placed = in_order(turns)
    prefixes = verified(placed, bits)
    node = ["d", "fp", "more"]
    zero = F.lit(0).cast("long")
    roots = placed.where("n = 0").select("conv_id", *[zero.alias(c) for c in ("d", "fp", "more", "parent", "parent_more", "chars")])
    members = durable(prefixes.select("conv_id", *node, "parent", "parent_more", "chars").unionByName(roots))

    nodes = members.groupBy(*node).agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("parent", "parent_more", "chars")])
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("fp"), F.col("parent_more").alias("more")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = durable(nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", zero)))

    # what each conversation owns at or below a depth: within a chunk of depths, then what the chunks below hold
    owned = members.select("conv_id", *node).join(nodes.select(*node, "least", "saved", (F.col("n_children") == 0).cast("long").alias("leaf")), node)
    mine = F.col("conv_id") == F.col("least")
    owned = owned.select("conv_id", *node, F.expr(f"d div {CHUNK}").alias("chunk"), *[F.when(mine, F.col(c)).otherwise(zero).alias(c) for c in ("saved", "leaf")])
    deep = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    inside = owned.select("conv_id", "chunk", *node, *[F.sum(c).over(deep).alias(c) for c in ("saved", "leaf")])
    below = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    later = owned.groupBy("conv_id", "chunk").agg(*[F.sum(c).alias(c) for c in ("saved", "leaf")])
    later = later.select("conv_id", "chunk", *[F.sum(c).over(below).alias(f"later_{c}") for c in ("saved", "leaf")]).where("later_leaf IS NOT NULL")
    whole = inside.join(later, ["conv_id", "chunk"], "left")
    sums = whole.groupBy(*node).agg(*[F.sum(F.col(c) + F.coalesce(f"later_{c}", zero)).alias(out) for c, out in (("leaf", "n_leaves"), ("saved", "saved_tokens"))])

    above = nodes.select((F.col("d") + 1).alias("d"), F.col("fp").alias("parent"), F.col("more").alias("parent_more"), F.col("least").alias("parent_conv_id"))
    out = nodes.join(sums, node).join(above, ["d", "parent", "parent_more"], "left").join(ends(members), node, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("least").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op11_convtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal digits, bit by bit; prefixes are lists of digests of their turns.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""

SQL = f"""WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS n
        FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT DISTINCT conv_id, {_CRC} % 6 AS h FROM t),
    r AS (SELECT c.conv_id, n - 6 AS n, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND n < h UNION ALL SELECT conv_id, n, role, text FROM c JOIN t USING (conv_id) WHERE n >= h),
    p AS (SELECT conv_id, row_number() OVER w AS d, len(text) AS chars, list(sha256(len(role) || ':' || role || text)) OVER w AS path FROM r
          WINDOW w AS (PARTITION BY conv_id ORDER BY n) UNION ALL SELECT conv_id, 0, 0, [] FROM c),
    m AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS whole FROM p),
    nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = whole), '')) AS ends_sha256 FROM m GROUP BY path, d),
    k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
    f AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN k ON k.path = nodes.path),
    s AS (SELECT a.path, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves FROM f a JOIN f b ON b.d >= a.d AND b.path[1:a.d] = a.path GROUP BY a.path)
    SELECT f.conv_id, f.d::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
    FROM f JOIN s ON s.path = f.path LEFT JOIN nodes u ON f.d > 0 AND u.path = f.path[1:f.d - 1]"""

QUERIES = {"op11_convtrie": op11_convtrie}
ORACLES = {"op11_convtrie": SQL}
