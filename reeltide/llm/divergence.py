"""How the sources of a language differ in their words: a tournament in which compressed vectors circulate among groups that stay where they are.

A term is kept in a language if enough of its documents have it. A group (language and source) gives every kept term a smoothed share in parts of 10**9, as do all documents of the language together. Terms are
cut into slices of about SLICE by a hash, groups into blocks. Every (language, slice, block) is one resident row: the block's groups as sparse vectors, compressed.
At home it compares its own groups with each other and ranks its terms against the language in local heaps. Then come rounds: in round r block i meets block (r - i) mod B, so that every pair of blocks meets exactly once in B rounds and each block meets at most one
other in a round; the lower block's vectors travel to the higher one, which stays, and the meeting serves both directions. Sums over slices and the merged heaps are the result.

Scale: words are counted in the map, in dictionaries of at most ENTRIES terms, so a term or group however hot sends a few rows a task. Residents are partitioned once and kept on disk; a round shuffles half of the vectors, never all at once.
A block has at least BLOCK groups or the square root of all of the language, so there are at most about sqrt(groups) rounds, and a resident row is bounded by its block and slice. No pair of groups is a row before its value is known.
All arithmetic is in integers: counts below 9 * 10**15, shares by long division.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reeltide.llm.common import durable, durable_in_loop, look_up, read

#: Documents that a kept term needs, what is added to every count, parts of one, and ranks of terms.
LEAST, SMOOTH, PARTS, TOP = 30, 5, 10**9, 50
#: Terms of a slice, groups of a block at least, terms held while counting, bytes of text cut at once.
SLICE, BLOCK, ENTRIES, PIECE = 4096, 8, 200_000, 1 << 22
#: Bytes of UTF-8 in terms, A to Z in lower case; all others separate.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces that end between terms."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and _TERMS[text[end]] != 0x20:
            end += 1
        yield text[at:end].translate(_TERMS).split()
        at = end
    yield text[at:].translate(_TERMS).split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, in partial sums of at most ENTRIES terms each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, dict[bytes, list[int]]] = {}
        held = 0

        def out() -> pa.RecordBatch:
            rows = [(lang, source, term, n, d) for (lang, source), by in sums.items() for term, (n, d) in by.items()]
            lang, source, term, n, d = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                by = sums.setdefault((lang, source), {})
                seen: set[bytes] = set()
                before = len(by)
                for some in terms_of(text.as_py()):
                    for term in some:
                        entry = by.get(term)
                        if entry is None:
                            by[term] = [1, 1]
                            seen.add(term)
                        else:
                            entry[0] += 1
                            if term not in seen:
                                entry[1] += 1
                                seen.add(term)
                held += len(by) - before
                if held > ENTRIES:
                    yield out()
                    sums, held = {}, 0
        if held:
            yield out()

    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return clean.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, all): the kept terms of each group that has them, with their occurrences there and in the whole language. One shuffle, by (lang, term)."""
    rows = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rows = rows.withColumns({"have": F.sum("docs").over(term), "all": F.sum("n").over(term), "one": F.row_number().over(term.orderBy("source")) == 1})
    return durable(rows.where(F.col("have") >= least).select("lang", "source", "term", "n", "all", "one"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(PARTS * (count + SMOOTH) / total), by long division in three steps so that products stay below 2**63."""
    rest, out = counts.astype(np.int64) + SMOOTH, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _packed(vectors: list[tuple]) -> bytes:
    """A block's groups (source, share of an absent term, places, shares) in one compressed value."""
    head = pa.array([v[0] for v in vectors], pa.string())
    table = pa.table({"source": head, "absent": pa.array([v[1] for v in vectors], pa.int64()), "at": pa.array([v[2] for v in vectors], pa.list_(pa.int32())), "share": pa.array([v[3] for v in vectors], pa.list_(pa.uint32()))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zlib.compress(sink.getvalue().to_pybytes(), 1)


def _unpacked(value: bytes, width: int) -> tuple[list[str], np.ndarray]:
    """(sources, dense shares: one row a group)."""
    table = pa.ipc.open_stream(zlib.decompress(value)).read_all()
    absent = table["absent"].to_numpy()
    out = np.repeat(absent[:, None], width, axis=1) if width else np.zeros((len(absent), 0), np.int64)
    for i, (at, share) in enumerate(zip(table["at"], table["share"], strict=True)):
        out[i, at.values.to_numpy(zero_copy_only=False)] = share.values.to_numpy(zero_copy_only=False)
    return table["source"].to_pylist(), out


_ROWS = "lang string, slice long, block long, width int, kind string, source string, item string, value long, vectors binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _ROWS.split(", ")])


def _home(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Of each resident: its vectors, the values of its own pairs, and the first `top` terms of each of its groups."""
    for batch in batches:
        for row in batch.to_pylist():
            at = row["lang"], row["slice"], row["block"]
            terms = [t["term"] for t in row["terms"] or ()]
            place = {t: i for i, t in enumerate(terms)}
            total, kinds = row["total"], row["kinds"]
            whole = shares(np.array([t["all"] for t in row["terms"] or ()], np.int64), total + SMOOTH * kinds) if terms else np.zeros(0, np.int64)
            vectors, rows = [], []
            for g in sorted(row["groups"], key=lambda g: g["source"]):
                size = g["size"] + SMOOTH * kinds
                own = g["own"] or ()
                places = np.array([place[t["term"]] for t in own], np.int32)
                share = shares(np.array([t["n"] for t in own], np.int64), size) if own else np.zeros(0, np.int64)
                absent = int(shares(np.zeros(1, np.int64), size)[0]) if kinds else 0
                order = np.argsort(places)
                vectors.append((g["source"], absent, places[order], share[order].astype(np.uint32)))
                more = share - whole[places] if own else share
                heap = heapq.nsmallest(top, ((-int(f), terms[p].encode(), terms[p]) for f, p in zip(more.tolist(), places.tolist(), strict=True) if f > 0))
                rows += [(*at, len(terms), "term", g["source"], t, -f, None) for f, _, t in heap]
            packed = _packed(vectors)
            sources, dense = _unpacked(packed, len(terms))
            for i in range(len(sources)):
                values = np.abs(dense[i + 1 :] - dense[i]).sum(axis=1)
                rows += [(*at, len(terms), "pair", sources[i], sources[i + 1 + j], v, None) for j, v in enumerate(values.tolist())]
            rows.append((*at, len(terms), "vector", None, None, None, packed))
            yield _rows(rows)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            (mine, a), (theirs, b) = (_unpacked(row[c], row["width"]) for c in ("vectors", "visitor"))
            sums = np.array([np.abs(b - x).sum(axis=1) for x in a])
            i, j = np.indices(sums.shape)
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * sums.size), pa.array([mine[k] for k in i.ravel()]), pa.array([theirs[k] for k in j.ravel()]), pa.array(sums.ravel())], ["lang", "source", "item", "value"])


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, per_slice: int = SLICE, per_block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other sources of its language by distance, and the `top` terms that it has above the language's share.

    Null text, lang and source count as ''. Groups without terms take part with count 0; without kept terms every distance is 0. Rows are documents, repeated ids too: ids are not read, nor are columns other than text, lang and source.
    Ties are in the order of the item's UTF-8. An empty table gives no rows; a language of one source gives no pairs.
    """
    kept = kept_terms(docs, least)
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = durable(groups.join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("size", F.lit(0)).alias("size")))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("size").alias("total"))
    kinds = kept.where("one").groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    langs = langs.join(kinds, "lang", "left").withColumn("kinds", F.coalesce("kinds", F.lit(0)))
    wide = F.greatest(F.lit(per_block), F.ceil(F.sqrt("sources")))
    langs = durable(langs.withColumns({"slices": F.greatest(F.lit(1), F.ceil(F.col("kinds") / per_slice)), "blocks": F.ceil(F.col("sources") / wide)}))
    slice_of = F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice")

    sliced = look_up(kept, langs.select("lang", "slices"), ["lang"]).select("lang", slice_of, "source", "term", "n", "all", "one")
    own = sliced.groupBy("lang", "slice", "source").agg(F.collect_list(F.struct("term", "n")).alias("own"))  # at most a slice's terms
    terms = sliced.where("one").groupBy("lang", "slice").agg(F.sort_array(F.collect_list(F.struct("term", "all"))).alias("terms"))
    seats = look_up(groups, langs, ["lang"]).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    seats = seats.join(own, ["lang", "slice", "source"], "left")
    per = seats.groupBy("lang", "slice", "block").agg(F.collect_list(F.struct("source", "size", "own")).alias("groups"), *[F.first(c).alias(c) for c in ("total", "kinds")])
    homes = durable(per.join(terms, ["lang", "slice"], "left").mapInArrow(lambda b: _home(b, top), _ROWS))

    spark, most = docs.sparkSession, langs.agg(F.max("blocks")).first()[0] or 0
    key = ["lang", "slice", "block"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    resident = look_up(homes.where("kind = 'vector'"), langs.select("lang", "blocks"), ["lang"]).select(*key, "blocks", "width", "vectors").repartition(n, *key).persist(StorageLevel.DISK_ONLY)
    pairs = homes.where("kind = 'pair'").select("lang", "source", "item", "value")
    for turn in range(most if most > 1 else 0):
        to = F.pmod(F.lit(turn) - F.col("block"), F.col("blocks"))
        visitors = resident.where((F.lit(turn) < F.col("blocks")) & (F.col("block") < to)).select("lang", "slice", to.alias("block"), F.col("vectors").alias("visitor"))
        met = resident.join(visitors.repartition(n, *key).hint("shuffle_hash"), key).select("lang", "width", "vectors", "visitor").mapInArrow(_meet, "lang string, source string, item string, value long")
        pairs = pairs.unionByName(durable_in_loop(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))))
    resident.unpersist()

    once = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))  # the distance is the same in both directions
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(rank)).withColumn("part", F.lit("pair"))
    best = homes.where("kind = 'term'").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(best.select(*columns))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
    s AS (SELECT lang, source, sum(n)::HUGEINT AS size FROM c GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(size, 0) + 5 * v) AS p
          FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
    q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q FROM k JOIN v USING (lang)),
    a AS (SELECT x.lang, x.source, y.source AS item, coalesce(sum(abs(px.p - py.p)), 0)::BIGINT AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN p px ON px.lang = x.lang AND px.source = x.source
          LEFT JOIN p py ON py.lang = y.lang AND py.source = y.source AND py.term = px.term GROUP BY ALL),
    b AS (SELECT p.lang, p.source, p.term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM a
    UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM b QUALIFY rank <= 50"""

QUERIES = {"op13_divergence": op13_divergence}
ORACLES = {"op13_divergence": SQL}
