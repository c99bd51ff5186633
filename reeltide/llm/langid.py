"""Language identification with bit-sliced Bloom filters of n-grams.

Training counts n-grams of letters (3 and 4, with word ends, as 64-bit numbers: those of 3 letters exactly, those of 4 hashed) by language; those of a language
that make up RATE of all of its n-grams or more, so at most 1 / RATE of them, go into its Bloom filter. The filters of all languages lie side by side as bit
masks, so one probe (the AND of a few rows) returns every language that has the n-gram. A text's language is that with the most hits, after each
language's expected false hits are taken off.

Scale: a task adds up its counts before it sends them, and they are combined again before their shuffle, so a frequent n-gram or language costs a row a task.
What comes to the driver is at most 1 / RATE n-grams a language; more than LANGUAGES of them are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.llm.common import durable, read
from reeltide.llm.kernels import codepoints, letter_table, mixed

#: An n-gram belongs to a language if it is at least so large a part of the language's n-grams.
RATE = 1e-4
#: A probe reads PROBES rows, each named by ROW_BITS bits of the n-gram's hash.
ROW_BITS, PROBES = 18, 3
#: So many different values of lang are learned at most (32 KB a language of filter, 80 KB of n-grams); a column with more is not one of languages.
LANGUAGES = 4096
#: n-grams that a task holds before it adds them up.
HELD = 1 << 22


def grams(text: str) -> np.ndarray:
    """Hashes of all 3- and 4-grams of folded letters; what lies between words is one space."""
    f = letter_table()[codepoints(text)]
    f = np.concatenate([[0], f, [0]]).astype(np.uint64)
    f = f[1:][(f[1:] > 0) | (f[:-1] > 0)]
    if not f.any():
        return np.zeros(0, np.uint64)
    f = np.concatenate([np.zeros(1, np.uint64), f]) + np.uint64(1)
    three = (f[:-2] << np.uint64(42)) ^ (f[1:-1] << np.uint64(21)) ^ f[2:]
    four = mixed(three[:-1]) + f[3:] if f.size > 3 else np.zeros(0, np.uint64)
    return mixed(np.concatenate([three, four]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task, each n-gram once a language for every HELD of them."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            values, times = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * values.size, pa.string()), pa.array(values.view(np.int64)), pa.array(times)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            own = grams(text.as_py() or "")
            held.setdefault(lang, []).append(own)
            size += own.size
            if size > HELD:
                yield from sent()
                size = 0
    yield from sent()


def rows_of(hashes: np.ndarray) -> list[np.ndarray]:
    """The rows that a probe of each hash reads."""
    mask = np.uint64((1 << ROW_BITS) - 1)
    return [((hashes >> np.uint64(ROW_BITS * j)) & mask).astype(np.int64) for j in range(PROBES)]


def frequent(labelled: DataFrame, rate: float = RATE) -> dict[str, np.ndarray]:
    """By language its n-grams that make up `rate` of all of its or more, from all rows (lang, text)."""
    counts = labelled.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(_counted, "lang string, gram long, n long")
    counts = durable(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    if len(totals.limit(LANGUAGES + 1).collect()) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in column lang")
    many = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= rate * F.col("total")).select("lang", "gram")
    out: dict[str, list[int]] = {}
    for r in many.toLocalIterator():  # at most 1 / rate a language
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.sort(np.array(found, np.int64).view(np.uint64)) for lang, found in sorted(out.items())}


def filters(known: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, masks by row and word of 64 languages, false-hit rate by language)."""
    langs = list(known)
    bits = np.zeros((1 << ROW_BITS, max(1, -(-len(langs) // 64))), np.uint64)
    false = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        for row in rows_of(known[lang]):
            bits[row, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        used = (bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        false[i] = (used.sum() / used.size) ** PROBES
    return langs, bits, false


def learn(labelled: DataFrame, rate: float = RATE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The filters of all languages, from all rows (lang, text)."""
    return filters(frequent(labelled, rate))


def hits_of(hashes: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """For each of n languages how many of the hashes its filter has."""
    rows = rows_of(hashes)
    out = []
    for word in range(bits.shape[1]):
        own = bits[:, word]
        masks = own[rows[0]]
        for row in rows[1:]:
            masks &= own[row]
        out.append(np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64))
    return np.concatenate(out)[:n].astype(np.float64)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], columns: list[str]) -> DataFrame:
    """`columns` of docs with lang_pred and score, for every whole text.

    `und` with score 0 where the text is null or has no letter, or where nothing was learned; ties go to the first language by name. The score
    is the winner's part of all corrected hits.
    """
    langs, bits, false = model
    shared = docs.sparkSession.sparkContext.broadcast((bits, false))
    keep = docs.select(*columns, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema[:-1]) + ", lang_pred string, score double"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, false = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column("__text"):
                own = grams(text.as_py() or "")
                if not own.size or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                hits = sum(hits_of(own[at : at + HELD], bits, len(langs)) for at in range(0, own.size, HELD))
                true = np.maximum(0, (hits - false * own.size) / (1 - np.minimum(false, 0.99)))
                best = int(np.argmax(true))
                names.append(langs[best])
                scores.append(float(true[best] / true.sum()) if true.sum() else 1 / len(langs))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return keep.mapInArrow(told, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Every document's language: doc_id, held_out, lang_pred, score.

    Learned from text and non-null lang of the documents whose crc32(doc_id as text) mod 5 is not 0; the others are held out. A null doc_id
    counts as the empty text and so is held out. Null and empty texts teach nothing; repeated rows count each. An empty table gives no rows.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    base = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = learn(base.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL"))
    return predict(base, model, ["doc_id", "held_out"])


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


QUERIES = {"op9_langid": op9_langid}
ORACLES: dict[str, str] = {}
