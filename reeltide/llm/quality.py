"""Quality classifier with hierarchical empirical Bayes.

A logistic model over features of the text's form, fitted on a bounded sample of labelled documents, gives each document's own evidence.
Labelled outcomes, and the model's probabilities where there is no label, are summed by host and by path; posteriors of a path are
shrunk to those of its host, hosts to the whole, with strengths fitted by moments. The document's odds are its own evidence times the odds of its path.
The host of a document is its source, its path the pair of source and language: the tables here have no URLs; who has them gives host and path in these columns.
A labelled document is one of those its path's rate is made of.

Scale: the text is read in one map; afterwards rows are narrow, and sums by path are combined before they are shuffled. The table
of paths is broadcast only up to a checked number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reeltide.llm.common import durable, look_up, read, strength
from reeltide.llm.kernels import codepoints, words

#: At most so many labelled documents are fitted, those with the least hash of their id.
SAMPLE = 20_000
#: A document is kept unless its posterior of being good is below this.
KEEP = 0.5

_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    """0 white space, 1 lower case or caseless letter, 2 upper case, 3 digit, 4 sentence punctuation, 5 other, by code point."""
    global _CLASSES
    if _CLASSES is None:
        out = np.full(0x110000, 5, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isspace():
                out[i] = 0
            elif c.isupper():
                out[i] = 2
            elif c.isalpha():
                out[i] = 1
            elif c.isdigit():
                out[i] = 3
        for c in ".,;:!?'\"()-¡¿’“”、。":
            out[ord(c)] = 4
        _CLASSES = out
    return _CLASSES


def features(text: str) -> np.ndarray:
    """Twelve numbers about the form of a text; an empty text has zeros."""
    out = np.zeros(12)
    if not text:
        return out
    cp = codepoints(text)
    c = _classes()[cp]
    n = np.bincount(c, minlength=6)
    seen = max(1, cp.size - n[0])
    letters = max(1, n[1] + n[2])
    h, begin, end = words(cp)
    count = max(1, h.size)
    values, times = np.unique(h, return_counts=True)
    pair = h[1:] * np.uint64(3) + h[:-1]
    lines = text.split("\n")
    out[0] = n[2] / letters
    out[1] = n[3] / seen
    out[2] = n[5] / seen
    out[3] = n[4] / seen
    out[4] = np.log1p(h.size)
    out[5] = min(30.0, float((end - begin).sum() / count))
    out[6] = values.size / count**0.9 if h.size else 0
    out[7] = times.max() / count if h.size else 0
    out[8] = np.unique(pair).size / max(1, pair.size)
    out[9] = float(h.size > 1 and (h[1:] == h[:-1]).mean())
    out[10] = 1 - len(set(lines)) / len(lines)
    out[11] = np.log1p(cp.size / len(lines))
    return out


def _weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the intercept last) of a ridge logistic model with squares, by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = _design(x, mean, scale)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -4, 4)
    return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)


def _map_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py() or "").tolist() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("quality"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def known(labels: DataFrame) -> DataFrame:
    """One row a labelled document: doc_id, quality (0 if any of its labels is 0)."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """The model (means, scales, weights, share of good documents in the sample); None if the labels have not both outcomes."""
    chosen = known(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded
    each = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_map_features, "doc_id string, quality int, x array<double>")
    rows = each.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("r.*").collect()  # one an id, so at most `sample`
    rows.sort(key=lambda r: (r["quality"], r["x"]))
    y = np.array([float(r["quality"] > 0) for r in rows])
    if not rows or y.min() == y.max():
        return None
    return *_weights(np.array([r["x"] for r in rows]), y), float(y.mean())


def with_evidence(docs: DataFrame, model, columns: list[str], out: str) -> DataFrame:
    """`columns` of docs and `out`: the log likelihood ratio of good to not good by the text; 0 without a model."""
    fields = [docs.schema[c] for c in columns]
    schema = T.StructType([*fields, T.StructField(out, T.DoubleType())])
    plain = docs.select(*columns, *([] if "text" in columns else ["text"]))
    names = plain.columns

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text"))
            if model is None:
                got = np.zeros(batch.num_rows)
            else:
                mean, scale, w, share = model
                x = np.array([features(t.as_py() or "") for t in texts]).reshape(-1, 12)
                got = np.clip(_design(x, mean, scale) @ w, -30, 30) - np.log(share / (1 - share))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in columns), pa.array(got)], [*columns, out])

    return plain.mapInArrow(told, schema)


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def paths(scored: DataFrame, labels: DataFrame, share: float) -> DataFrame:
    """(doc_id, source, lang, llr) -> posteriors by path: source, lang, host_rate, path_rate.

    A document counts as its label, if it has one, else as the model's probability. Null sources and languages are groups like any other.
    """
    base = float(np.log(share / (1 - share)))
    counted = scored.join(known(labels), "doc_id", "left")
    good = F.coalesce((F.col("quality") > 0).cast("double"), 1 / (1 + F.exp(-(F.col("llr") + base))))
    leaf = durable(counted.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("bad")))
    whole = leaf.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = ((whole["bad"] or 0) + 1) / ((whole["n"] or 0) + 2)
    hosts = leaf.groupBy("source").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k = strength(hosts, F.lit(rate))
    hosts = hosts.select(F.col("source").alias("_source"), ((F.col("bad") + k * rate) / (F.col("n") + k)).alias("host_rate"))
    both = leaf.join(hosts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    k = strength(both, F.col("host_rate"))
    return both.select("source", "lang", "host_rate", ((F.col("bad") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))


def judge(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Every document's verdict: doc_id, source, lang, evidence, host_rate, path_rate, posterior, keep.

    A null text counts as empty; empty texts have a form like any other. Rows with the same id are judged each. Without labels of both kinds every text's
    evidence is 0. An empty table gives no rows. Columns other than doc_id, text, source and lang are not read.
    """
    model = fit(docs, labels)
    scored = durable(with_evidence(docs, model, ["doc_id", "source", "lang"], "llr"))
    told = _join(scored, paths(scored, labels, model[3] if model else 0.5), "llr")
    return told.select("doc_id", "source", "lang", F.col("llr").alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= keep).alias("keep"))


def _join(rows: DataFrame, groups: DataFrame, llr: str) -> DataFrame:
    """rows with host_rate, path_rate and posterior, by source and lang (null is equal to null)."""
    key = lambda: F.to_json(F.array(F.col("source").cast("string"), F.col("lang").cast("string")), {"ignoreNullFields": "false"})
    told = look_up(rows.withColumn("__path", key()), groups.select(key().alias("__path"), "host_rate", "path_rate"), ["__path"])
    return told.drop("__path").withColumn("posterior", 1 / (1 + F.exp(-(F.col(llr) + _odds(F.col("path_rate"))))))


def good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """docs without those of a posterior below `keep`; all their columns, none else. The text is read twice, and never shuffled.

    Rows with null or empty texts, null ids and repeated rows are judged as judge() does; an empty table stays empty.
    """
    model = fit(docs, labels)
    scored = durable(with_evidence(docs, model, ["doc_id", "source", "lang"], "llr"))
    groups = paths(scored, labels, model[3] if model else 0.5)
    taken = set(docs.columns)
    llr = "__llr"
    while llr in taken:
        llr += "_"
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    renamed = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c in ("host_rate", "path_rate", "posterior", "__path")}
    own = own.withColumnsRenamed(renamed)
    told = _join(with_evidence(own, model, own.columns, llr), groups, llr)
    kept = told.where(F.col("posterior") >= keep)
    return kept.select(*[F.col(renamed.get(c, c)).alias(c) for c in docs.columns])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
