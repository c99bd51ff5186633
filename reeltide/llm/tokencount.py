"""Token counts by whole tokens: most words of a text are one entry of the vocabulary, only the rest is merged.

Offline, on the driver, every string of the vocabulary that ends a word is encoded alone by the library; those that come out as one token are proved
*whole*. In the map a text is cut into the tokenizer's pre-tokens with numpy (white space, letters, single numbers, other runs, English contractions); a whole
one counts 1, any other is merged once by the library and remembered. What the cut cannot be sure of goes to the library as it is: text that is not in NFC, and code points
that Python's Unicode tables do not know or whose lower case is not one code point. Strings of special tokens are one token each, as the library has it by default.

Scale: one map, no shuffle; the tokenizer's file is read by the driver and goes to the tasks (under 2 MB). Texts are worked on in pieces that end at a blank, so the state of a task is
one piece, its words, and at most REMEMBERED words beside the vocabulary.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.llm.common import read
from reeltide.llm.kernels import codepoints

#: Code points worked on at once, words remembered beside the vocabulary, and the greatest count that is not over the limit.
PIECE, REMEMBERED, LIMIT = 1 << 20, 1_000_000, 2048
#: Kinds of code points: white space, letters, numbers, others, and those left to the library.
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
#: Fixed values, dictated by the tokenizer's file: the pattern that this module cuts by, its contractions, and its normalizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ONE, TWO = "stmd", ("re", "ve", "ll")
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower case) of every code point."""
    kind, low = np.full(0x110000, OTHER, np.uint8), np.arange(0x110000, dtype=np.uint32)
    kinds = {"L": LETTER, "N": NUMBER}
    for i in range(0x110000):
        c = chr(i)
        category = unicodedata.category(c)
        lower = c.lower()
        if category in ("Cn", "Cs") or len(lower) != 1:
            kind[i] = UNSURE
        else:
            kind[i], low[i] = kinds.get(category[0], OTHER), ord(lower)
    kind[WHITE] = SPACE
    return kind, low


def pre_tokens(text: str) -> list[str] | None:
    """The pre-tokens of a text in lower case, in order; None where only the library can tell."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        return None
    cp = codepoints(text)
    kinds, lows = tables()
    kind = kinds[cp]
    if not text.isascii() and (kind == UNSURE).any():
        return None
    at = np.flatnonzero(kind != SPACE)
    if not at.size:
        return []
    kept, low = kind[at], lows[cp[at]]
    start = np.ones(at.size, bool)
    start[1:] = (kept[1:] != kept[:-1]) | (kept[1:] == NUMBER) | (np.diff(at) > 1)
    for i in np.flatnonzero(start & (low == 0x27)).tolist():  # an apostrophe that begins a run, before letters
        if i + 1 >= at.size or kept[i + 1] != LETTER or at[i + 1] != at[i] + 1:
            continue
        two = "".join(map(chr, low[i + 1 : i + 3])) if i + 2 < at.size and not start[i + 2] else ""
        size = 1 if chr(low[i + 1]) in ONE else 2 if two in TWO else 0
        if size:
            start[i + 1] = False
            if i + 1 + size < at.size:
                start[i + 1 + size] = True
    out = np.full(at.size + int(start.sum()), 0x20, np.uint32)
    out[np.arange(at.size) + np.cumsum(start)] = low
    return out.tobytes().decode("utf-32-le", "surrogatepass")[1:].split(" ")


def whole_tokens(tokenizer: Any, spec: dict) -> list[str]:
    """The words that are proved to encode alone as one token; refuses a tokenizer of another form."""
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    if split != PATTERN or [n["type"] for n in spec["normalizer"]["normalizers"]] != NORMALIZERS or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("this tokenizer cuts texts in another way than this module")
    suffix = spec["model"]["end_of_word_suffix"]
    letters = byte_letters()
    words = []
    for entry in spec["model"]["vocab"]:
        if entry.endswith(suffix) and all(c in letters for c in entry[: -len(suffix)]):
            try:
                words.append(bytes(letters[c] for c in entry[: -len(suffix)]).decode())
            except UnicodeDecodeError:
                continue
    words = [w for w in words if pre_tokens(w) == [w]]
    return [w for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1]


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte: itself if it is printable in Latin-1, else the next one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class TokenCounter:
    """How many tokens a text has; holds the tokenizer, the whole words and what was merged before."""

    def __init__(self, content: str, whole: list[str]) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.model = self.tokenizer.model
        self.letter = {b: c for c, b in byte_letters().items()}
        self.whole = dict.fromkeys(whole, 1)
        self.cost = dict(self.whole)
        special = [t["content"] for t in json.loads(content)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def by_library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merge(self, words: list[str]) -> None:
        """Adds the words, none of which is known, to what is remembered."""
        if len(self.cost) > len(self.whole) + REMEMBERED:
            self.cost = dict(self.whole)
        for w in words:
            self.cost[w] = len(self.model.tokenize("".join(map(self.letter.__getitem__, w.encode()))))

    def words(self, text: str) -> int:
        found = pre_tokens(text)
        if found is None:
            return self.by_library(text)
        get = self.cost.get
        costs = list(map(get, found))
        if None in costs:
            unknown = [w for w, c in zip(found, costs, strict=True) if c is None]
            self.merge(list(dict.fromkeys(unknown)))
            return sum(c for c in costs if c is not None) + sum(map(self.cost.__getitem__, unknown))
        return sum(costs)

    def piece(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.words(text)
        return sum(1 for _ in self.special.finditer(text)) + sum(self.words(x) for x in self.special.split(text) if x)

    def count(self, text: str) -> int:
        total = at = 0
        while len(text) - at > PIECE:
            end = text.find(" ", at + PIECE)
            if end < 0:
                break
            total, at = total + self.piece(text[at:end]), end
        return total + self.piece(text[at:] if at else text)


@functools.lru_cache(maxsize=1)
def counter_of(content: str, whole: tuple[str, ...]) -> TokenCounter:
    """One counter a worker process, whose remembered words serve all of its tasks."""
    return TokenCounter(content, list(whole))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens, over_limit (more than `limit`) of every row, by the tokenizers file at `path` (default: word_bpe_49k.json of public_tokenizers).

    Counts are those of the library's encode without added special tokens. A null text counts as empty (0, 0, false). Rows are told one by one: ids may be null, repeated
    and of any type; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        content = f.read()
    whole = tuple(whole_tokens(Tokenizer.from_str(content), json.loads(content)))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter = counter_of(content, whole)
            counts = pa.array([counter.count(x.as_py()) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(told, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


QUERIES = {"op12_tokens": op12_tokens}
ORACLES: dict[str, str] = {}
