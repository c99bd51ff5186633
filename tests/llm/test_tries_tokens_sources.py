"""Operators 11 to 13: brute force, the library, SQL, and rows that break things."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from reeltide.llm import convtrie, divergence, tokencount

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string"


def same(df, query, *tables):
    """Whether a DataFrame has the rows of a query in DuckDB."""
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(query)
    assert sorted(want.columns) == sorted(df.columns)
    return sorted(map(str, (tuple(r) for r in df.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


# --- 11 conversation prefix trie


def brute_trie(rows):
    """Nodes by plain dictionaries, level by level."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        base = turns.get(c - int(np.fmod(c, 100)), [])
        path = tuple(base[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        kids = [out[p] for p in out if len(p) == len(path) + 1 and p[:-1] == path]
        saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        sha = hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()
        parent = members[path[:-1]][0] if path else None
        out[path] = (members[path][0], len(path), parent, len(members[path]), len(kids), sum(k[5] for k in kids) or 1, saved + sum(k[6] for k in kids), sha)
    return sorted(map(str, out.values()))


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def made_turns(seed, ids, sizes=(0, 9)):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        for i in range(rng.randrange(*sizes)):
            rows.append((c, rng.choice([i, i, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", None, "", "why " * rng.randrange(1, 4)])))
    return rows


def test_trie_against_sql(spark):
    assert same(convtrie.op11_convtrie(spark, SF), convtrie.SQL, "conversations")


def test_trie_against_brute_force(spark):
    rows = made_turns(1, [*range(0, 60), *range(95, 130), *range(205, 215), -3, -100, -250, None])
    rows += [r for r in rows[:20]] + [(100, 1, "user", "x" * 50_000), (7, 3, "user", "\U0001f600")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS + ", fp string, d int")
    assert told(convtrie.trie(df)) == brute_trie(rows)


def test_colliding_fingerprints_are_split(spark):
    """With two bits of fingerprint nearly every group is wrong at first."""
    rows = made_turns(2, range(0, 40))
    assert told(convtrie.trie(spark.createDataFrame(rows, TURNS), bits=2)) == brute_trie(rows)


def test_a_conversation_of_many_turns_and_a_hot_one(spark):
    rows = [(1, i, "user", f"turn {i % 7}") for i in range(3 * convtrie.CHUNK + 5)] + [(100 * c + 50, i, "user", "the same") for c in range(300) for i in range(3)]
    assert told(convtrie.trie(spark.createDataFrame(rows, TURNS))) == deep_brute_trie(rows)


def deep_brute_trie(rows):
    """brute_trie() for deep tries: nodes by parent and turn."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn, role, text))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    node, members, ends, last = {}, defaultdict(list), defaultdict(list), {0: (None, 0, 0)}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        at = 0
        members[0].append(c)
        for d, turn in enumerate(turns.get(c - c % 100, [])[:h] + turns[c][h:]):
            key = (at, turn)
            if key not in node:
                node[key] = len(node) + 1
                last[node[key]] = (at, d + 1, len(turn[1]))
            at = node[key]
            members[at].append(c)
        ends[at].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for n in sorted(last, reverse=True):
        leaves[n] = leaves[n] or 1
        saved[n] += (len(members[n]) - 1) * last[n][2]
        if n:
            up = last[n][0]
            kids[up] += 1
            leaves[up] += leaves[n]
            saved[up] += saved[n]
    sha = lambda n: hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()
    return sorted(str((members[n][0], last[n][1], members[last[n][0]][0] if n else None, len(members[n]), kids[n], leaves[n], saved[n], sha(n))) for n in last)


def test_ids_are_joined_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "PIECE", 30)
    rows = [(c, 0, "user", "one") for c in range(-40, 400)]
    assert told(convtrie.trie(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert convtrie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert convtrie.trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


# --- 12 token counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def counter(library):
    import json

    content = library.to_str()
    return tokencount.TokenCounter(content, tokencount.whole_tokens(library, json.loads(content)))


def by_library(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_tokens_of_all_documents_as_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in tokencount.op12_tokens(spark, SF).collect():
        n = by_library(library, texts[r.doc_id] or "")
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 2048)


def test_tokens_of_made_texts_as_the_library(library, counter):
    rng = random.Random(5)
    alphabet = "abc DE'''s t m d re ve ll 12½²é ếΑΣσς İıßﬁ!?.,-—…\t\n\x1c\x85  漢字ก็हिन्दी𝒜😀́가Σ"
    for k in range(6000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))
        if k % 5 == 0:
            s = f"it's {s}'LL 've'Re 's's ''t" + rng.choice(["<|endoftext|>", "<|startoftext|>x", "<|endoftext", ""]) + s[:4]
        assert counter.count(s) == by_library(library, s), s


def test_kinds_of_all_code_points(library):
    """What the tables say of every code point that they are sure of is what the library does."""
    kind, low = tokencount.tables()
    points = [c for c in range(0x110000) if kind[c] not in (tokencount.UNSURE, tokencount.SPACE) and unicodedata.is_normalized("NFC", chr(c)) and not unicodedata.combining(chr(c))]
    cut = library.pre_tokenizer.pre_tokenize_str
    for i in range(0, len(points), 128):
        some = points[i : i + 128]
        begins = {at for _, (at, _) in cut(" ".join(f"a{chr(c)}a !{chr(c)}" for c in some))}
        for k, c in enumerate(some):
            told = tokencount.OTHER if 7 * k + 5 not in begins else tokencount.LETTER if 7 * k + 1 not in begins else tokencount.NUMBER
            assert told == kind[c], hex(c)
    for c in points[::7]:
        assert library.normalizer.normalize_str(chr(c)) == chr(low[c])
    spaces = [c for c in range(0x110000) if kind[c] == tokencount.SPACE]
    assert len(cut("a".join(map(chr, spaces)))) == len(spaces) - 1


def test_long_texts_go_in_pieces(library, counter, monkeypatch):
    monkeypatch.setattr(tokencount, "PIECE", 50)
    text = "one two's three  four\n" * 40 + "x" * 500 + " end " + "é " * 30
    assert counter.count(text) == by_library(library, text)
    monkeypatch.setattr(tokencount, "REMEMBERED", 3)
    assert counter.count("qwxz zxqv vvqx xqqz " * 50) == by_library(library, "qwxz zxqv vvqx xqqz " * 50)


def test_tokens_of_odd_rows(spark):
    rows = [("1", None, "a"), ("1", "", "a"), (None, "Hello hello", "b"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, n_tokens string")
    assert sorted(map(str, (tuple(r) for r in tokencount.token_counts(df, limit=1).collect()))) == sorted(map(str, [("1", 0, 0, False), ("1", 0, 0, False), (None, 11, 2, True), (None, 0, 0, False)]))
    assert tokencount.token_counts(df.limit(0)).count() == 0


def test_another_tokenizer_is_refused():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError)):
        tokencount.token_counts(None, public_tokenizers.path("byte_bpe_50k.json"))


# --- 13 source divergence audit


def test_divergence_against_sql(spark):
    assert same(divergence.op13_divergence(spark, SF), divergence.SQL, "documents")


def brute_divergence(rows, least, top):
    count, have, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = (text or "").encode().translate(divergence._TERMS).split()
        groups[lang].add(source)
        count[lang, source].update(words)
        have[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in have[lang].items() if n >= least)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: [1 + 10**9 * (count[lang, s][t] + 5) // (total[s] + 5 * len(kept)) for t in kept] for s in sources}
        q = [1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 5) // (sum(total.values()) + 5 * len(kept)) for t in kept]
        for s in sources:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode(), o) for o in sources if o != s)
            terms = sorted((b - a, t, t.decode()) for a, b, t in zip(p[s], q, kept, strict=True) if count[lang, s][t] and a > b)[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, x, -f, i + 1) for i, (f, _, x) in enumerate(found)]
    return sorted(map(str, out))


@pytest.mark.parametrize("per_slice,per_block", [(4096, 8), (7, 1), (40, 2)])
def test_divergence_against_brute_force(spark, per_slice, per_block):
    """Many slices and blocks: every pair of blocks meets once. Nulls, empty texts, groups without terms, repeated rows, hot groups."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcéü漢") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 12))).upper() if i % 3 else " x-1 ".join(vocab[:4]), rng.choice(["en", "fr", None]), rng.choice(["a"] * 20 + [f"s{k}" for k in range(11)] + [None])) for i in range(300)]
    rows += [(1, None, "en", "empty"), (None, "", None, ""), (2, "?!", "solo", "one"), (3, "y" * 100_000, "en", "a")] + rows[:40]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", term string")
    got = sorted(str(tuple(r)) for r in divergence.divergence(df, least=5, top=6, per_slice=per_slice, per_block=per_block).collect())
    assert got == brute_divergence(rows, 5, 6)


def test_terms_are_cut_in_pieces_and_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 9)
    assert [w for some in divergence.terms_of("Ab cde-F ghié jKLmnopqrstuvw x".encode()) for w in some] == "ab cde f ghié jklmnopqrstuvw x".encode().split()


def test_shares_are_exact():
    counts = np.array([0, 1, 10**6, 9 * 10**12 - 7], np.int64)
    for total in (7, 10**13 + 9, 9 * 10**14):
        some = counts[counts + 5 <= total]
        assert divergence.shares(some, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in some]


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0
