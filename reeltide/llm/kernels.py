"""Text as arrays: folded code points, word hashes and shingles, one whole document at a time."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def fold_table() -> np.ndarray:
    """For each code point its lower case if it belongs to a word (letters, digits, marks), else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] in "LNM":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


@functools.cache
def letter_table() -> np.ndarray:
    """fold_table() for letters only."""
    out = fold_table().copy()
    for i in np.flatnonzero(out):
        if unicodedata.category(chr(i))[0] != "L":
            out[i] = 0
    return out


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the input moves about half of the bits of the output."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Code points whose running sums are held at once; longer runs are added up in pieces.
PIECE = 1 << 18


@functools.cache
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2**64, PIECE of each and one more."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(PIECE, x))]) for x in (_ODD, _ODD_INVERSE))


def powers(n: int) -> np.ndarray:
    """The first n powers, of at most PIECE."""
    return _power_tables()[0][:n]


def _run_sums(f: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each run the sum of f[begin + i] * _ODD**i modulo 2**64, from differences of running sums."""
    up, down = _power_tables()
    out = np.zeros(begin.size, np.uint64)
    total = np.zeros(min(PIECE, f.size) + 1, np.uint64)
    for at in range(0, f.size, PIECE):
        piece = f[at : at + PIECE].astype(np.uint64)
        piece *= up[: piece.size]
        np.cumsum(piece, out=total[1 : piece.size + 1])
        i, j = np.searchsorted(end, at, "right"), np.searchsorted(begin, at + piece.size, "left")
        if at == 0 and piece.size == f.size:
            return (total[end] - total[begin]) * down[begin]
        b, e = np.maximum(begin[i:j] - at, 0), np.minimum(end[i:j] - at, piece.size)
        own = (total[e] - total[b]) * down[b]
        late = np.flatnonzero(begin[i:j] < at)  # at most one run, which goes on from the piece before
        for k in late.tolist():
            own[k : k + 1] *= np.uint64(pow(int(_ODD), int(at - begin[i + k]), 1 << 64))
        out[i:j] += own
    return out


def words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of each run of word characters, without regard to case; positions are code points."""
    f = fold_table()[cp]
    inside = np.zeros(f.size + 2, bool)
    np.not_equal(f, 0, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    if not begin.size:
        return np.zeros(0, np.uint64), begin, end
    return mixed(_run_sums(f, begin, end) + (end - begin).astype(np.uint64)), begin, end


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of every k words in a row; a text of fewer words is one shingle of all of them."""
    n = h.size
    if not n:
        return h
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out *= _ODD
        out += h[j : n - k + 1 + j]
    return mixed(out + np.uint64(k))


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each value came before in the array."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]] if s.size else np.zeros(0, bool)
    first = np.flatnonzero(new)
    rank = np.arange(s.size) - np.repeat(first, np.diff(np.r_[first, s.size]))
    out = np.empty(s.size, np.int64)
    out[order] = rank
    return out


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same in every run."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) | np.uint64(1)
