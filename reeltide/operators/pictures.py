"""Measures of pictures: rows with planes as bytes, numpy kernels over Arrow batches, one picture (or pair) at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The motion measure's blur.
BLUR = (3571, 16004, 26386, 16004, 3571)


def plane(data: bytes, w: int, h: int, depth: int = 8) -> np.ndarray:
    """A plane as a (h, w) array; more than 8 bits are little-endian 16-bit samples."""
    return np.frombuffer(data, np.uint8 if depth <= 8 else "<u2", count=w * h).reshape(h, w)


def _blurred(x: np.ndarray, axis: int) -> np.ndarray:
    """The 5-tap sum along an axis, the picture mirrored at its edges without repeating them."""
    pad = [(2, 2) if a == axis else (0, 0) for a in range(2)]
    p = np.pad(x, pad, mode="reflect")
    n = x.shape[axis]
    return sum(c * p.take(range(k, k + n), axis=axis) for k, c in enumerate(BLUR))


def motion_sad(before: np.ndarray, now: np.ndarray, depth: int = 8) -> float:
    """Mean absolute value of the blurred difference of two luma planes, at most 10,000."""
    d = before.astype(np.int64) - now.astype(np.int64)
    rows = (_blurred(d, 0) + (1 << (depth - 1))) >> depth
    both = np.abs((_blurred(rows, 1) + 32768) >> 16)
    return min(float(both.sum()) / 256 / d.size, 10000.0)


def squared_error(a: np.ndarray, b: np.ndarray) -> float:
    d = a.astype(np.int64) - b.astype(np.int64)
    return float((d * d).sum())


def black_bars(y: np.ndarray, depth: int = 8, full_range: bool = False) -> tuple[int, int, int, int] | None:
    """(top, bottom, left, right) bars: lines that are black on average, with at most one sample in a hundred well above; None where next to nothing shows."""
    h, w = y.shape
    if w < 32 or h < 32:
        return None
    black = 0 if full_range else 16 << (depth - 8)
    mean, peak = black + (6 << (depth - 8)), black + (24 << (depth - 8))
    v = y.astype(np.int64)

    def dark(axis: int) -> np.ndarray:
        n = v.shape[axis]
        return ((v > peak).sum(axis) <= n // 100) & (v.sum(axis) <= mean * n)

    def run(flags: np.ndarray) -> int:
        lit = np.flatnonzero(~flags)
        return int(lit[0]) if lit.size else int(flags.size)

    rows, cols = dark(1), dark(0)
    top = run(rows)
    bottom = min(run(rows[::-1]), h - top)
    left = run(cols)
    right = min(run(cols[::-1]), w - left)
    if h - top - bottom < h // 8 or w - left - right < w // 8:
        return None
    return top, bottom, left, right


def active_rows(y: np.ndarray) -> tuple[int, int]:
    """[top, bottom) without letterbox rows (no fourth sample above 30), on even rows; all of them if little is left."""
    lit = np.flatnonzero((y[:, ::4] > 30).any(1))
    h = y.shape[0]
    top, bottom = (int(lit[0]), int(lit[-1]) + 1) if lit.size else (h, h)
    return (0, h) if bottom - top < h // 4 else (top & ~1, (bottom + 1) & ~1)


def credit_features(y: np.ndarray, top: int = 0, bottom: int | None = None, black: int = 40, stroke: int = 12) -> tuple[float, float]:
    """(dark, thin): the black share of every second sample, and of the rest the share in runs as thin as strokes with black at both ends."""
    half = y[top : y.shape[0] if bottom is None else bottom : 2, ::2]
    lit = half > black
    edge = np.diff(np.pad(lit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    begin, end = np.argwhere(edge == 1), np.argwhere(edge == -1)
    n = end[:, 1] - begin[:, 1]
    inside = (begin[:, 1] > 0) & (end[:, 1] < half.shape[1])
    total = int(lit.sum())
    thin = int(n[inside & (n <= stroke)].sum())
    return (float((~lit).mean()) if lit.size else 0.0), (thin / total if total else 0.0)


def is_credits(dark: float, thin: float) -> bool:
    return dark >= 0.8 and thin >= 0.6


def thumbnail(y: np.ndarray, w: int = 32, h: int = 18) -> np.ndarray:
    """Box means of a plane."""
    rows = np.add.reduceat(y.astype(np.float64), (np.arange(h) * y.shape[0]) // h, axis=0)
    cells = np.add.reduceat(rows, (np.arange(w) * y.shape[1]) // w, axis=1)
    heights = np.diff(np.r_[(np.arange(h) * y.shape[0]) // h, y.shape[0]])
    widths = np.diff(np.r_[(np.arange(w) * y.shape[1]) // w, y.shape[1]])
    return cells / np.outer(heights, widths)


def measured(df: DataFrame, inputs: list[str], kernel: Callable[..., tuple], columns: str) -> DataFrame:
    """df with the values that `kernel` gives for the columns `inputs` of each row, as new columns; rows of a null input have nulls."""
    made = to_arrow_schema(T._parse_datatype_string(columns))
    names, types, keep = made.names, made.types, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(keep.index(c)) for c in inputs]
            rows = []
            for i in range(batch.num_rows):
                args = [c[i].as_py() for c in cols]
                got = None if any(a is None for a in args) else kernel(*args)
                rows.append(got if got is not None else (None,) * len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], [*keep, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, {columns}")
