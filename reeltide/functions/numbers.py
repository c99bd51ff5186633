"""Scalar rules: rates, tone curves, sizes, run lengths of labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard picture rates, numerator and denominator.
RATES = [(24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (48, 1), (50, 1), (60000, 1001), (60, 1), (100, 1), (120000, 1001), (120, 1)]

#: Rates by the code of a clip's stream entry.
RATE_CODES = {1: (24000, 1001), 2: (24, 1), 3: (25, 1), 4: (30000, 1001), 6: (50, 1), 7: (60000, 1001)}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once, however often `use` refers to it: written out, expressions of expressions grow as a product."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rate_from_duration(ns: Column, within: float = 0.002) -> Column:
    """The standard rate nearest to a picture's duration, num/den as a struct; null where none is nearer than the tolerance."""
    nearest = lambda hz: F.array_min(F.array(*[F.struct(F.abs(hz - n / d) / (n / d), F.lit(i), F.lit(n).alias("num"), F.lit(d).alias("den")) for i, (n, d) in enumerate(RATES)]))
    told = lambda best: F.when(best["col1"] < within, F.struct(best["num"].alias("num"), best["den"].alias("den")))
    return bound(ns, lambda t: F.when(t > 0, bound(bound(F.lit(1e9) / t, nearest), told)))


def rate_from_code(code: Column) -> Column:
    """The rate of a stream entry's code; null for others."""
    out = F.lit(None).cast("struct<num:int,den:int>")
    for c, (n, d) in RATE_CODES.items():
        out = F.when(code == c, F.struct(F.lit(n).alias("num"), F.lit(d).alias("den"))).otherwise(out)
    return out


def picture_rate(stated: Column, timed: Column) -> Column:
    """The timed rate where there is one, else the stated; overruled where both are known and differ. Rates are structs of num and den."""
    known = timed.isNotNull() & (timed["num"] > 0) & (timed["den"] > 0)
    differs = (stated["num"] > 0) & (stated["den"] > 0) & (stated["num"] * timed["den"] != timed["num"] * stated["den"])
    return F.struct(F.when(known, timed["num"]).otherwise(stated["num"]).alias("num"), F.when(known, timed["den"]).otherwise(stated["den"]).alias("den"), (known & F.coalesce(differs, F.lit(False))).alias("overruled"))


def size_bytes(text: Column) -> Column:
    """Bytes of 700M, 4.5GB, 2GiB and the like: K, M, G, T are powers of 1000, KiB and so on of 1024; null if it is no size above 0."""
    form = r"^(\d+(?:\.\d*)?|\.\d+)\s*(?:([KMGT])(iB|B)?|B)?$"
    t = F.upper(F.trim(text))
    part = lambda i: F.regexp_extract(t, "(?i)" + form, i)
    base = F.when(part(3) == "IB", 1024.0).otherwise(1000.0)
    value = F.nullif(part(1), F.lit("")).try_cast("double") * F.pow(base, F.instr(F.lit("KMGT"), part(2)) * (part(2) != "").cast("int"))
    return F.when(value > 0, F.floor(value))


def fit_box(w: Column, h: Column, box_w: int, box_h: int) -> Column:
    """The size a picture takes in a box: its shape kept, both sides even, never larger than it was; a struct of w and h."""
    k = F.least(F.lit(float(box_w)) / w, F.lit(float(box_h)) / h)
    even = lambda v, most: F.least(F.greatest(F.floor(v / 2 + 0.5) * 2, F.lit(2)), F.lit(most & ~1)).cast("int")
    inside = (w <= box_w) & (h <= box_h)
    return F.struct(F.when(inside, w).otherwise(even(w * k, box_w)).cast("int").alias("w"), F.when(inside, h).otherwise(even(h * k, box_h)).cast("int").alias("h"))


def tone_curve(e: Column, source: float, target: float) -> Column:
    """BT.2390's roll-off of PQ values from [0, source] into [0, target]: below the knee unchanged, then a Hermite spline to the target."""
    if source <= target:
        return e
    top = target / source
    knee = 1.5 * top - 0.5
    x = e / source
    t = (F.least(x, F.lit(1.0)) - knee) / (1 - knee)
    bent = (2 * t * t * t - 3 * t * t + 1) * knee + (t * t * t - 2 * t * t + t) * (1 - knee) + (3 * t * t - 2 * t * t * t) * top
    return F.when(x >= knee, bent * source).otherwise(e)


def hlg_scene(e: Column) -> Column:
    """Scene light of a hybrid log-gamma signal (its inverse transfer function)."""
    a, b, c = 0.17883277, 0.28466892, 0.55991073
    return F.when(e <= 0.5, e * e / 3).otherwise((F.exp((e - c) / a) + b) / 12)


def greedy_labels(logits: Column, classes: int) -> Column:
    """Greedy CTC decoding of steps * classes values: the greatest class of each step, repeats merged, class 0 (blank) dropped."""
    steps = F.sequence(F.lit(0), F.floor(F.size(logits) / classes).cast("int") - 1)
    best = F.transform(steps, lambda i: F.array_position(F.slice(logits, i * classes + 1, F.lit(classes)), F.array_max(F.slice(logits, i * classes + 1, F.lit(classes)))) - 1)
    return F.filter(best, lambda x, i: (x != 0) & ((i == 0) | (x != F.try_element_at(best, F.greatest(i, F.lit(1))))))


def curved(n: Column, curve: float) -> Column:
    """Nearness bent by a power within 0 to 1, and going on straight beyond."""
    if curve in (0, 1):
        return n
    return F.when(n <= 0, n).when(n >= 1, 1 + curve * (n - 1)).otherwise(F.pow(n, F.lit(curve)))


def far_limit(v: Column, far: float, knee: float) -> Column:
    """A disparity kept short of `far` behind the screen (below 0): past the knee eased so that it tends to the limit."""
    if far <= 0:
        return v
    x = -v - knee
    return F.when(-v <= knee, v).otherwise(-(knee + x / (1 + x / (far - knee))))
