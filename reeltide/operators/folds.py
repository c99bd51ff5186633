"""Rules whose next step depends on their own last choice: clusters, hysteresis, tolerant rankings, greedy picks.

They are not associative, so each key is read in order. Rows are shuffled once on the key, sorted within partitions, and streamed: a task
holds the state of one key and one Arrow batch, however many rows the key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reeltide.operators.ranges import _back

#: step(state, row) -> (state, rows out); end(state) -> rows out. Rows are tuples.
Step = Callable[[object, tuple], tuple[object, list[tuple]]]
End = Callable[[object], list[tuple]]


def fold(df: DataFrame, keys: list[str], order: list, columns: list[str], step: Step, out: str, end: End | None = None) -> DataFrame:
    """Every key's rows read in `order`: step gets the state (None at first) and the values of keys and `columns`; end is called after the last row of a key.

    Values come as they are, nulls as None; rows of a null key are one group.
    """
    names = [*keys, *columns]
    n = len(keys)
    schema = T._parse_datatype_string(out)
    arrow = to_arrow_schema(schema)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[:n] != key:
                    if key is not None and end:
                        rows += end(state)
                    key, state = row[:n], None
                state, more = step(state, row)
                rows += more
            if rows:
                yield told(rows)
        if key is not None and end and (rows := end(state)):
            yield told(rows)

    ready = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*names)
    return ready.mapInArrow(run, schema)


def clusters(df: DataFrame, keys: list[str], order: list[str], t: str, key_frame: str, carry: list[str], target: int, most: int, back: int) -> DataFrame:
    """Cluster numbers from 0, in the order in which rows are interleaved: a new one begins where the age since the cluster's own first time is `most`, or `target`
    at a key frame, or where time runs back by `back`. A null time stays in the open cluster."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def step(state, row):
        at, is_key = row[len(keys)], row[len(keys) + 1]
        if state is None:
            state = (0, at)
        elif state[1] is None:
            state = (state[0], at)
        elif at is not None:
            age = at - state[1]
            if age >= most or age <= -back or (is_key and age >= target):
                state = (state[0] + 1, at)
        return state, [(*row[: len(keys)], *row[len(keys) + 2 :], state[0])]

    out = ", ".join(f"{c} {types[c]}" for c in [*keys, *carry]) + ", cluster bigint"
    return fold(df, keys, order, [t, key_frame, *carry], step, out)


def held_flag(df: DataFrame, keys: list[str], order: list[str], flag: str, fresh: str, hold: int, out: str) -> DataFrame:
    """df with the flag that holds: that of the last row that ends `hold` equal flags in a row, else that of the first row since a fresh one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    up_to = (Window.unboundedPreceding, 0)
    d = df.withColumn("_part", F.sum(F.coalesce(F.col(fresh), F.lit(False)).cast("int")).over(w.rowsBetween(*up_to)))
    part = Window.partitionBy(*keys, "_part").orderBy(*order)
    d = d.withColumn("_run", F.sum((~F.col(flag).eqNullSafe(F.lag(flag).over(part))).cast("int")).over(part.rowsBetween(*up_to)))
    d = d.withColumn("_length", F.row_number().over(Window.partitionBy(*keys, "_part", "_run").orderBy(*order)))
    held = F.last(F.when(F.col("_length") >= hold, F.col(flag)), ignorenulls=True).over(part.rowsBetween(*up_to))
    return d.withColumn(out, F.coalesce(held, F.first(flag).over(part.rowsBetween(*up_to)))).drop("_run", "_length")


def hysteresis(df: DataFrame, keys: list[str], order: list[str], flag: str, fresh: str, carry: list[str], hold: int, ease: int) -> DataFrame:
    """The factor of each row: 1, or 0 while `flag` has held; a change needs `hold` agreeing rows and is eased by 1 / ease a row; a fresh row takes its own flag.

    Along a stretch in which the same flag holds the factor goes in steps to 0 or 1 and stays there, so only one row a stretch is read in order: how long it is decides what the next one begins with. `flag` is not null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    n = len(keys)
    d = held_flag(df, keys, order, flag, fresh, hold, "_flat")
    part = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    turned = F.col("_flat") != F.lag("_flat").over(Window.partitionBy(*keys, "_part").orderBy(*order))
    d = d.withColumn("_stretch", F.sum(F.coalesce(turned, F.lit(False)).cast("int")).over(part))
    by = [*keys, "_part", "_stretch"]
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    stretches = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.first("_flat").alias("_flat"))

    def step(state, row):
        part, stretch, rows, flat = row[n:]
        first = (0 if flat else ease) if stretch == 0 else state
        return min(ease, max(0, first + (-rows if flat else rows))), [(*row[: n + 2], first)]

    form = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", _part bigint, _stretch bigint, _first int"
    first = fold(stretches, keys, ["_part", "_stretch"], ["_part", "_stretch", "_rows", "_flat"], step, form)
    met = _back(d, first, by)
    steps = F.greatest(F.lit(0), F.least(F.lit(ease), F.col("_first") + F.when(F.col("_flat"), -F.col("_k")).otherwise(F.col("_k"))))
    return met.select(*keys, *carry, (steps / F.lit(float(ease))).alias("factor"))


def tolerant_best(df: DataFrame, keys: list[str], name: str, length: str, chapters: str, items: str, tolerance: float, other: str | None = None) -> DataFrame:
    """Of each key the title that a scan in the order of `name` ends with: longer by more than `tolerance` wins, else more chapters, fewer items, the lower name.

    `other`, a boolean column, marks titles that carry more than is asked for (3D ones where 2D is): after chapters and before items, those without it win.

    The comparison is not transitive, so the result is that of the scan, not of a sort.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    n = len(keys)

    def better(a, b) -> bool:
        if abs(a[1] - b[1]) > tolerance:
            return a[1] > b[1]
        if a[2] != b[2]:
            return a[2] > b[2]
        if other and bool(a[4]) != bool(b[4]):
            return not a[4]
        if a[3] != b[3]:
            return a[3] < b[3]
        return a[0] < b[0]

    def step(state, row):
        now = row[n:]
        return (row[:n], now if state is None or better(now, state[1]) else state[1]), []

    out = ", ".join(f"{c} {types[c]}" for c in [*keys, name])
    return fold(df, keys, [name], [name, length, chapters, items, *([other] if other else [])], step, out, lambda s: [(*s[0], s[1][0])])


def separated_top(df: DataFrame, keys: list[str], order: list, t: str, carry: list[str], k: int, apart: int) -> DataFrame:
    """The best k rows of each key in `order`, each at least `apart` from those taken before it, with their rank."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def step(state, row):
        taken = state or ()
        at = row[len(keys)]
        if len(taken) >= k or any(abs(at - x) < apart for x in taken):
            return taken, []
        return (*taken, at), [(*row[: len(keys)], *row[len(keys) + 1 :], len(taken) + 1)]

    out = ", ".join(f"{c} {types[c]}" for c in [*keys, *carry]) + ", place int"
    return fold(df, keys, order, [t, *carry], step, out)


def merged_extents(df: DataFrame, keys: list[str], order: list[str], block: str, length: str, sector: int, most: int) -> DataFrame:
    """Extents joined to the one before if that ends on a sector, is adjacent, and the sum is at most `most`: keys, extent, block, length, parts."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    n = len(keys)

    def told(state):
        return [(*state[0], *state[1:])]

    def step(state, row):
        at, size = row[n], row[n + 1]
        if state is None:
            return (row[:n], 0, at, size, 1), []
        _, number, start, held, parts = state
        if held % sector == 0 and start + held // sector == at and held + size <= most:
            return (row[:n], number, start, held + size, parts + 1), []
        return (row[:n], number + 1, at, size, 1), told(state)

    out = ", ".join(f"{c} {types[c]}" for c in keys) + ", extent int, block bigint, length bigint, parts int"
    return fold(df, keys, order, [block, length], step, out, told)


def joined_clips(df: DataFrame, keys: list[str], order: list[str], nominal: str, first: str, last: str, step_: str) -> DataFrame:
    """Each clip's shift on the joined timeline: the greater of the nominal one and what puts its first time a step after the last shifted time before it."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    n = len(keys)

    def step(state, row):
        want, begin, stop, apart = row[n : n + 4]
        shift = want if state is None else max(want, state + apart - begin)
        return stop + shift, [(*row[:n], *row[n + 4 :], shift)]

    out = ", ".join(f"{c} {types[c]}" for c in [*keys, *order]) + ", shift bigint"
    return fold(df, keys, order, [nominal, first, last, step_, *order], step, out)


def sync_points(df: DataFrame, keys: list[str], t: str, carry: list[str], jump: int, every: int) -> DataFrame:
    """Rows that get a sync point: the first of a key, after a jump, where time runs back, or `every` after the last sync point."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    n = len(keys)

    def step(state, row):
        at = row[n]
        mark = state is None or at - state[0] > jump or at < state[0] or at - state[1] >= every
        out = [(*row[:n], *row[n + 1 :])] if mark else []
        return (at, at if mark else state[1]), out

    out = ", ".join(f"{c} {types[c]}" for c in [*keys, *carry])
    return fold(df, keys, carry, [t, *carry], step, out)
