"""Signals along a clock: smoothed ranges, decimation, ramps between stretches.

Each works on ranges of the order (`bucket`, a column that never falls along it), so that one long key is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reeltide.operators import asof
from reeltide.operators.folds import fold
from reeltide.operators.ranges import _back, numbered


def indexed_bounds(values: str, every: int, share: int) -> tuple[Column, Column]:
    """Of every `every`-th value of an array, sorted, the one a `share`-th from the least and the one as far from the greatest."""
    some = F.array_sort(F.filter(values, lambda _, i: i % every == 0))
    n = F.size(some)
    off = F.floor(n / share).cast("int")
    return F.element_at(some, off + 1).cast("double"), F.element_at(some, n - off).cast("double")


def smoothed(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, str], share: float, carry: list[str]) -> DataFrame:
    """keys, carry, and each value (name -> name in the result) smoothed along the key: the first is taken as it is, of every other one `share` of the way is gone.

    A step is the affine map y -> (1 - share) * y + share * x, and maps compose: every bucket is scanned for itself from 0 with the weight that what came before still has, the buckets' ends are
    chained over one row a bucket, and each row adds its weight times what came into its bucket. Rows with a null value are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    n, keep, names = len(values), 1 - share, [*keys, "_bucket", *carry]
    rows = df.where(" AND ".join(f"`{v}` IS NOT NULL" for v in values)).withColumn("_bucket", bucket.cast("long"))
    rows = rows.withColumns({v: F.col(v).cast("double") for v in values})
    shift = len(keys) + 1

    def inside(state, row):
        x = row[shift + len(carry) :]
        place, weight, sums = state or (0, 1.0, [0.0] * n)
        state = (place + 1, weight * keep, [keep * s + share * v for s, v in zip(sums, x, strict=True)])
        return state, [(*row[: shift + len(carry)], *x, state[0], state[1], *state[2])]

    form = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in names) + "".join(f", _x{i} double" for i in range(n)) + ", _n bigint, _w double" + "".join(f", _s{i} double" for i in range(n))
    local = fold(rows, [*keys, "_bucket"], order, [*carry, *values], inside, form)
    first, last = F.array(*[f"_x{i}" for i in range(n)]), F.struct("_w", F.array(*[f"_s{i}" for i in range(n)]).alias("s"))
    ends = local.groupBy(*keys, "_bucket").agg(F.min_by(first, "_n").alias("_first"), F.max_by(last, "_n").alias("_last")).select(*keys, "_bucket", "_first", F.col("_last._w").alias("_w"), F.col("_last.s").alias("_s"))

    def over(state, row):
        first, weight, sums = row[len(keys) + 1 :]
        into = state or first
        return [weight * y + s for y, s in zip(into, sums, strict=True)], [(*row[: len(keys) + 1], into)]

    into = fold(ends, keys, ["_bucket"], ["_bucket", "_first", "_w", "_s"], over, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", _bucket bigint, _into array<double>")
    both = _back(local, into, [*keys, "_bucket"])
    return both.select(*keys, *carry, *[(F.col("_w") * F.col("_into")[i] + F.col(f"_s{i}")).alias(out) for i, out in enumerate(values.values())])


def low_pass(factor: int, half: int = 32, edge: float = 20_000 / 48_000) -> np.ndarray:
    """The taps of a windowed sinc (Blackman) that keeps what is below `edge` of the output's rate; they sum to 1."""
    n = 2 * half * factor
    x, cut = np.arange(n + 1) - n // 2, edge / factor
    phase = 2 * np.pi * np.arange(n + 1) / n
    taps = 2 * cut * np.sinc(2 * cut * x) * (0.42 - 0.5 * np.cos(phase) + 0.08 * np.cos(2 * phase))
    return taps / taps.sum()


def decimated(df: DataFrame, keys: list[str], order: list, bucket: Column, value: str, factor: int, taps: np.ndarray, out: str, block: int = 1 << 14) -> DataFrame:
    """keys, place, out: every `factor`-th row of a key, filtered over as many rows up to it as there are taps; before the first row, and where it is null, the value is 0.

    Rows are numbered in two levels and cut into blocks by number; each block also gets the last rows of the one before, as many as the filter reaches back.
    """
    reach, block = taps.size - 1, max(block, taps.size)
    placed = numbered(df, keys, order, bucket, "_n").select(*keys, "_n", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    own = F.expr(f"_n div {block}")
    both = F.when(F.col("_n") % block >= block - reach, F.array(own, own + 1)).otherwise(F.array(own))
    blocks = placed.withColumn("_b", F.explode(both)).groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("_n", "_v"))).alias("_r"))
    blocks = blocks.select(*keys, "_b", F.col("_r._n").alias("_n"), F.col("_r._v").alias("_v"))
    schema = blocks.select(*keys).schema.add("place", "long").add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b, n, v = batch.column("_b")[i].as_py(), batch.column("_n")[i].values.to_numpy(), batch.column("_v")[i].values.to_numpy()
                begin = b * block - reach
                x = np.zeros(int(n[-1]) - begin + 1)
                x[n - begin] = v
                at = np.arange(b * block + (factor - 1 - b * block) % factor, int(n[-1]) + 1, factor)
                if at.size:
                    y = np.lib.stride_tricks.sliding_window_view(x, taps.size)[at - reach - begin] @ taps
                    same = [pa.array([batch.column(k)[i].as_py()] * at.size, batch.schema.field(k).type) for k in keys]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(at // factor), pa.array(y)], [*keys, "place", out])

    return blocks.mapInArrow(run, schema)


def ramped(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, line: str, value: str, ramp: str, base: float, width: int, tick: int = 1, out: str = "shape") -> DataFrame:
    """points with the value in force: that of the last listed span [start, end) that contains them (end 0 is open), else `base`.

    Over the first `ramp` of a span the value goes in a line from what was in force a tick before its start to its own; ramps are not laid on ramps, as what was in force is the value of a span. `line` is unique within keys.
    """
    begins = spans.select(*keys, (F.col(start) - tick).alias(t), F.col(line).alias("_of"))
    was = asof.interval_last(begins, spans, keys, t, start, end, line, width).select(*keys, "_of", F.col(line).alias("_was"))
    known = spans.select(*keys, F.col(line).alias("_of"), F.col(start).alias("_start"), F.col(ramp).alias("_ramp"), F.col(value).cast("double").alias("_to"))
    values = known.select(*keys, F.col("_of").alias("_was"), F.col("_to").alias("_from"))
    known = known.join(was, [*keys, "_of"], "left").join(values, [*keys, "_was"], "left")
    found = asof.interval_last(points, spans, keys, t, start, end, line, width).withColumnRenamed(line, "_of")
    both = found.join(known.drop("_was"), [*keys, "_of"], "left")
    first = F.coalesce("_from", F.lit(base))
    share = (F.col(t) - F.col("_start")) / F.col("_ramp")
    now = F.when(F.col("_to").isNull(), F.lit(base)).when((F.col("_ramp") > 0) & (F.col(t) - F.col("_start") < F.col("_ramp")), first + share * (F.col("_to") - first)).otherwise(F.col("_to"))
    return both.withColumn(out, now).select(*points.columns, F.col("_of").alias(line), out)
