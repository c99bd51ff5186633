"""Pictures aligned by their thumbnails: of the reference's pictures within a span of time the one with the least distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reeltide.operators.ranges import _back


def aligned(ours: DataFrame, reference: DataFrame, keys: list[str], t: str, ident: str, vector: str, span: int, out: str, block: int = 256) -> DataFrame:
    """ours (keys, ident) with `out` (the reference's ident), `out`_t and distance: the least sum of absolute differences of vectors among reference rows at most `span` away, on a tie the earlier, then the lower ident; null where none is near.

    Both sides are cut into buckets of time of the span's width and those into blocks of about `block` vectors; blocks of the same or neighbouring buckets meet, are compared as matrices, and leave one row a picture of ours. So no pair of pictures ever is a row, and a dense
    bucket is as many tasks as it has pairs of blocks.
    """
    width = max(1, span)

    def blocks(rows: DataFrame, near: bool, name: str) -> DataFrame:
        b = F.floor(F.col(t) / width)
        rows = rows.where(F.col(vector).isNotNull() & F.col(t).isNotNull()).select(*keys, F.col(t).cast("long").alias("t"), F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v"), b.alias("_b"))
        sizes = rows.groupBy(*keys, "_b").agg(F.ceil(F.count(F.lit(1)) / block).alias("_k"))
        rows = _back(rows, sizes, [*keys, "_b"]).withColumn("_piece", F.pmod(F.xxhash64("i"), F.col("_k")))
        packed = rows.groupBy(*keys, "_b", "_piece").agg(F.collect_list(F.struct("t", "i", "v")).alias(name)).drop("_piece")
        return packed.withColumn("_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))) if near else packed

    met = blocks(ours, False, "xs").join(blocks(reference, True, "ys"), [*keys, "_b"]).select(*keys, "xs", "ys")
    kinds = {f.name: f.dataType for f in ours.schema}
    schema = ours.select(*keys).schema.add("i", kinds[ident]).add("d", "double").add("rt", "long").add("ri", reference.schema[ident].dataType)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (tx, ix, x), (ty, iy, y) = ([s.field(f) for f in ("t", "i", "v")] for s in (batch.column(c)[k].values for c in ("xs", "ys")))
                tx, ty = tx.to_numpy(), ty.to_numpy()
                x, y = (np.array(v.to_pylist(), float) for v in (x, y))
                order = sorted(range(ty.size), key=lambda j: (ty[j], iy[j].as_py()))  # so that the first of equal distances is the one asked for
                ty, y, iy = ty[order], y[order], iy.take(pa.array(order))
                best, place = np.full(tx.size, np.inf), np.zeros(tx.size, np.int64)
                for i in range(tx.size):
                    d = np.where(np.abs(ty - tx[i]) <= span, np.abs(y - x[i]).sum(axis=1), np.inf)
                    place[i] = d.argmin()
                    best[i] = d[place[i]]
                ok = np.flatnonzero(np.isfinite(best))
                same = [pa.array([batch.column(c)[k].as_py()] * ok.size, batch.schema.field(c).type) for c in keys]
                yield pa.RecordBatch.from_arrays([*same, ix.take(pa.array(ok)), pa.array(best[ok]), pa.array(ty[place[ok]]), iy.take(pa.array(place[ok]))], [*keys, "i", "d", "rt", "ri"])

    found = met.mapInArrow(compare, schema).groupBy(*keys, F.col("i").alias(ident)).agg(F.min(F.struct("d", "rt", "ri")).alias("_f"))
    both = ours.select(*keys, ident).join(found, [*keys, ident], "left")
    return both.select(*keys, ident, F.col("_f.ri").alias(out), F.col("_f.rt").alias(f"{out}_t"), F.col("_f.d").alias("distance"))
