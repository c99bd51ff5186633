"""Fits of many features over few rows, and of plane maps with outliers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reeltide.operators.ranges import _back, numbered

#: Rows of a key that one task solves for: a matrix of at most 200 MB.
ROWS = 5000


def gram(rows: DataFrame, keys: list[str], ident: str, vector: str, block: int = 64) -> DataFrame:
    """keys, a, b, dot: the dot products of all pairs a <= b of a key's vectors. What is asked for is a matrix, so it has as many rows as the key's square.

    Rows are cut into blocks of about `block`; pairs of blocks meet and are multiplied as matrices, so a key of many rows is as many tasks as it has pairs of blocks. Vectors are of one length; null ones are left out.
    """
    kept = rows.where(F.col(vector).isNotNull()).select(*keys, F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    sizes = kept.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias("_k"))
    packed = _back(kept, sizes, keys).withColumn("_p", F.pmod(F.xxhash64("i"), F.col("_k"))).groupBy(*keys, "_k", "_p").agg(F.collect_list(F.struct("i", "v")).alias("xs"))
    x = packed.withColumn("_q", F.explode(F.sequence(F.col("_p"), F.col("_k") - 1)))
    y = packed.select(*keys, F.col("_p").alias("_q"), F.col("xs").alias("ys"))
    met = x.join(y, [*keys, "_q"]).select(*keys, (F.col("_p") == F.col("_q")).alias("same"), "xs", "ys")
    schema = rows.select(*keys, F.col(ident).alias("a"), F.col(ident).alias("b")).schema.add("dot", "double")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (ix, vx), (iy, vy) = ([s.field(f) for f in ("i", "v")] for s in (batch.column(c)[k].values for c in ("xs", "ys")))
                dot = np.array(vx.to_pylist()) @ np.array(vy.to_pylist()).T
                i, j = np.indices(dot.shape)
                i, j, dot = i.ravel(), j.ravel(), dot.ravel()
                a, b = ix.take(pa.array(i)).to_pylist(), iy.take(pa.array(j)).to_pylist()
                once = np.array([p <= q for p, q in zip(a, b, strict=True)]) if batch.column("same")[k].as_py() else np.ones(dot.size, bool)
                ends = [(p, q) if p <= q else (q, p) for p, q, o in zip(a, b, once, strict=True) if o]
                same = [pa.array([batch.column(c)[k].as_py()] * len(ends), batch.schema.field(c).type) for c in keys]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array([e[s] for e in ends], ix.type) for s in (0, 1)), pa.array(dot[once])], [*keys, "a", "b", "dot"])

    return met.mapInArrow(multiply, schema)


def dual_ridge(rows: DataFrame, keys: list[str], ident: str, vector: str, target: str, penalty: float) -> DataFrame:
    """keys, place, weight, intercept: ridge weights by way of the rows' dot products, where there are more features than rows.

    (G + penalty I) alpha = target - mean, and the weights are the vectors' sum times alpha. A key's matrix comes together in one task, so a key of more than ROWS rows is refused; the weights are summed where the vectors are. Rows with a null vector or target are left out.
    """
    whole = rows.where(F.col(vector).isNotNull() & F.col(target).isNotNull()).select(*keys, ident, vector, F.col(target).cast("double").alias("_y"))
    many = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS).limit(1).collect()
    if many:
        raise ValueError(f"a key has {many[0]['n']} rows; the dual form is for at most {ROWS}")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    dots = gram(whole, keys, ident, vector).join(whole.select(*keys, F.col(ident).alias("a"), "_y"), [*keys, "a"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["a"]))
        place = {v: i for i, v in enumerate(ids)}
        g, y = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
        a, b = pdf["a"].map(place).to_numpy(), pdf["b"].map(place).to_numpy()
        g[a, b] = g[b, a] = pdf["dot"].to_numpy()
        y[a] = pdf["_y"].to_numpy()
        alpha = np.linalg.solve(g + penalty * np.eye(len(ids)), y - y.mean())
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(ids) for k in keys}, ident: ids, "_alpha": alpha, "_mean": y.mean()})

    form = ", ".join(f"{c} {kinds[c]}" for c in [*keys, ident]) + ", _alpha double, _mean double"
    alpha = dots.groupBy(*keys).applyInPandas(solve, form)
    parts = whole.join(alpha, [*keys, ident]).select(*keys, "_alpha", "_mean", F.posexplode(F.col(vector).cast("array<double>")).alias("place", "_v"))
    return parts.groupBy(*keys, "place").agg(F.sum(F.col("_alpha") * F.col("_v")).alias("weight"), F.first("_mean").alias("intercept"))


def _solved(points: np.ndarray) -> np.ndarray | None:
    """The plane map (8 numbers, the ninth is 1) through points (x, y, u, v) by least squares; None if they do not tell one."""
    x, y, u, v = points.T
    one, zero = np.ones_like(x), np.zeros_like(x)
    a = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], 1)])
    found, _, rank, _ = np.linalg.lstsq(a, np.concatenate([u, v]), rcond=1e-12)
    return found if rank == 8 and np.isfinite(found).all() else None


def _off(h: Column, x: str, y: str, u: str, v: str) -> Column:
    """How far a map takes (x, y) from (u, v); null where it takes it to no place."""
    g = lambda i: F.get(h, F.lit(i))
    w = g(6) * F.col(x) + g(7) * F.col(y) + 1
    du, dv = (g(0) * F.col(x) + g(1) * F.col(y) + g(2)) / w - F.col(u), (g(3) * F.col(x) + g(4) * F.col(y) + g(5)) / w - F.col(v)
    return F.when(F.abs(w) > 1e-12, F.sqrt(du * du + dv * dv))


def homographies(points: DataFrame, keys: list[str], order: list, bucket: Column, xyuv: tuple[str, str, str, str], near: float, tries: int = 300, least: int = 50, seed: int = 1) -> DataFrame:
    """keys, map (8 numbers), inliers, points: the plane map that most points agree on, fitted to those that do.

    `tries` hypotheses a key, each through four points whose places a hash of key, number and seed names, so reruns agree; how many points lie within `near` of each is counted with map-side combination, the first of the best is taken, and the map is fitted again to its inliers by their sums.
    Points are numbered in two levels; a point is held against its key's hypotheses in one row. Keys of fewer than `least` points, or without a map, give no row.
    """
    x, y, u, v = xyuv
    clean = points.where(" AND ".join(f"`{c}` IS NOT NULL" for c in xyuv))
    placed = numbered(clean, keys, order, bucket, "_n").select(*keys, "_n", *[F.col(c).cast("double").alias(c) for c in xyuv])
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= least)
    asked = sizes.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    asked = asked.select(*keys, "_h", F.pmod(F.xxhash64(F.lit(seed), *[F.col(k).cast("string") for k in keys], "_h", "_k"), F.col("points")).alias("_n"))
    drawn = asked.join(placed, [*keys, "_n"]).groupBy(*keys, "_h").agg(F.collect_list(F.struct(*xyuv)).alias("_four"))
    schema = drawn.select(*keys, "_h").schema.add("map", T.ArrayType(T.DoubleType()))

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            maps = [_solved(np.array([[p[c] for c in xyuv] for p in four])) if len(four) == 4 else None for four in pdf["_four"]]
            out = pdf.drop(columns="_four").assign(map=[None if m is None else m.tolist() for m in maps])
            yield out[out["map"].notna()]

    maps = drawn.mapInPandas(through, schema)
    every = maps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_h", "map"))).alias("_maps"))  # at most `tries`
    held = placed.join(every, keys).withColumn("_near", F.transform("_maps", lambda m: F.struct(m["_h"].alias("h"), _off(m["map"], x, y, u, v).alias("d"))))
    counted = held.select(*keys, F.explode(F.transform(F.filter("_near", lambda m: m["d"] < near), lambda m: m["h"])).alias("_h")).groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_c"))
    best = counted.groupBy(*keys).agg(F.max_by("_h", F.struct("_c", -F.col("_h"))).alias("_h")).join(maps, [*keys, "_h"]).drop("_h")
    agreed = placed.join(best, keys).where(_off(F.col("map"), x, y, u, v) < near)
    rows = [[F.col(x), F.col(y), F.lit(1.0), *[F.lit(0.0)] * 3, -F.col(u) * F.col(x), -F.col(u) * F.col(y), F.col(u)], [*[F.lit(0.0)] * 3, F.col(x), F.col(y), F.lit(1.0), -F.col(v) * F.col(x), -F.col(v) * F.col(y), F.col(v)]]
    pairs = [(i, j) for i in range(8) for j in range(i, 9)]
    sums = agreed.groupBy(*keys).agg(F.first("map").alias("_first"), *[F.sum(rows[0][i] * rows[0][j] + rows[1][i] * rows[1][j]).alias(f"_s{k}") for k, (i, j) in enumerate(pairs)])
    form = sums.select(*keys).schema.add("map", T.ArrayType(T.DoubleType()))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                a = np.zeros((8, 9))
                for k, (i, j) in enumerate(pairs):
                    a[i, j] = row[f"_s{k}"]
                    if j < 8:
                        a[j, i] = a[i, j]
                found, _, rank, _ = np.linalg.lstsq(a[:, :8], a[:, 8], rcond=1e-15)
                out.append(list(found) if rank == 8 and np.isfinite(found).all() else list(row["_first"]))
            yield pdf[keys].assign(map=out)

    fitted = sums.mapInPandas(again, form)
    final = placed.join(fitted, keys).groupBy(*keys).agg(F.first("map").alias("map"), F.count_if(_off(F.col("map"), x, y, u, v) < near).alias("inliers"), F.count(F.lit(1)).alias("points"))
    return final
