"""Signals, tracked regions, alignment, ramps, solved settings and scored models over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.functions.clock import micros
from reeltide.operators import alignment, models, smoothing, solving, tracking
from reeltide.tables import table

HOUR = 3_600_000_000
RULES = tracking.Rules()


def shot_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("shot", F.expr("vec_id div 97"))
    low, high = smoothing.indexed_bounds("embedding", 3, 20)
    e = e.select("label", "shot", "vec_id", low.alias("low"), high.alias("high"))
    s = smoothing.smoothed(e, ["label", "shot"], ["vec_id"], F.expr("vec_id div 16"), {"low": "lo", "high": "hi"}, 0.15, ["vec_id"])
    return s.select("label", "shot", "vec_id", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


def decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", micros("ts").alias("t"), "event_id", "value")
    d = smoothing.decimated(e, ["event_type"], ["t", "event_id"], F.floor(F.col("t") / (24 * HOUR)), "value", 2, smoothing.low_pass(2), "level", 512)
    return d.select("event_type", "place", F.round("level", 9).alias("level"))


def ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("t"), "event_id", "event_type", "value")
    spans = e.where("event_type = 'purchase'").select(
        "user_id", F.col("t").alias("start_t"), F.when(F.col("event_id") % 10 == 0, 0).otherwise(F.col("t") + F.floor(F.col("value") * 120) * 6_000_000).alias("end_t"),
        F.col("event_id").alias("line"), F.col("value").alias("depth"), ((F.col("event_id") % 4) * 24 * HOUR).alias("ramp"),
    )
    points = e.where("event_type <> 'purchase'").select("user_id", "t", "event_id")
    out = smoothing.ramped(points, spans, ["user_id"], "t", "start_t", "end_t", "line", "depth", "ramp", 50.0, HOUR, 1000)
    return out.select("user_id", "event_id", "line", F.round("shape", 6).alias("shape"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as regions: a film is a group of users, a picture half a day, an event a box whose place follows from its value; every ninth picture's event shows none."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("film"), F.floor(micros("ts") / (12 * HOUR)).alias("picture"), "event_id", "value")
    x, y = F.floor(F.col("value") / 15) * 10, F.floor(F.col("value")) % 3 * 4
    shown = F.col("event_id") % 9 > 0
    prob = (F.col("event_id") * 37 % 101) / 101
    e = e.select("film", "picture", "event_id", *[F.when(shown, c.cast("double")).alias(n) for n, c in (("x0", x), ("y0", y), ("x1", x + 12), ("y1", y + 12))], prob.alias("p"))
    d = tracking.tracked(e, ["film"], "picture", ["event_id"], ("x0", "y0", "x1", "y1"), "p", RULES)
    return d.select("film", "picture", "line", F.round("prob", 9).alias("prob"), "lift", "found")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("film", F.col("label") % 4)
    d = alignment.aligned(e.where("vec_id % 3 = 0"), e.where("vec_id % 3 > 0"), ["film"], "vec_id", "vec_id", "embedding", 30, "match", 16)
    return d.select("film", "vec_id", "match", F.round("distance", 6).alias("distance"))


def size_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's items stand for a film: at setting c its size is 1000 and the price of the items whose part has c or more by its last numbers."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 52).cast("int").alias("c"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    by = l.groupBy("l_suppkey", "c").agg(F.sum("cents").alias("cents")).withColumn("c", F.explode(F.sequence(F.lit(0), "c")))
    every = by.groupBy("l_suppkey", "c").agg((F.sum("cents") / 100 + 1000).alias("size"))
    every = every.withColumn("start", F.col("l_suppkey") % 40 + 4)
    target = F.max("size") * (F.first("l_suppkey") % 17 + 1) / 20
    d = solving.setting_for_size(every, ["l_suppkey"], "c", "size", target, F.first("start"))
    return d.select("l_suppkey", F.round("target", 4).alias("target"), F.array_join("points", ",").alias("points"), "chosen")


#: A small model of each kind, made for these queries.
TREES = {
    "base": -0.25,
    "trees": [
        [{"feature": 0, "threshold": 60.0, "left": 1, "right": 2, "nan_left": True}, {"feature": 1, "threshold": 4.5, "left": 3, "right": 4, "nan_left": False}, {"value": 0.75}, {"value": -0.5}, {"value": 0.125}],
        [{"feature": 1, "threshold": 7.0, "left": 1, "right": 2, "nan_left": True}, {"value": 0.3}, {"feature": 2, "threshold": 12.0, "left": 3, "right": 4, "nan_left": True}, {"value": -0.9}, {"value": 0.6}],
    ],
}
KERNEL = {
    "gamma": 0.5, "rho": -0.4, "slope": [0.01, 0.1, 0.04], "intercept": [0.0, -0.2, 0.1], "out_slope": 0.012, "out_intercept": -0.1,
    "vectors": [{"weight": 0.8, "x": [0.2, 0.5, 0.7]}, {"weight": -0.3, "x": [0.9, 0.1, 0.2]}, {"weight": 0.45, "x": [0.4, 0.6, 0.1]}],
}


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select("event_id", F.array(F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")), F.when(F.col("event_id") % 7 > 0, k), F.hour("ts").cast("double")).alias("x"))


def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = models.tree_score(_features(spark, sf_dir), models.model(spark, json.dumps(TREES), models.TREES), F.col("x"), "score")
    return d.select("event_id", F.round("score", 9).alias("score"))


def kernel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir).withColumn("x", F.transform("x", lambda v: F.nanvl(v, F.lit(1.0))))
    d = models.kernel_score(rows, models.model(spark, json.dumps(KERNEL), models.KERNEL), F.col("x"), "score")
    return d.select("event_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (shot_ranges, decimated, ramps, text_lines, aligned, size_setting, tree_scores, kernel_scores)}


def _leaf(tree: list[dict], at: int = 0) -> str:
    """A tree as nested CASE over x[1], x[2], ..."""
    n = tree[at]
    if "left" not in n:
        return f"{n['value']}::DOUBLE"
    x = f"x[{n['feature'] + 1}]"
    missing = f"({x} IS NULL OR isnan({x}))"
    low = f"({missing} OR {x} < {n['threshold']})" if n["nan_left"] else f"(NOT {missing} AND {x} < {n['threshold']})"
    return f"CASE WHEN {low} THEN {_leaf(tree, n['left'])} ELSE {_leaf(tree, n['right'])} END"


_X = """f AS (SELECT event_id, [CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END, CASE WHEN event_id % 7 > 0 THEN json_extract_string(props, '$.k')::DOUBLE END, hour(ts)::DOUBLE] AS x FROM events)"""
_LIST = lambda v: "[" + ", ".join(f"{x}::DOUBLE" for x in v) + "]"
_IOU = """greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0))"""
_SOLVE = """CASE WHEN x.i IS NULL THEN NULL ELSE p[x.i].c + (ln(target) - p[x.i].s) / (CASE WHEN (p[x.i + 1].s - p[x.i].s) / (p[x.i + 1].c - p[x.i].c) < 0 THEN (p[x.i + 1].s - p[x.i].s) / (p[x.i + 1].c - p[x.i].c) ELSE -ln(2.0::DOUBLE) / 6 END) END"""
_PLACE = """LATERAL (SELECT CASE WHEN p[len(p)].s > ln(target) THEN len(p) - 1 ELSE coalesce(list_filter(range(1, len(p)), lambda i: p[i].s >= ln(target) AND p[i + 1].s <= ln(target))[1], 1) END AS i) x"""


def _refined(before: str, now: str) -> str:
    """A step of the solver: one more point if none is near the answer, and the line again."""
    return f"""{now}p AS (SELECT b.* EXCLUDE (p, s), CASE WHEN len(list_filter(b.p, lambda q: abs(q.c - b.s) < 1.5)) > 0 OR m.s IS NULL THEN b.p ELSE list_sort(list_distinct(list_append(b.p, {{'c': m.c, 's': m.s}}))) END AS p
        FROM {before} b LEFT JOIN m ON m.l_suppkey = b.l_suppkey AND m.c = least(greatest(round(b.s), 0), 51)::INT), {now} AS (SELECT {now}p.*, {_SOLVE} AS s FROM {now}p, {_PLACE})"""


ORACLES = {
    "shot_ranges": """WITH RECURSIVE s AS (SELECT label, vec_id // 97 AS shot, vec_id, list_sort(list_filter(embedding, lambda v, i: (i - 1) % 3 = 0)) AS v FROM embeddings),
        n AS (SELECT label, shot, vec_id, v[len(v) // 20 + 1]::DOUBLE AS low, v[len(v) - len(v) // 20]::DOUBLE AS high, row_number() OVER (PARTITION BY label, shot ORDER BY vec_id) AS rn FROM s),
        f AS (SELECT label, shot, vec_id, rn, low AS lo, high AS hi FROM n WHERE rn = 1
        UNION ALL SELECT n.label, n.shot, n.vec_id, n.rn, lo + 0.15::DOUBLE * (low - lo), hi + 0.15::DOUBLE * (high - hi) FROM f JOIN n ON n.label = f.label AND n.shot = f.shot AND n.rn = f.rn + 1)
        SELECT label, shot, vec_id, round(lo, 9) AS lo, round(hi, 9) AS hi FROM f""",
    "decimated": """WITH i AS (SELECT unnest(range(0, 129)) AS i), c AS (SELECT i, (i - 64)::DOUBLE AS x, (20.0::DOUBLE / 48) / 2 AS fc FROM i),
        w AS (SELECT i, CASE WHEN x = 0 THEN 2 * fc ELSE sin(2 * pi() * fc * x) / (pi() * x) END * (0.42::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 128) + 0.08::DOUBLE * cos(4 * pi() * i / 128)) AS h FROM c),
        taps AS (SELECT i, h / (SELECT sum(h) FROM w) AS h FROM w),
        n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) - 1 AS n FROM events)
        SELECT a.event_type, a.n // 2 AS place, round(sum(coalesce(b.value, 0) * h), 9) AS level FROM n a JOIN taps ON a.n % 2 = 1 JOIN n b ON b.event_type = a.event_type AND b.n = a.n - 128 + i GROUP BY a.event_type, a.n""",
    "ramps": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type, value FROM events),
        s AS (SELECT user_id, t AS a, CASE WHEN event_id % 10 = 0 THEN 0 ELSE t + floor(value * 120)::BIGINT * 6000000 END AS b, event_id AS line, value, event_id % 4 * 86400000000 AS ramp FROM e WHERE event_type = 'purchase'),
        w AS (SELECT s.user_id, s.line, s.a, s.value, s.ramp, max(o.line) AS was FROM s LEFT JOIN s o ON o.user_id = s.user_id AND s.a - 1000 >= o.a AND (o.b = 0 OR s.a - 1000 < o.b) GROUP BY ALL),
        k AS (SELECT w.*, coalesce(o.value, 50) AS start FROM w LEFT JOIN s o ON o.user_id = w.user_id AND o.line = w.was),
        p AS (SELECT e.user_id, e.event_id, e.t, max(s.line) AS line FROM e LEFT JOIN s ON s.user_id = e.user_id AND e.t >= s.a AND (s.b = 0 OR e.t < s.b) WHERE event_type <> 'purchase' GROUP BY ALL)
        SELECT p.user_id, p.event_id, p.line, round(CASE WHEN p.line IS NULL THEN 50 WHEN ramp > 0 AND t - a < ramp THEN start + (t - a)::DOUBLE / ramp * (value - start) ELSE value END::DOUBLE, 6) AS shape
        FROM p LEFT JOIN k ON k.user_id = p.user_id AND k.line = p.line""",
    "text_lines": f"""WITH RECURSIVE e AS (SELECT user_id % 40 AS film, epoch_us(ts) // 43200000000 AS picture, event_id, event_id % 9 > 0 AS shown, floor(value / 15) * 10 AS x0, floor(value)::BIGINT % 3 * 4.0::DOUBLE AS y0, (event_id * 37 % 101) / 101.0::DOUBLE AS p FROM events),
        o AS (SELECT *, x0 + 12 AS x1, y0 + 12 AS y1, row_number() OVER (PARTITION BY film ORDER BY picture, event_id) AS rn, coalesce(lead(picture) OVER (PARTITION BY film ORDER BY picture, event_id) <> picture, true) AS last FROM e),
        f AS (SELECT film, 0::BIGINT AS rn, 0::BIGINT AS picture, false AS last, 0::BIGINT AS n, []::STRUCT(id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, p DOUBLE, sure INT, lost INT, lift DOUBLE, seen BOOLEAN)[] AS s FROM o GROUP BY film
        UNION ALL
        SELECT r.film, r.rn, r.picture, r.last, f.n + (r.shown AND (best IS NULL OR best < 0.3))::INT, CASE WHEN r.last THEN closed ELSE met END
        FROM f JOIN o r ON r.film = f.film AND r.rn = f.rn + 1,
        LATERAL (SELECT list_transform(f.s, lambda l: CASE WHEN l.seen OR NOT r.shown THEN -1::DOUBLE ELSE ({_IOU}) / ((l.x1 - l.x0) * (l.y1 - l.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - ({_IOU})) END) AS us) a,
        LATERAL (SELECT list_max(us) AS best, list_position(us, list_max(us)) AS place) b,
        LATERAL (SELECT CASE WHEN NOT r.shown THEN f.s WHEN best IS NULL OR best < 0.3 THEN list_append(f.s, {{'id': f.n, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'p': r.p, 'sure': 0, 'lost': 0, 'lift': 0.0::DOUBLE, 'seen': true}})
            ELSE list_transform(f.s, lambda l, i: CASE WHEN i = place THEN {{'id': l.id, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'p': l.p + 0.3::DOUBLE * (r.p - l.p), 'sure': l.sure, 'lost': 0, 'lift': l.lift, 'seen': true}} ELSE l END) END AS met) c,
        LATERAL (SELECT list_transform(met, lambda l: {{'id': l.id, 'x0': l.x0, 'y0': l.y0, 'x1': l.x1, 'y1': l.y1, 'p': l.p, 'lost': CASE WHEN l.seen THEN l.lost ELSE l.lost + 1 END, 'lift': l.lift,
            'sure': CASE WHEN l.p > 0.55 THEN l.sure + 1 WHEN l.p < 0.4 AND l.lift < 1 THEN 0 ELSE l.sure END}}) AS aged) d,
        LATERAL (SELECT list_transform(aged, lambda l: {{'id': l.id, 'x0': l.x0, 'y0': l.y0, 'x1': l.x1, 'y1': l.y1, 'p': l.p, 'lost': l.lost, 'lift': l.lift, 'sure': CASE WHEN l.lift >= 1 AND l.lost = 0 THEN greatest(l.sure, 3) ELSE l.sure END}}) AS kept) g,
        LATERAL (SELECT list_filter(list_transform(kept, lambda l: {{'id': l.id, 'x0': l.x0, 'y0': l.y0, 'x1': l.x1, 'y1': l.y1, 'p': l.p, 'sure': l.sure, 'lost': l.lost,
            'lift': CASE WHEN l.lost = 0 AND l.sure >= 3 THEN least(1, l.lift + 0.25::DOUBLE) ELSE greatest(0, l.lift - 0.25::DOUBLE) END, 'seen': false}}), lambda l: l.lost <= 2 OR l.lift > 0) AS closed) h)
        SELECT film, picture, l.id AS line, round(l.p, 9) AS prob, l.lift AS lift, l.lost = 0 AS found FROM (SELECT film, picture, unnest(s) AS l FROM f WHERE last)""",
    "aligned": """WITH e AS (SELECT label % 4 AS film, vec_id, embedding FROM embeddings), d AS (SELECT a.film, a.vec_id, b.vec_id AS match, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) AS d
        FROM e a JOIN e b ON a.film = b.film AND a.vec_id % 3 = 0 AND b.vec_id % 3 > 0 AND abs(a.vec_id - b.vec_id) <= 30)
        SELECT e.film, e.vec_id, arg_min(match, (d, match)) AS match, round(min(d), 6) AS distance FROM e LEFT JOIN d USING (film, vec_id) WHERE e.vec_id % 3 = 0 GROUP BY e.film, e.vec_id""",
    "size_setting": f"""WITH l AS (SELECT l_suppkey, l_partkey % 52 AS c, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem), g AS (SELECT l_suppkey, max(c) AS top FROM l GROUP BY l_suppkey),
        c AS (SELECT l_suppkey, unnest(range(0, top + 1)) AS c FROM g), z AS (SELECT c.l_suppkey, c.c::INT AS c, sum(cents)::DOUBLE / 100 + 1000 AS size FROM c JOIN l ON l.l_suppkey = c.l_suppkey AND l.c >= c.c GROUP BY ALL),
        m AS (SELECT l_suppkey, c, ln(size) AS s FROM z),
        a0 AS (SELECT l_suppkey, max(size) * (l_suppkey % 17 + 1) / 20 AS target, (l_suppkey % 40 + 4)::INT AS begun FROM z GROUP BY l_suppkey),
        a1 AS (SELECT a0.*, (SELECT list_sort(list({{'c': m.c, 's': m.s}})) FROM m WHERE m.l_suppkey = a0.l_suppkey AND m.c IN (greatest(begun - 6, 0), least(begun + 6, 51))) AS p FROM a0),
        a AS (SELECT a1.*, {_SOLVE} AS s FROM a1, {_PLACE} WHERE len(p) > 1), {_refined("a", "r1")}, {_refined("r1", "r2")}
        SELECT l_suppkey, round(target, 4) AS target, array_to_string(list_transform(p, lambda q: q.c), ',') AS points, least(greatest(ceil(s - 0.05), 0), 51)::INT AS chosen FROM r2""",
    "tree_scores": f"WITH {_X} SELECT event_id, round(1 / (1 + exp(-({TREES['base']}::DOUBLE + {' + '.join(_leaf(t) for t in TREES['trees'])}))), 9) AS score FROM f",
    "kernel_scores": f"""WITH {_X}, y AS (SELECT event_id, list_transform(x, lambda v: CASE WHEN isnan(v) THEN 1 ELSE v END) AS x FROM f),
        z AS (SELECT event_id, list_contains(list_transform(x, lambda v: v IS NULL), true) AS gap, [x[1] * 0.01::DOUBLE, x[2] * 0.1::DOUBLE - 0.2::DOUBLE, x[3] * 0.04::DOUBLE + 0.1::DOUBLE] AS x FROM y)
        SELECT event_id, CASE WHEN NOT gap THEN round(greatest(0, least(100, ({' + '.join(f"{v['weight']}::DOUBLE * exp(-0.5::DOUBLE * ((x[1] - {v['x'][0]}::DOUBLE) ** 2 + (x[2] - {v['x'][1]}::DOUBLE) ** 2 + (x[3] - {v['x'][2]}::DOUBLE) ** 2))" for v in KERNEL['vectors'])}
            + 0.4::DOUBLE + 0.1::DOUBLE) / 0.012::DOUBLE)), 6) END AS score FROM z""",
}
