"""Ordered rules and folds: events of a user stand for the pictures, packets or cues of a film."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.functions.clock import micros
from reeltide.operators import folds, sequence
from reeltide.tables import table

MINUTE = 60_000_000
HOUR = 60 * MINUTE
KEY, ORDER = ["user_id"], ["t", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", micros("ts").alias("t"), "event_id", "event_type", "value", "props")


def motion2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.motion(events(spark, sf_dir), KEY, ORDER, "value", "motion2").select("user_id", "event_id", "motion2")


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "t", "event_id")
    return sequence.filled(e, KEY, ORDER, "t", 30 * MINUTE, 12 * HOUR)


def reorder_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.display_order(events(spark, sf_dir), KEY, ORDER, F.col("event_type") == "signup", "value", "display")
    return d.select("user_id", "event_id", "display")


def cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("key", F.col("event_type") == "purchase")
    e = e.withColumn("arrived", F.col("t") + F.pmod(F.col("event_id"), F.lit(3)) * 2 * HOUR)  # so that time runs back now and then
    return folds.clusters(e, KEY, ["arrived", "event_id"], "t", "key", ["event_id"], 12 * HOUR, 48 * HOUR, HOUR)


def overlap_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_id", F.col("t").alias("start_t"), (F.col("t") + F.floor(F.col("value")) * 4 * MINUTE).alias("stop_t"))
    return sequence.clipped(e, KEY, ["start_t", "event_id"], "start_t", "stop_t")


def cue_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 1000).alias("begin"), "text")
    return sequence.cue_ends(c, ["conv_id"], "begin", 5000, "finish").where(F.trim("text") != "").select("conv_id", "begin", "finish")


def segment_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.segments(events(spark, sf_dir), ["event_type"], ORDER, 250, "segment", F.floor(F.col("t") / (24 * HOUR))).select("event_type", "event_id", "segment")


def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.every_nth(events(spark, sf_dir), KEY, ORDER, 3, 5).select("user_id", "event_id")


def run_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sequence.run_rate(events(spark, sf_dir), KEY, ORDER, "t", 24 * HOUR, 25, 8, HOUR, "rate")
    return d.select("user_id", "event_id", F.round("rate", 6).alias("rate"))


def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"flag": F.col("value") > 60, "fresh": F.col("event_type") == "signup"})
    return folds.hysteresis(e, KEY, ORDER, "flag", "fresh", ["event_id"], 3, 4)


def shot_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return sequence.cut_ids(e, ["label"], ["vec_id"], "embedding", 0.12, "shot", F.expr("vec_id div 64")).select("label", "vec_id", "shot")


def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return sequence.jitter(e, KEY, ORDER, "value", "k", 0.5, 10)


def counter_mod16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.counters(events(spark, sf_dir), KEY, ORDER, F.col("event_type") != "error", 16, "counter").select("user_id", "event_id", "counter")


def clamp_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("clock", F.col("t") + F.floor(F.col("value")) * HOUR)
    return sequence.clamped(e, KEY, ORDER, "clock", "dropped", "arrival").select("user_id", "event_id", "dropped", "arrival")


def unwrap_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("wire", F.pmod(F.col("t"), F.lit(1 << 41)))
    return sequence.unwrapped(e, KEY, ORDER, "wire", 41, "clock").select("user_id", "event_id", "clock")


def rle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.run_lengths(events(spark, sf_dir), KEY, ORDER, "event_type")


def valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.valid_prefix(events(spark, sf_dir), KEY, ORDER, F.col("value") < 200).select("user_id", "event_id")


def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.look_ahead(events(spark, sf_dir), KEY, ORDER, "value", 48, "lift").select("user_id", "event_id", "lift")


def greedy_separated_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.separated_top(events(spark, sf_dir), KEY, [F.desc("value"), "event_id"], "t", ["event_id"], 5, 48 * HOUR)


def extent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 512).cast("long").alias("length"))
    e = e.withColumn("block", F.col("l_orderkey") * 4 + F.col("l_linenumber") % 4)
    return folds.merged_extents(e, ["l_suppkey"], ["block", "l_linenumber", "l_partkey", "length"], "block", "length", 2048, 40_000)


def clip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_id", "t", F.floor("value").cast("long").alias("v"))
    e = e.select("user_id", "event_id", (F.col("t") % 100).alias("nominal"), F.col("v").alias("first_t"), (F.col("v") * 3).alias("last_t"), (F.col("v") % 7 + 1).alias("frame"))
    return folds.joined_clips(e, KEY, ["event_id"], "nominal", "first_t", "last_t", "frame")


def sync_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "event_id", (F.col("t") + F.floor("value") * HOUR).alias("at"))
    return folds.sync_points(e, KEY, "at", ["event_id"], 60 * HOUR, 100 * HOUR)


QUERIES = {
    f.__name__: f
    for f in (
        motion2, holes, reorder_display, cluster_ids, overlap_clip, cue_end, segment_id, every_nth, run_rate, hysteresis, shot_id, jitter, counter_mod16, clamp_monotone, unwrap_clock,
        rle_table, valid_prefix, look_ahead, greedy_separated_topk, extent_merge, clip_join, sync_marks,
    )
}

_E = "e AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type, value, props FROM events)"
_N = _E + ", n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM e)"
_W = "(PARTITION BY user_id ORDER BY t, event_id)"
_UP = "(PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"
_PRE = "(PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

ORACLES = {
    "motion2": f"WITH {_N} SELECT user_id, event_id, CASE WHEN rn = 1 THEN 0.0::DOUBLE ELSE least(value, coalesce(lead(value) OVER {_W}, value)) END AS motion2 FROM n",
    "holes": f"""WITH {_E}, g AS (SELECT *, t - lag(t) OVER {_W} AS gap FROM e),
        m AS (SELECT *, CASE WHEN gap > 2700000000 AND gap <= 43200000000 THEN (gap + 900000000) // 1800000000 - 1 ELSE 0 END AS missing FROM g)
        SELECT user_id, t - copy * 1800000000 AS t, event_id, copy::INT AS copy FROM (SELECT *, unnest(generate_series(0, missing)) AS copy FROM m)""",
    "reorder_display": f"""WITH {_E}, c AS (SELECT *, sum((event_type = 'signup')::INT) OVER {_UP} AS cvs FROM e)
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY cvs, value, t, event_id) - 1 AS display FROM c""",
    "cluster_ids": f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t + event_id % 3 * 7200000000, event_id) AS rn FROM e), f AS (
        SELECT user_id, event_id, rn, t AS begun, 0::BIGINT AS cluster FROM n WHERE rn = 1
        UNION ALL
        SELECT n.user_id, n.event_id, n.rn, CASE WHEN c THEN n.t ELSE begun END, cluster + c::INT
        FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1,
             LATERAL (SELECT n.t - begun >= 172800000000 OR n.t - begun <= -3600000000 OR (n.event_type = 'purchase' AND n.t - begun >= 43200000000) AS c))
        SELECT user_id, event_id, cluster FROM f""",
    "overlap_clip": f"""WITH {_E}, c AS (SELECT user_id, event_id, t, t + floor(value)::BIGINT * 240000000 AS stop_t FROM e WHERE floor(value) > 0),
        x AS (SELECT *, coalesce(max(stop_t) OVER {_PRE}, 0) AS fin FROM c), y AS (SELECT *, greatest(t, fin) AS begun FROM x WHERE stop_t > greatest(t, fin))
        SELECT user_id, event_id, begun AS begin, stop_t AS finish, false AS gap FROM y UNION ALL SELECT user_id, event_id, fin, begun, true FROM y WHERE begun > fin""",
    "cue_end": """SELECT conv_id, begin, finish FROM (SELECT conv_id, turn * 1000 AS begin, coalesce(lead(turn * 1000) OVER (PARTITION BY conv_id ORDER BY turn), turn * 1000 + 5000) AS finish, text FROM conversations)
        WHERE trim(text) <> ''""",
    "segment_id": f"WITH {_E} SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1) // 250 AS segment FROM e",
    "every_nth": f"WITH {_N} SELECT user_id, event_id FROM n WHERE rn - 1 >= 3 AND (rn - 4) % 5 = 0",
    "run_rate": f"""WITH {_E}, a AS (SELECT *, coalesce((t - lag(t) OVER {_W} > 86400000000)::INT, 0) AS fresh FROM e), b AS (SELECT *, sum(fresh) OVER {_UP} AS run FROM a),
        c AS (SELECT *, count(*) OVER r AS k, t - min(t) OVER r AS span FROM b WINDOW r AS (PARTITION BY user_id, run ORDER BY t, event_id ROWS 24 PRECEDING))
        SELECT user_id, event_id, round(CASE WHEN k >= 8 AND span > 0 THEN (k - 1) / (span / 3600000000.0::DOUBLE) ELSE 0 END, 6) AS rate FROM c""",
    "hysteresis": f"""WITH RECURSIVE {_N}, m AS (SELECT *, value > 60 AS flag, event_type = 'signup' AS fresh FROM n), f AS (
        SELECT user_id, event_id, rn, flag AS flat, 0 AS run, CASE WHEN flag THEN 0.0 ELSE 1.0 END::DOUBLE AS factor FROM m WHERE rn = 1
        UNION ALL
        SELECT m.user_id, m.event_id, m.rn, z.flat2, CASE WHEN m.fresh OR m.flag = z.flat2 THEN 0 ELSE f.run + 1 END,
               CASE WHEN m.fresh THEN CASE WHEN m.flag THEN 0 ELSE 1 END WHEN z.flat2 THEN greatest(f.factor - 0.25, 0) ELSE least(f.factor + 0.25, 1) END::DOUBLE
        FROM f JOIN m ON m.user_id = f.user_id AND m.rn = f.rn + 1,
             LATERAL (SELECT CASE WHEN m.fresh OR (m.flag <> f.flat AND f.run + 1 >= 3) THEN m.flag ELSE f.flat END AS flat2) z)
        SELECT user_id, event_id, factor FROM f""",
    "shot_id": """WITH l AS (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
        c AS (SELECT *, CASE WHEN prev IS NOT NULL AND list_sum(list_transform(list_zip(embedding, prev), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / len(embedding) > 0.12 THEN 1 ELSE 0 END AS cut FROM l)
        SELECT label, vec_id, (sum(cut) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING))::BIGINT AS shot FROM c""",
    "jitter": f"""WITH {_E}, k AS (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM e), d AS (SELECT user_id, value - lag(value) OVER {_W} AS a, k - lag(k) OVER {_W} AS b FROM k)
        SELECT user_id, count(*) AS n, round(avg(abs(0.5::DOUBLE * a - b)), 6) AS jitter FROM d WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY user_id HAVING count(*) >= 10""",
    "counter_mod16": f"WITH {_E} SELECT user_id, event_id, (sum((event_type <> 'error')::INT) OVER {_UP} - 1 + 16)::BIGINT % 16 AS counter FROM e",
    "clamp_monotone": f"""WITH {_E}, c AS (SELECT *, t + floor(value)::BIGINT * 3600000000 AS clock FROM e), m AS (SELECT *, max(clock) OVER {_PRE} AS top FROM c)
        SELECT user_id, event_id, coalesce(clock < top, false) AS dropped, greatest(clock, coalesce(top, clock)) AS arrival FROM m""",
    "unwrap_clock": f"""WITH {_E}, b AS (SELECT user_id, event_id, t, t - (first_value(t) OVER {_W} - (first_value(t) OVER {_W}) % 2199023255552) AS clock FROM e) SELECT user_id, event_id, clock FROM b""",
    "rle_table": f"""WITH {_E}, c AS (SELECT *, coalesce((event_type <> lag(event_type) OVER {_W})::INT, 0) AS fresh FROM e), r AS (SELECT *, (sum(fresh) OVER {_UP})::BIGINT AS run FROM c)
        SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS count FROM r GROUP BY user_id, run""",
    "valid_prefix": f"WITH {_E} SELECT user_id, event_id FROM (SELECT *, max(value) OVER {_UP} AS top FROM e) WHERE top < 200",
    "look_ahead": f"WITH {_E} SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 48 FOLLOWING) AS lift FROM e",
    "greedy_separated_topk": f"""WITH RECURSIVE {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM e), f AS (
        SELECT user_id, event_id, rn, [t] AS taken, true AS own FROM o WHERE rn = 1
        UNION ALL
        SELECT o.user_id, o.event_id, o.rn, CASE WHEN ok THEN list_append(taken, o.t) ELSE taken END, ok
        FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1, LATERAL (SELECT len(taken) < 5 AND len(list_filter(taken, lambda x: abs(x - o.t) < 172800000000)) = 0 AS ok))
        SELECT user_id, event_id, len(taken)::INT AS place FROM f WHERE own""",
    "extent_merge": """WITH RECURSIVE x AS (SELECT l_suppkey, l_orderkey * 4 + l_linenumber % 4 AS block, l_linenumber, l_partkey, (l_quantity * 512)::BIGINT AS length FROM lineitem),
        o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY block, l_linenumber, l_partkey, length) AS rn FROM x), f AS (
        SELECT l_suppkey, rn, 0 AS extent, block, length, 1 AS parts FROM o WHERE rn = 1
        UNION ALL
        SELECT o.l_suppkey, o.rn, f.extent + (NOT j)::INT, CASE WHEN j THEN f.block ELSE o.block END, CASE WHEN j THEN f.length + o.length ELSE o.length END, CASE WHEN j THEN f.parts + 1 ELSE 1 END
        FROM f JOIN o ON o.l_suppkey = f.l_suppkey AND o.rn = f.rn + 1, LATERAL (SELECT f.length % 2048 = 0 AND f.block + f.length // 2048 = o.block AND f.length + o.length <= 40000 AS j))
        SELECT l_suppkey, extent, any_value(block) AS block, max(length)::BIGINT AS length, max(parts)::INT AS parts FROM f GROUP BY l_suppkey, extent""",
    "clip_join": """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) % 100 AS nominal, floor(value)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), f AS (
        SELECT user_id, event_id, rn, nominal AS shift, v * 3 + nominal AS last FROM o WHERE rn = 1
        UNION ALL
        SELECT o.user_id, o.event_id, o.rn, greatest(o.nominal, f.last + o.v % 7 + 1 - o.v), o.v * 3 + greatest(o.nominal, f.last + o.v % 7 + 1 - o.v) FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
        SELECT user_id, event_id, shift FROM f""",
    "sync_marks": """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) + floor(value)::BIGINT * 3600000000 AS at_t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), f AS (
        SELECT user_id, event_id, rn, at_t AS prev, at_t AS mark, true AS own FROM o WHERE rn = 1
        UNION ALL
        SELECT o.user_id, o.event_id, o.rn, o.at_t, CASE WHEN m THEN o.at_t ELSE f.mark END, m
        FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1, LATERAL (SELECT o.at_t - f.prev > 216000000000 OR o.at_t < f.prev OR o.at_t - f.mark >= 360000000000 AS m))
        SELECT user_id, event_id FROM f WHERE own""",
}
