"""Lookups and pairings over `events`: event types of a user stand for the streams of a film, microseconds for its clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.functions.clock import micros
from reeltide.operators import asof, pairing
from reeltide.tables import table

HOUR = 3_600_000_000


def stream(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """user_id, t, event_id, value of one type of event."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select("user_id", micros("ts").alias("t"), "event_id", "value")


def asof_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    views, keys = stream(spark, sf_dir, "view"), stream(spark, sf_dir, "purchase").withColumnRenamed("event_id", "key_id")
    out = asof.as_of(views.select("user_id", "t", "event_id"), keys, ["user_id"], "t", {"key_id": "key_id", "value": "offset"}, 24 * HOUR)
    return out.select("user_id", "event_id", "key_id", "offset")


def group_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases stand for groups of pictures with an offset each six hours, as many as their value gives."""
    groups = stream(spark, sf_dir, "purchase").select("user_id", "t", F.transform(F.sequence(F.lit(1), F.floor("value") % 5 + 1), lambda i: i * 10 + F.col("event_id") % 7).alias("offsets"))
    return asof.offset_at(stream(spark, sf_dir, "view").select("user_id", "t", "event_id"), groups, ["user_id"], "t", "offsets", 6 * HOUR, 24 * HOUR, "offset").select("user_id", "event_id", "offset")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base and enhancement layer of a film in decode order: views, and as many clicks, numbered alike."""
    a, b = stream(spark, sf_dir, "view"), stream(spark, sf_dir, "click")
    a = a.select("user_id", F.col("t").alias("ta"), F.col("event_id").alias("left_id"), F.lit(1).alias("shown"))
    b = b.select("user_id", F.col("t").alias("tb"), F.col("event_id").alias("right_id"), F.lit(1).alias("meant"))
    return pairing.zipped_checked(a, b, ["user_id"], ["ta", "left_id"], ["tb", "right_id"], "shown", "meant").select("user_id", "place", "left_id", "right_id", "shown")


def nearest_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors, masks = stream(spark, sf_dir, "error"), stream(spark, sf_dir, "signup").withColumnRenamed("event_id", "mask_id")
    out = asof.nearest(errors.select("user_id", "t", "event_id"), masks, ["user_id"], "t", 6 * HOUR, {"mask_id": "mask_id"})
    return out.select("user_id", "event_id", "mask_id")


def interval_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = stream(spark, sf_dir, "purchase").select(
        "user_id", F.col("t").alias("start_t"), F.when(F.col("event_id") % 10 == 0, 0).otherwise(F.col("t") + F.floor(F.col("value") * 60) * 1_000_000).alias("end_t"), F.col("event_id").alias("line")
    )
    points = stream(spark, sf_dir, "view").select("user_id", "t", "event_id")
    return asof.interval_last(points, spans, ["user_id"], "t", "start_t", "end_t", "line", HOUR).select("user_id", "event_id", "line")


def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = stream(spark, sf_dir, "purchase").select("user_id", "t", F.col("event_id").alias("mark"))
    return asof.counts_between(marks, stream(spark, sf_dir, "view"), ["user_id"], "t", "mark", 24 * HOUR).select("user_id", "mark", "n")


def _hourly(df: DataFrame) -> DataFrame:
    return df.withColumn("dts", F.floor(F.col("t") / HOUR))


def pair_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, dep = _hourly(stream(spark, sf_dir, "view")), _hourly(stream(spark, sf_dir, "click"))
    return pairing.paired(base.select("user_id", "dts", "event_id"), dep, ["user_id", "dts"], ["t", "event_id"], {"event_id": "dependent_id"})


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = stream(spark, sf_dir, "view"), stream(spark, sf_dir, "click")
    a = a.select("user_id", F.col("t").alias("ta"), F.col("event_id").alias("left_id"))
    b = b.select("user_id", F.col("t").alias("tb"), F.col("event_id").alias("right_id"))
    return pairing.zipped(a, b, ["user_id"], ["ta", "left_id"], ["tb", "right_id"], skip=1).select("user_id", "place", "left_id", "right_id")


def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stream(spark, sf_dir, k) for k in ("view", "click", "purchase")]
    return pairing.merged(parts, ["user_id"], "t", ["event_id"], "place").select("user_id", "event_id", "source", "place")


def first_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _hourly(stream(spark, sf_dir, "click")), _hourly(stream(spark, sf_dir, "view"))
    return pairing.merged([a, b], ["user_id"], "dts", ["event_id"], "place").select("user_id", "event_id", "source", "place")


def first_wins_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _hourly(stream(spark, sf_dir, "click")), _hourly(stream(spark, sf_dir, "view"))
    parts = [x.select("user_id", "dts", "event_id") for x in (a, b)]
    return pairing.first_wins(parts, ["user_id", "dts"])


QUERIES = {f.__name__: f for f in (asof_offset, group_offset, layers, nearest_mask, interval_last_wins, range_count, pair_left_outer, positional_zip, merge_order, first_wins_merge, first_wins_union)}

_E = "WITH e AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) // 3600000000 AS dts, event_id, event_type, value FROM events) "

ORACLES = {
    "asof_offset": _E
    + """
        , k AS (SELECT user_id, t, event_id, value FROM e WHERE event_type = 'purchase')
        SELECT v.user_id, v.event_id, k.event_id AS key_id, k.value AS "offset"
        FROM e v ASOF LEFT JOIN k ON v.user_id = k.user_id AND v.t >= k.t WHERE v.event_type = 'view'""",
    "group_offset": _E
    + """
        , k AS (SELECT user_id, t, event_id, value FROM e WHERE event_type = 'purchase')
        SELECT v.user_id, v.event_id, CASE WHEN k.t IS NOT NULL THEN (least((v.t - k.t) // 21600000000, floor(k.value)::BIGINT % 5) + 1) * 10 + k.event_id % 7 END::BIGINT AS "offset"
        FROM e v ASOF LEFT JOIN k ON v.user_id = k.user_id AND v.t >= k.t WHERE v.event_type = 'view'""",
    "layers": _E
    + """
        , a AS (SELECT user_id, event_id AS left_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS place FROM e WHERE event_type = 'view'),
        b AS (SELECT user_id, event_id AS right_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS place FROM e WHERE event_type = 'click')
        SELECT user_id, place, left_id, right_id, 1 AS shown FROM a JOIN b USING (user_id, place)""",
    "nearest_mask": _E
    + """
        SELECT v.user_id, v.event_id, (SELECT arg_min(m.event_id, (abs(m.t - v.t), m.t)) FROM e m WHERE m.event_type = 'signup' AND m.user_id = v.user_id AND abs(m.t - v.t) <= 21600000000) AS mask_id
        FROM e v WHERE v.event_type = 'error'""",
    "interval_last_wins": _E
    + """
        , s AS (SELECT user_id, t AS a, CASE WHEN event_id % 10 = 0 THEN 0 ELSE t + floor(value * 60)::BIGINT * 1000000 END AS b, event_id AS line FROM e WHERE event_type = 'purchase')
        SELECT v.user_id, v.event_id, max(s.line) AS line
        FROM e v LEFT JOIN s ON s.user_id = v.user_id AND v.t >= s.a AND (s.b = 0 OR v.t < s.b) WHERE v.event_type = 'view' GROUP BY v.user_id, v.event_id""",
    "range_count": _E
    + """
        , m AS (SELECT user_id, t, event_id AS mark, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), 9000000000000000000) AS next FROM e WHERE event_type = 'purchase')
        SELECT m.user_id, m.mark, count(v.event_id) AS n
        FROM m LEFT JOIN e v ON v.event_type = 'view' AND v.user_id = m.user_id AND v.t >= m.t AND v.t < m.next GROUP BY m.user_id, m.mark""",
    "pair_left_outer": _E
    + """
        , d AS (SELECT user_id, dts, arg_min(event_id, (t, event_id)) AS dependent_id FROM e WHERE event_type = 'click' GROUP BY user_id, dts)
        SELECT b.user_id, b.dts, b.event_id, d.dependent_id FROM e b LEFT JOIN d ON b.user_id = d.user_id AND b.dts = d.dts WHERE b.event_type = 'view'""",
    "positional_zip": _E
    + """
        , a AS (SELECT user_id, event_id AS left_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS place FROM e WHERE event_type = 'view'),
        b AS (SELECT user_id, event_id AS right_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 2 AS place FROM e WHERE event_type = 'click')
        SELECT user_id, place, left_id, right_id FROM a JOIN b USING (user_id, place)""",
    "merge_order": _E
    + """
        , s AS (SELECT *, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS source FROM e WHERE event_type IN ('view', 'click', 'purchase'))
        SELECT user_id, event_id, source, row_number() OVER (PARTITION BY user_id ORDER BY t, source, event_id) AS place FROM s""",
    "first_wins_merge": _E
    + """
        , s AS (SELECT *, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS source FROM e WHERE event_type IN ('view', 'click'))
        SELECT user_id, event_id, source, row_number() OVER (PARTITION BY user_id ORDER BY dts, source, event_id) AS place FROM s""",
    "first_wins_union": _E
    + """
        , s AS (SELECT *, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS source FROM e WHERE event_type IN ('view', 'click'))
        SELECT user_id, dts, arg_min(event_id, (source, event_id)) AS event_id, min(source) AS source FROM s GROUP BY user_id, dts""",
}
