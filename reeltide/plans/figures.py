"""Measures and scalar rules over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.functions import clock, numbers, text
from reeltide.operators import measures
from reeltide.operators.ranges import lagged
from reeltide.tables import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", clock.micros("ts").alias("t"), "event_id", "event_type", "value")


def worst_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element 1 % from the worst end where high is bad."""
    return measures.element_at_rank(events(spark, sf_dir), ["event_type"], "value", F.col("n") - 1 - F.floor(F.col("n") / 100), "p1", near=0.99)


def indexed_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.element_at_rank(events(spark, sf_dir), ["user_id"], "value", F.floor(F.col("n") / 2), "median")


def line_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.element_at_rank(events(spark, sf_dir), ["user_id"], "value", F.floor(F.col("n") * 2 / 3), "height")


def elementwise_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("top"), F.col("l_linenumber").cast("long").alias("bottom"), (F.col("l_partkey") % 97).alias("left"), "l_returnflag")
    return measures.least_bars(l, ["l_suppkey"], ["top", "bottom", "left"], F.col("l_returnflag") == "R", 4)


def two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.mean_of_means(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_suppkey"], "l_extendedprice")


def ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return l.agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("rate"), F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("mean_rate"))


def frame_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.spacing(events(spark, sf_dir), ["user_id"], "t")


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.spans(events(spark, sf_dir), ["user_id"], "t")


def fit_scale_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.fit(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")


def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice", (F.col("l_linenumber") / 7).alias("w"))
    return measures.ridge(l, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "w", 10.0, "l_returnflag")


def held_out_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax", "l_extendedprice", (F.col("l_linenumber") / 7).alias("w"))
    return measures.ridge_errors(l, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "w", 10.0, "l_returnflag")


def from_best_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, the element 1 % from the worst end where low is bad, and the worst."""
    return measures.from_worst(events(spark, sf_dir), ["event_type"], "value", high_is_bad=False)


def bd_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes stand for the quality, prices for the bytes of a configuration (line status and return flag)."""
    l = table(spark, sf_dir, "lineitem").withColumn("config", F.concat("l_returnflag", "l_linestatus"))
    points = l.groupBy("l_linenumber", "config", (F.col("l_quantity") / 10).cast("int").alias("quality")).agg(F.sum("l_extendedprice").alias("size"))
    return measures.rate_difference(points, ["l_linenumber"], "config", "AF", "quality", "size")


def isotonic_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return measures.monotone_error(l, ["l_returnflag"], "l_quantity", "y", ["y", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], F.floor("l_quantity"))


def psnr_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lagged(table(spark, sf_dir, "embeddings"), ["label"], ["vec_id"], F.expr("vec_id div 64"), {"embedding": "before"}).where("before IS NOT NULL")
    return e.select("vec_id", F.round(measures.psnr("embedding", "before", 1.0, 60.0), 6).alias("psnr"))


def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.slug(F.concat(F.lit(" ("), "p_type", F.lit(") "), "p_name", F.lit(" 5.1+ / "))).alias("slug"), text.file_safe(F.col("p_brand")).alias("safe"))


def channels_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = F.concat(F.lit("channels: "), F.col("doc_id") % 8, F.when(F.col("doc_id") % 3 == 0, ".1").otherwise(""), F.lit(" Bitrate:"), F.col("n_chars"), F.lit(" kbps"))
    return table(spark, sf_dir, "documents").select("doc_id", text.channels(info).alias("channels"), text.bitrate(info).alias("kbps"))


def clock_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ms", F.expr("t div 1000") % 100_000_000)
    said = e.withColumn("clock", clock.clock_text(F.col("ms")))
    return said.select("event_id", "clock", clock.parse_clock(F.col("clock")).alias("back"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("event_id", clock.ticks_to_ns(F.col("t") % 4_000_000_000, 45_000).cast("long").alias("ns45"), clock.ticks_to_ns(F.col("t") % 4_000_000_000, 90_000).cast("long").alias("ns90"))


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.without_markup(F.col("html")).alias("text"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", (F.floor(F.col("value") * 100_000) + 8_000_000).alias("ns"))
    return e.select("event_id", numbers.rate_from_duration(F.col("ns")).alias("r")).where("r IS NOT NULL").select("event_id", "r.num", "r.den")


def tone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("e", F.col("value") / 500)
    return e.select("event_id", F.round(numbers.tone_curve(F.col("e"), 0.9, 0.58), 6).alias("bent"), F.round(numbers.hlg_scene(F.col("e")), 6).alias("scene"), F.round(numbers.curved(F.col("e") * 1.5, 0.7), 6).alias("near"), F.round(numbers.far_limit(-F.col("value"), 40.0, 28.0), 6).alias("far"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("K", "MB", "GiB", "", "x")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size") + F.lit(0.5), unit).alias("said"), "p_size")
    p = p.withColumn("fit", numbers.fit_box(F.col("p_size") * 100, F.col("p_partkey") % 1000 + 16, 1920, 1080))
    return p.select("p_partkey", numbers.size_bytes(F.col("said")).alias("bytes"), "fit.w", "fit.h")


QUERIES = {
    f.__name__: f
    for f in (
        worst_end, indexed_median, line_height, elementwise_min, two_level_mean, ratio_of_sums, frame_spacing, span, fit_scale_offset, ridge, held_out_errors, from_best_end, bd_rate, isotonic_curve, psnr_cap,
        slug, channels_regex, clock_format, ticks, plain_text, rates, tone_map, sizes,
    )
}

_N = 4  # the intercept and three features
_FEATURES = ("l_quantity", "l_discount", "l_tax")


def _elimination() -> str:
    """Gaussian elimination of a symmetric system a{i}_{j}, b{i} in the relation s0 (g), a step a relation; then x{i} from the last to the first."""
    out = []
    for k in range(_N - 1):
        cols = [f"a{i}_{j}" if i <= k else f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" for i in range(_N) for j in range(_N)]
        cols += [f"b{i}" if i <= k else f"b{i} - a{i}_{k} / a{k}_{k} * b{k} AS b{i}" for i in range(_N)]
        out.append(f"s{k + 1} AS (SELECT g, {', '.join(cols)} FROM s{k})")
    for i in reversed(range(_N)):
        known = "".join(f" - a{i}_{j} * x{j}" for j in range(i + 1, _N))
        out.append(f"t{i} AS (SELECT *, (b{i}{known}) / a{i}_{i} AS x{i} FROM {f't{i + 1}' if i + 1 < _N else f's{_N - 1}'})")
    return ", ".join(out)


_RIDGE = f"""WITH m AS (SELECT {', '.join(f'avg({f}) AS m{i}, stddev_pop({f}) AS s{i}' for i, f in enumerate(_FEATURES))} FROM lineitem),
    z AS (SELECT l_returnflag AS g, l_linenumber / 7.0::DOUBLE AS w, l_extendedprice AS y, 1.0::DOUBLE AS z0, {', '.join(f'({f} - m{i}) / s{i} AS z{i + 1}' for i, f in enumerate(_FEATURES))} FROM lineitem, m),
    own AS (SELECT g, {', '.join(f'sum(w * z{i} * z{j}) AS a{i}_{j}' for i in range(_N) for j in range(_N))}, {', '.join(f'sum(w * z{i} * y) AS b{i}' for i in range(_N))} FROM z GROUP BY g),
    s0 AS (SELECT g, {', '.join(f'sum(a{i}_{j}) OVER () - a{i}_{j}' + (' + 10' if i == j > 0 else '') + f' AS a{i}_{j}' for i in range(_N) for j in range(_N))}, {', '.join(f'sum(b{i}) OVER () - b{i} AS b{i}' for i in range(_N))} FROM own),
    {_elimination()}
    SELECT g AS l_returnflag, unnest(['intercept', {', '.join(f"'{f}'" for f in _FEATURES)}]) AS term, unnest([{', '.join(f'round(x{i}, 4)' for i in range(_N))}]) AS coefficient FROM t0"""

_ISOTONIC = """WITH n AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice / 1000 AS y, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_extendedprice / 1000, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
    b AS (SELECT g, (32 * i - 1) // n AS b, avg(x) AS bx, avg(y) AS y FROM n WHERE n >= 32 GROUP BY ALL),
    r AS (SELECT f.g, f.b AS first, l.b AS last, (SELECT avg(k.y) FROM b k WHERE k.g = f.g AND k.b BETWEEN f.b AND l.b) AS mean FROM b f JOIN b l ON f.g = l.g AND l.b >= f.b),
    c AS (SELECT g, b, bx, max(low) AS cy FROM (SELECT b.g, b.b, b.bx, r.first, min(r.mean) AS low FROM b JOIN r ON r.g = b.g AND r.first <= b.b AND r.last >= b.b GROUP BY ALL) GROUP BY ALL),
    p AS (SELECT *, lead(bx) OVER w AS nx, lead(cy) OVER w AS ny, b = 0 AS start FROM c WINDOW w AS (PARTITION BY g ORDER BY b)),
    e AS (SELECT n.g, n.y, CASE WHEN n.x <= (SELECT bx FROM p q WHERE q.g = n.g AND q.b = 0) THEN (SELECT cy FROM p q WHERE q.g = n.g AND q.b = 0)
        ELSE (SELECT arg_max(CASE WHEN nx IS NULL THEN cy WHEN nx = bx THEN cy ELSE cy + (n.x - bx) / (nx - bx) * (ny - cy) END, b) FROM p q WHERE q.g = n.g AND q.bx < n.x) END AS v FROM n WHERE n.n >= 32)
    SELECT g AS l_returnflag, round(avg(abs(v - y)), 6) AS epe, round(avg((abs(v - y) > 2)::INT), 6) AS bad FROM e GROUP BY g"""

_CUBIC = "(1 + 2 * t) * (1 - t) ** 2 * y + t * (1 - t) ** 2 * h * m + t * t * (3 - 2 * t) * ny + t * t * (t - 1) * h * nm"
_BD = f"""WITH p AS (SELECT l_linenumber AS k, l_returnflag || l_linestatus AS config, trunc(l_quantity / 10)::INT AS x, ln(sum(l_extendedprice)) AS y FROM lineitem GROUP BY ALL),
    d AS (SELECT *, lead(x) OVER w - x AS h, lead(y) OVER w AS ny, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d, count(*) OVER (PARTITION BY k, config) AS n FROM p WINDOW w AS (PARTITION BY k, config ORDER BY x)),
    l AS (SELECT *, lag(d) OVER w AS pd, lag(h) OVER w AS ph FROM d WHERE n > 1 WINDOW w AS (PARTITION BY k, config ORDER BY x)),
    m AS (SELECT *, CASE WHEN pd IS NULL THEN d WHEN d IS NULL THEN pd WHEN pd * d > 0 THEN (3 * ph + 3 * h) / ((2 * h + ph) / pd + (h + 2 * ph) / d) ELSE 0 END AS m FROM l),
    s AS (SELECT *, lead(m) OVER (PARTITION BY k, config ORDER BY x) AS nm FROM m),
    r AS (SELECT k, config, min(x) AS low, max(x) AS high FROM s GROUP BY ALL),
    o AS (SELECT a.k, b.config, greatest(a.low, b.low)::DOUBLE AS low, least(a.high, b.high)::DOUBLE AS high FROM r a JOIN r b ON a.k = b.k AND a.config = 'AF' AND b.config <> 'AF' WHERE least(a.high, b.high) > greatest(a.low, b.low)),
    q AS (SELECT k, config, low + (high - low) * (i + 0.5::DOUBLE) / 1000 AS q FROM o, range(1000) r(i)),
    v AS (SELECT q.k, q.config, (q.q - a.x) / a.h AS ta, (q.q - b.x) / b.h AS tb, a.y AS ya, a.h AS ha, a.m AS ma, a.ny AS nya, a.nm AS nma, b.y AS yb, b.h AS hb, b.m AS mb, b.ny AS nyb, b.nm AS nmb
        FROM q JOIN s a ON a.k = q.k AND a.config = 'AF' AND q.q > a.x AND q.q <= a.x + a.h JOIN s b ON b.k = q.k AND b.config = q.config AND q.q > b.x AND q.q <= b.x + b.h)
    SELECT k AS l_linenumber, config, round((exp(avg(({_CUBIC.replace("nm", "nmb").replace("ny", "nyb").replace(" y ", " yb ").replace("* h ", "* hb ").replace("* m ", "* mb ").replace("t", "tb")}) - ({_CUBIC.replace("nm", "nma").replace("ny", "nya").replace(" y ", " ya ").replace("* h ", "* ha ").replace("* m ", "* ma ").replace("t", "ta")}))) - 1) * 100, 6) AS bd_rate FROM v GROUP BY k, config"""

_ERRORS = _RIDGE.rsplit("SELECT g AS l_returnflag", 1)[0] + f"""SELECT z.g AS l_returnflag, count(*) AS rows, round(avg(abs(y - p)), 3) AS mean_error, round(avg(y - p), 3) AS bias
    FROM (SELECT z.g, z.y, {' + '.join(f'round(x{i}, 4) * z{i}' for i in range(_N))} AS p FROM z JOIN t0 ON t0.g = z.g) z GROUP BY z.g"""

ORACLES = {
    "ridge": _RIDGE,
    "held_out_errors": _ERRORS,
    "from_best_end": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[count(*) // 100 + 1] AS tail, min(value) AS worst FROM events GROUP BY event_type",
    "isotonic_curve": _ISOTONIC,
    "bd_rate": _BD,
    "worst_end": "SELECT event_type, count(*) AS n, list_sort(list(value))[count(*) - count(*) // 100] AS p1 FROM events GROUP BY event_type",
    "indexed_median": "SELECT user_id, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY user_id",
    "line_height": "SELECT user_id, count(*) AS n, list_sort(list(value))[count(*) * 2 // 3 + 1] AS height FROM events GROUP BY user_id",
    "elementwise_min": """SELECT l_suppkey, n, CASE WHEN n >= 4 THEN (a + 1) // 2 * 2 ELSE 0 END AS top, CASE WHEN n >= 4 THEN (b + 1) // 2 * 2 ELSE 0 END AS bottom, CASE WHEN n >= 4 THEN (c + 1) // 2 * 2 ELSE 0 END AS "left"
        FROM (SELECT l_suppkey, count(*) AS n, min(l_quantity::BIGINT) AS a, min(l_linenumber::BIGINT) AS b, min(l_partkey % 97) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey)""",
    "two_level_mean": "SELECT l_returnflag, count(*) AS groups, round(avg(m), 6) AS mean FROM (SELECT l_returnflag, l_suppkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL) GROUP BY l_returnflag",
    "ratio_of_sums": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice) / sum(l_quantity), 6) AS rate, round(avg(l_extendedprice / l_quantity), 6) AS mean_rate FROM lineitem GROUP BY ALL",
    "frame_spacing": "SELECT user_id, min(g) AS spacing FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events) WHERE g > 0 GROUP BY user_id",
    "span": "SELECT user_id, min(epoch_us(ts)) AS first_t, max(epoch_us(ts)) AS last_t, count(*) AS frames FROM events GROUP BY user_id",
    "fit_scale_offset": """SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 6) AS scale, round(regr_intercept(l_extendedprice, l_quantity), 6) AS "offset", round(corr(l_extendedprice, l_quantity), 6) AS corr FROM lineitem GROUP BY ALL""",
    "psnr_cap": """WITH b AS (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)
        SELECT vec_id, round(least(10 * log10(1.0::DOUBLE / greatest(list_sum(list_transform(list_zip(embedding, before), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)) / len(embedding), 1e-16::DOUBLE)), 60.0::DOUBLE), 6) AS psnr FROM b WHERE before IS NOT NULL""",
    "slug": """SELECT p_partkey, regexp_replace(regexp_replace(trim(' (' || p_type || ') ' || p_name || ' 5.1+ / '), '[^A-Za-z0-9.+]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS safe FROM part""",
    "channels_regex": "SELECT doc_id, (doc_id % 8 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::INT AS channels, n_chars::INT AS kbps FROM documents",
    "clock_format": """SELECT event_id, printf('%d:%02d:%02d.%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS clock, ms AS back FROM (SELECT event_id, epoch_us(ts) // 1000 % 100000000 AS ms FROM events)""",
    "ticks": "SELECT event_id, (epoch_us(ts) % 4000000000)::HUGEINT * 1000000000 // 45000 AS ns45, (epoch_us(ts) % 4000000000)::HUGEINT * 1000000000 // 90000 AS ns90 FROM events",
    "plain_text": r"SELECT page_id, regexp_replace(replace(regexp_replace(html, '<(/[A-Za-z]|[A-Za-z])[^>]*>', '', 'g'), chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g') AS text FROM pages",
    "rates": """WITH r(num, den) AS (VALUES (24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (48, 1), (50, 1), (60000, 1001), (60, 1), (100, 1), (120000, 1001), (120, 1)),
        e AS (SELECT event_id, floor(value * 100000)::BIGINT + 8000000 AS ns FROM events), x AS (SELECT event_id, num, den, abs(1e9::DOUBLE / ns - num / den) / (num / den) AS off FROM e, r)
        SELECT event_id, arg_min(num, off) AS num, arg_min(den, off) AS den FROM x WHERE off < 0.002 GROUP BY event_id""",
    "tone_map": """WITH e AS (SELECT event_id, value, value / 500 AS e FROM events), x AS (SELECT *, e / 0.9::DOUBLE AS x, 0.58::DOUBLE / 0.9::DOUBLE AS top FROM e), k AS (SELECT *, 1.5::DOUBLE * top - 0.5::DOUBLE AS ks FROM x),
        t AS (SELECT *, (least(x, 1) - ks) / (1 - ks) AS t FROM k)
        SELECT event_id, round(CASE WHEN x >= ks THEN ((2 * t ** 3 - 3 * t ** 2 + 1) * ks + (t ** 3 - 2 * t ** 2 + t) * (1 - ks) + (3 * t ** 2 - 2 * t ** 3) * top) * 0.9::DOUBLE ELSE e END, 6) AS bent,
               round(CASE WHEN e <= 0.5 THEN e * e / 3 ELSE (exp((e - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12 END, 6) AS scene,
               round(CASE WHEN e * 1.5 <= 0 THEN e * 1.5 WHEN e * 1.5 >= 1 THEN 1 + 0.7::DOUBLE * (e * 1.5 - 1) ELSE (e * 1.5) ** 0.7::DOUBLE END, 6) AS near,
               round(CASE WHEN value <= 28 THEN -value ELSE -(28 + (value - 28) / (1 + (value - 28) / 12)) END, 6) AS far FROM t""",
    "sizes": """WITH p AS (SELECT p_partkey, p_size + 0.5::DOUBLE AS v, p_partkey % 5 AS u, p_size * 100 AS w, p_partkey % 1000 + 16 AS h FROM part), k AS (SELECT *, least(1920.0::DOUBLE / w, 1080.0::DOUBLE / h) AS k FROM p)
        SELECT p_partkey, CASE u WHEN 0 THEN floor(v * 1e3::DOUBLE) WHEN 1 THEN floor(v * 1e6::DOUBLE) WHEN 2 THEN floor(v * 1073741824) WHEN 3 THEN floor(v) END::BIGINT AS bytes,
               CASE WHEN w <= 1920 AND h <= 1080 THEN w ELSE least(greatest(2, 2 * floor(w * k / 2 + 0.5)), 1920) END::INT AS w, CASE WHEN w <= 1920 AND h <= 1080 THEN h ELSE least(greatest(2, 2 * floor(h * k / 2 + 0.5)), 1080) END::INT AS h FROM k""",
}
