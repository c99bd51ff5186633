"""Titles and tracks: orders stand for playlists, line items for play items, parts for tracks (brand: source, type: codec and language)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.operators import folds, pairing, selection, timeline
from reeltide.tables import table

#: Which language a part's size stands for.
LANGS = ["eng", "por", "fre", "", "ger"]
#: Fixed values for this catalogue: the tier of a part type, first match first.
TIERS = [("promo", 4), ("economy", 3), ("standard", 3), ("large", 2), ("medium", 1)]


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, id, codec, lang, channels, kbps, commentary."""
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), F.col("p_size") % 5 + 1)
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source"), F.col("p_partkey").alias("id"), F.concat_ws("-", "p_type", "p_name").alias("codec"), lang.alias("lang"), (F.col("p_size") % 8).alias("channels"), F.floor("p_retailprice").cast("int").alias("kbps"), F.col("p_name").startswith("hot").alias("commentary")
    )


def rank() -> list[Column]:
    return [selection.first_match(F.col("codec"), TIERS, 0), F.col("channels"), F.col("kbps"), -F.col("id")]


def track_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    return t.where(selection.matches(F.col("lang"), F.col("codec"), F.col("commentary"), ["pt-br", "und", "de"], ["promo-r", "standardring", "gear"], True)).select("id", "lang", "codec")


def filter_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = selection.matches(F.col("lang"), F.col("codec"), F.col("commentary"), ["en", "fr"], [], False)
    return selection.guarded(tracks(spark, sf_dir), keep, ["source"]).select("source", "id", "offered")


def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best(tracks(spark, sf_dir), ["source"], rank(), ["id", "codec"])


def best_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_by_language(tracks(spark, sf_dir), ["source"], "lang", "id", rank(), ["pt", "por", "en"], ["id"])


def role_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = {"base": F.col("codec").startswith("PROMO-red"), "dependent": F.col("codec").startswith("LARGE-blue")}
    return selection.one_of_each(tracks(spark, sf_dir), ["source"], roles)


def fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("tier", selection.first_match(F.col("codec"), TIERS, 0))
    kept = t.where((F.col("tier") == 4) & (F.col("channels") >= 6))
    lossy = t.where((F.col("tier") < 4) & (F.col("tier") > 0))
    return selection.fallbacks(kept, lossy, ["source", "lang"], "id", [F.col("tier"), *rank()[1:]])


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, name, unique (distinct quantity of its items), items, marks."""
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    i = i.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("length"), F.sum("n").alias("items"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.floor("o_totalprice") % 7).alias("marks"))
    return o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "length", "items", "marks")


def title_rank_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("length"), F.col("marks"), -F.col("items"), -F.col("o_orderkey")]
    return selection.best(playlists(spark, sf_dir), ["o_custkey"], order, ["o_orderkey", "length"])


def title_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = playlists(spark, sf_dir).withColumn("three_d", F.col("o_orderkey") % 3 == 0)
    return folds.tolerant_best(p, ["o_custkey"], "o_orderkey", "length", "marks", "items", 10.0, "three_d")


def topk_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    p = playlists(spark, sf_dir)
    return selection.top_that_exist(p, ["o_custkey"], [F.desc("length"), "o_orderkey"], 5, returned, ["o_orderkey"]).select("o_custkey", "o_orderkey", "place")


def anti_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return pairing.missing(o, table(spark, sf_dir, "lineitem"), ["l_orderkey"])


def batch_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


def unique_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return timeline.durations(i, ["l_orderkey"], ["l_partkey", "l_quantity"], F.col("l_quantity"))


ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "length"]


def play_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("length"))


def trim_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.trimmed(play_items(spark, sf_dir), ["l_orderkey"], ITEM_ORDER, "length", 20, 90)


def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = play_items(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.sum("length").alias("length"))
    return i.withColumnsRenamed({"l_orderkey": "name", "l_linenumber": "item"})


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("item"), F.floor("o_totalprice").cast("long").alias("p"))
    return o.select("name", "item", (F.pmod(F.col("p") * F.col("item"), F.lit(13)) - 1).alias("t"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.chapters(numbered_items(spark, sf_dir), marks(spark, sf_dir), ["name"], "item", "length", "t").select("name", "item", "at")


def trim_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chapters(spark, sf_dir).withColumnRenamed("at", "t")
    return timeline.trimmed_chapters(c, ["name"], "t", ["item"], 30, 120).select("name", "item", "at")


def track_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text a source: its duration and its tracks in order. A source's tracks are few, as on a disc."""
    t = tracks(spark, sf_dir).groupBy("source").agg(F.sum("kbps").alias("duration"), F.array_sort(F.collect_list(F.struct("id", "codec", "lang", "channels"))).alias("tracks"))
    return t.select("source", F.to_json(F.struct("duration", "tracks")).alias("listing"))


QUERIES = {
    f.__name__: f
    for f in (
        track_filter, filter_guard, best_per_group, best_by_language, role_guard, fallbacks, title_rank_exact, title_fold, topk_exists, anti_guard, batch_except, unique_duration,
        trim_windows, chapters, trim_chapters, track_json,
    )
}

_T = """t AS (SELECT p_brand AS source, p_partkey AS id, p_type || '-' || p_name AS codec, list_extract(['eng', 'por', 'fre', '', 'ger'], p_size % 5 + 1) AS lang, p_size % 8 AS channels,
    floor(p_retailprice)::INT AS kbps, starts_with(p_name, 'hot') AS commentary,
    CASE WHEN contains(c, 'promo') THEN 4 WHEN contains(c, 'economy') OR contains(c, 'standard') THEN 3 WHEN contains(c, 'large') THEN 2 WHEN contains(c, 'medium') THEN 1 ELSE 0 END AS tier FROM (SELECT *, lower(p_type || '-' || p_name) AS c FROM part))"""
_P = """i AS (SELECT l_orderkey, sum(l_quantity) AS length, sum(n)::BIGINT AS items FROM (SELECT l_orderkey, l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey),
    p AS (SELECT o_custkey, o_orderkey, length, items, floor(o_totalprice)::BIGINT % 7 AS marks FROM orders JOIN i ON o_orderkey = l_orderkey)"""
_I = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS length FROM lineitem"
_C = """n AS (SELECT l_orderkey AS name, l_linenumber AS item, sum(l_quantity::BIGINT)::BIGINT AS length FROM lineitem GROUP BY ALL),
    s AS (SELECT name, item, coalesce(sum(length) OVER (PARTITION BY name ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun FROM n),
    m AS (SELECT o_orderkey AS name, item::INT AS item, floor(o_totalprice)::BIGINT * item % 13 - 1 AS t FROM orders, range(1, 6) r(item)),
    c AS (SELECT name, item, begun + t AS t FROM m JOIN s USING (name, item) WHERE t >= 0)"""

ORACLES = {
    "track_json": f"""WITH {_T} SELECT source, '{{"duration":' || sum(kbps) || ',"tracks":[' || string_agg('{{"id":' || id || ',"codec":"' || codec || '","lang":"' || lang || '","channels":' || channels || '}}', ',' ORDER BY id) || ']}}' AS listing FROM t GROUP BY source""",
    "track_filter": f"""WITH {_T} SELECT id, lang, codec FROM t WHERE NOT commentary AND coalesce(nullif(trim(lang), ''), 'und') IN ('por', 'pob', 'ptb', 'und', 'deu', 'ger')
        AND (contains(lower(codec), 'promo-r') OR contains(regexp_replace(lower(codec), '[^a-z0-9]', '', 'g'), 'promor') OR contains(regexp_replace(lower(codec), '[^a-z0-9]', '', 'g'), 'standardring') OR contains(lower(codec), 'gear'))""",
    "filter_guard": f"WITH {_T}, o AS (SELECT *, count(*) OVER (PARTITION BY source) AS offered FROM t) SELECT source, id, offered FROM o WHERE lang IN ('eng', 'fra', 'fre')",
    "best_per_group": f"WITH {_T} SELECT source, arg_max(id, (tier, channels, kbps, -id)) AS id, arg_max(codec, (tier, channels, kbps, -id)) AS codec FROM t GROUP BY source",
    "best_by_language": f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY tier DESC, channels DESC, kbps DESC, id) AS k FROM t WHERE lang IN ('por', 'eng'))
        SELECT source, id, (CASE WHEN lang = 'eng' THEN 2 ELSE k - 1 END)::INT AS place FROM r WHERE (lang = 'eng' AND k = 1) OR (lang = 'por' AND k <= 2)""",
    "role_guard": f"""WITH {_T}, c AS (SELECT source, count(*) FILTER (starts_with(codec, 'PROMO-red')) AS n_base, count(*) FILTER (starts_with(codec, 'LARGE-blue')) AS n_dependent FROM t GROUP BY source)
        SELECT *, n_base = 1 AND n_dependent = 1 AS ok FROM c""",
    "fallbacks": f"""WITH {_T}, k AS (SELECT source, lang, id AS kept_id, row_number() OVER (PARTITION BY source, lang ORDER BY id) AS n FROM t WHERE tier = 4 AND channels >= 6),
        f AS (SELECT source, lang, id AS fallback_id, row_number() OVER (PARTITION BY source, lang ORDER BY tier DESC, channels DESC, kbps DESC, id) AS n FROM t WHERE tier BETWEEN 1 AND 3)
        SELECT source, lang, kept_id, fallback_id FROM k JOIN f USING (source, lang, n)""",
    "title_rank_exact": f"WITH {_P} SELECT o_custkey, arg_max(o_orderkey, (length, marks, -items, -o_orderkey)) AS o_orderkey, max(length) AS length FROM p GROUP BY o_custkey",
    "title_fold": f"""WITH RECURSIVE {_P}, o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM p), f AS (
        SELECT o_custkey, rn, o_orderkey, length, marks, items FROM o WHERE rn = 1
        UNION ALL
        SELECT o.o_custkey, o.rn, CASE WHEN b THEN o.o_orderkey ELSE f.o_orderkey END, CASE WHEN b THEN o.length ELSE f.length END, CASE WHEN b THEN o.marks ELSE f.marks END, CASE WHEN b THEN o.items ELSE f.items END
        FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.rn = f.rn + 1,
             LATERAL (SELECT CASE WHEN abs(o.length - f.length) > 10 THEN o.length > f.length WHEN o.marks <> f.marks THEN o.marks > f.marks WHEN (o.o_orderkey % 3 = 0) <> (f.o_orderkey % 3 = 0) THEN o.o_orderkey % 3 <> 0 WHEN o.items <> f.items THEN o.items < f.items ELSE o.o_orderkey < f.o_orderkey END AS b))
        SELECT o_custkey, arg_max(o_orderkey, rn) AS o_orderkey FROM f GROUP BY o_custkey""",
    "topk_exists": f"""WITH {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY length DESC, o_orderkey)::INT AS place FROM p)
        SELECT o_custkey, o_orderkey, place FROM k WHERE place <= 5 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l_returnflag = 'R')""",
    "anti_guard": "SELECT o_orderkey AS l_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "batch_except": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "unique_duration": """SELECT l_orderkey, sum(l_quantity * n) AS duration, sum(l_quantity) AS unique_duration
        FROM (SELECT l_orderkey, l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""",
    "trim_windows": f"""WITH x AS ({_I}), a AS (SELECT *, coalesce(sum(length) OVER w, 0) AS at_t FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        b AS (SELECT *, greatest(20 - at_t, 0) AS lo, least(90 - at_t, length) AS hi FROM a), c AS (SELECT *, CASE WHEN hi > lo THEN lo ELSE 0 END AS low, CASE WHEN hi > lo THEN hi ELSE 0 END AS high FROM b)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, length, low::BIGINT AS low, high::BIGINT AS high,
               coalesce(sum(high - low) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c""",
    "chapters": f"WITH {_C} SELECT name, item, t AS at FROM c",
    "trim_chapters": f"""WITH {_C}, l AS (SELECT *, lead(t) OVER (PARTITION BY name ORDER BY t, item) AS next FROM c)
        SELECT name, item, greatest(t - 30, 0) AS at FROM l WHERE t < 120 AND (next IS NULL OR next > 30)""",
}
