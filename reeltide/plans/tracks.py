"""Facts and names of tracks, defaults, routes and windows of packets: parts stand for tracks, events for packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.functions import tracks as facts
from reeltide.functions.clock import micros
from reeltide.operators import measures, routing, selection
from reeltide.tables import table

DAY = 86_400_000_000
STREAMS = ["V_MPEG4/ISO/AVC", "V_MPEGH/ISO/HEVC", "V_MPEG4/ISO/MVC", "V_MPEGH/ISO/HEVC/EL", "A_TRUEHD", "A_DTS-HD MASTER", "A_E-AC3", "A_AC3", "A_LPCM", "A_OPUS", "S_HDMV/PGS", "S_TEXT/UTF8", "X_OTHER"]
SAID = ["en", "pt-br", "DEU", "xx", "kor", "français", ""]
CALLED = [" English SDH", "Portuguese (Brazil)", "Forced English", "castellano", "Deutsch", "Commentary", "foreign parts"]


def _pick(values: list[str], place) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), place.cast("int"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    info = F.concat(F.when(k % 4 == 0, "Atmos ").otherwise(""), F.lit("Channels: "), k % 8, F.when(k % 3 == 0, ".1").otherwise(""))
    return p.select(F.col("p_brand").alias("source"), k.alias("id"), _pick(STREAMS, k * 7 % 13).alias("stream"), info.alias("info"), _pick(SAID, k % 7).alias("said"), _pick(CALLED, k % 11 % 7).alias("name"), (k % 9 == 0).alias("forced"))


def track_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    lang = facts.described(facts.language_code(F.col("said")), facts.language_of_name(F.col("name")))
    return p.select("id", facts.kind(F.col("stream")).alias("kind"), facts.audio_tag(F.substr("stream", F.lit(3)), F.col("info")).alias("tag"), facts.language_code(F.col("said")).alias("code"), facts.language_of_name(F.col("name")).alias("named"), lang.alias("lang"))


def flat_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).withColumn("kind", facts.kind(F.col("stream")))
    return routing.flat_selection(p.withColumn("source", F.col("id") % 60), ["source"], "kind", "stream", "id", "id")


def default_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir).withColumns({"kind": facts.kind(F.col("stream")), "source": F.col("id") % 60})
    wanted = selection.language(facts.language_code(F.col("said"))).isin(*selection.spelled(["en", "pt"]))
    return routing.default_tracks(p, ["source"], "kind", wanted, "name", "forced", "id", "id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", micros("ts").alias("t"), "event_id", "event_type", "value")


def packet_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pid = F.col("event_id") * 31 % 64
    r = events(spark, sf_dir).withColumn("route", routing.route(pid, F.col("user_id") % 3 == 0, pid % 5 == 0, pid == 40, 17, 20))
    return r.groupBy("user_id").agg(F.count_if(F.col("route") == "a").alias("a"), F.count_if(F.col("route") == "b").alias("b"), F.count_if(F.col("route").isNull()).alias("gone"))


def packet_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    first = e.groupBy("user_id").agg((F.min("t") + 4 * DAY).alias("begin"), (F.min("t") + 20 * DAY).alias("end"))
    role = F.when(F.col("event_type") == "view", "base").when(F.col("event_type") == "click", "dependent").when(F.col("event_type") == "purchase", "kept").when(F.col("event_type") == "error", "clock").otherwise("other")
    p = e.join(first, "user_id").withColumns({"role": role, "pts": F.col("t") + F.floor("value") * 3_600_000_000, "key": F.col("event_id") % 3 == 0})
    p = p.withColumn("seq", F.struct("t", "event_id"))
    return routing.kept_packets(p, ["user_id"], "seq", "role", "pts", "t", "key", "begin", "end").select("user_id", "event_id")


def edge_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", "t", F.col("event_id").alias("size")).groupBy("user_id", "t").agg(F.sum("size").alias("size"))
    begin = F.lit(1_706_000_000_000_000)
    return routing.edge_frames(e, ["user_id"], "t", "size", begin, begin + 30 * DAY)


def first_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.from_first_picture(events(spark, sf_dir), ["user_id"], "t", F.col("event_type") == "purchase").select("user_id", "event_id")


def audio_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    rows = e.select("user_id", "t", "event_id", F.when(F.col("event_type") != "signup", 1024 + F.col("event_id") % 512).alias("samples"), F.when(F.col("event_type") == "signup", F.floor("value") * 1_000_000).alias("sync"))
    return routing.audio_clock(rows, ["user_id"], "t", ["event_id"], "samples", "sync", ["event_id"], 48_000, 40_000_000)


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.entry_points(events(spark, sf_dir), ["event_type"], ["t", "event_id"], F.floor(F.col("t") / DAY), F.col("event_id") % 12 == 0, ["event_id"])


def group_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.group_lengths(events(spark, sf_dir), ["event_type"], ["t", "event_id"], F.floor(F.col("t") / DAY), F.col("event_id") % 12 == 0)


def layer_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each layer, the share of units of the base that have none of the other layer at their time, and the greatest loss."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_linenumber") % 2).alias("layer"), F.col("l_quantity").cast("long").alias("size"))
    at = l.groupBy("l_suppkey", "l_orderkey").agg(*[F.sum(F.when(F.col("layer") == k, F.col("size"))).alias(n) for k, n in ((0, "base"), (1, "other"))])
    has = F.col("base").isNotNull()
    return at.groupBy("l_suppkey").agg(F.sum("base").alias("base_bytes"), F.sum("other").alias("other_bytes"), F.round(F.count_if(has & F.col("other").isNull()) / F.count_if(has), 9).alias("missing"), F.max(F.when(~has, F.col("other"))).alias("dropped"))


def subtitle_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the disparity a hundredth from the greatest, and one more, where that is above 0."""
    e = events(spark, sf_dir).withColumn("disparity", F.col("value") - 120)
    p = measures.element_at_rank(e, ["user_id"], "disparity", F.col("n") - 1 - F.floor(F.col("n") / 100), "p")
    return p.select("user_id", F.round(F.when(F.col("p") > 0, F.col("p") / 2 + 1).otherwise(0.0), 6).alias("offset"))


def normal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    num, den = k % 13 * (k % 5 + 1) * 1000 + F.when(k % 3 == 0, 0).otherwise(k % 40), F.when(k % 2 == 0, 1001).otherwise(1000) * (k % 5 + 1)
    return table(spark, sf_dir, "part").select(k, facts.normal_rate(num, den).alias("r")).select("p_partkey", "r.num", "r.den")


def disc_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k, facts.disc_channel(F.when(k % 2 == 0, 8).otherwise(6), k % 3 > 0, k % 8).cast("long").alias("channel"))


def respelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with capital I taken for l wherever it stands, put right again as far as the rule goes."""
    return table(spark, sf_dir, "documents").select("doc_id", facts.respelled(F.translate("text", "I", "l")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        track_facts, flat_selection, default_tracks, packet_routes, packet_keep, edge_frames, first_picture, audio_clock, entry_points, group_lengths, layer_bytes, subtitle_offset, normal_rates,
        disc_channels, respelled,
    )
}

_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_ALIASES = "MAP {" + ", ".join(f"'{k}': '{v[0]}'" for k, v in selection.LANG_ALIASES.items()) + "}"
_CODE = f"coalesce({_ALIASES}[lower(said)], CASE WHEN strlen(said) = 3 THEN lower(said) END, '')"
_NAMED = "CASE " + " ".join(f"WHEN starts_with(lower(trim(name)), '{b}') THEN '{l}'" for b, l in facts.NAMES) + " ELSE '' END"
_KIND = "CASE WHEN stream IN ('V_MPEG4/ISO/MVC', 'V_MPEGH/ISO/HEVC/MV') THEN 'dependent' WHEN stream = 'V_MPEGH/ISO/HEVC/EL' THEN 'enhancement' WHEN stream IN ('V_MPEG4/ISO/AVC', 'V_MPEGH/ISO/HEVC', 'V_MS/VFW/FOURCC', 'V_MPEG2') THEN 'base' WHEN starts_with(stream, 'A_') THEN 'audio' WHEN starts_with(stream, 'S_') THEN 'subtitles' ELSE 'other' END"
_P = f"""p AS (SELECT p_brand AS source, p_partkey AS id, {_LIST(STREAMS)}[p_partkey * 7 % 13 + 1] AS stream, CASE WHEN p_partkey % 4 = 0 THEN 'Atmos ' ELSE '' END || 'Channels: ' || p_partkey % 8 || CASE WHEN p_partkey % 3 = 0 THEN '.1' ELSE '' END AS info,
    {_LIST(SAID)}[p_partkey % 7 + 1] AS said, {_LIST(CALLED)}[p_partkey % 11 % 7 + 1] AS name, p_partkey % 9 = 0 AS forced FROM part), k AS (SELECT *, {_KIND} AS kind, {_CODE} AS code, {_NAMED} AS named FROM p)"""
_E = "e AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type, value FROM events)"
_SOUND = "CASE " + " ".join(f"WHEN contains(b, '{part}') THEN " + ("CASE WHEN contains(upper(info), 'ATMOS') THEN 'TrueHD-Atmos' ELSE 'TrueHD' END" if part == "TRUE" else f"'{called}'") for part, called in facts.SOUNDS) + " ELSE regexp_replace(regexp_replace(substr(stream, 3), '[^A-Za-z0-9.+]+', '-', 'g'), '^-+|-+$', '', 'g') END"

ORACLES = {
    "track_facts": f"""WITH {_P} SELECT id, kind, {_SOUND} || ' ' || id % 8 || CASE WHEN id % 3 = 0 THEN '.1' ELSE '.0' END AS tag, code, named, CASE WHEN code <> '' THEN code WHEN length(named) = 3 THEN named ELSE '' END AS lang FROM (SELECT *, upper(substr(stream, 3)) AS b FROM k)""",
    "flat_selection": f"""WITH {_P}, s AS (SELECT id % 60 AS source, arg_min(id, id) FILTER (kind = 'base') AS base, arg_min(stream, id) FILTER (kind = 'base') AS coded, min(id) FILTER (kind = 'enhancement') AS enhancement,
        count(*) FILTER (kind = 'audio') AS audio, count(*) FILTER (kind = 'subtitles') AS subtitles FROM k GROUP BY id % 60)
        SELECT source, base, CASE WHEN coded = 'V_MPEGH/ISO/HEVC' THEN enhancement END AS enhancement, audio, subtitles FROM s""",
    "default_tracks": f"""WITH {_P}, w AS (SELECT * EXCLUDE (source), id % 60 AS source, code IN ('eng', 'por', 'pob', 'ptb') AS wanted, lower(name) AS low FROM k)
        SELECT source, min(id) FILTER (wanted AND kind = 'audio') AS audio, arg_min(id, (contains(low, 'sdh'), id)) FILTER (wanted AND kind = 'subtitles' AND NOT forced AND NOT contains(low, 'forced') AND NOT contains(low, 'foreign')) AS subtitles FROM w GROUP BY source""",
    "packet_routes": """WITH p AS (SELECT user_id, event_id * 31 % 64 AS pid, user_id % 3 = 0 AS dep FROM events),
        r AS (SELECT user_id, CASE WHEN pid IN (0, 31, 8191) OR pid = 40 OR NOT (pid = 17 OR pid % 5 = 0) OR (dep AND pid = 17) THEN NULL WHEN dep OR pid = 20 THEN 'b' ELSE 'a' END AS route FROM p)
        SELECT user_id, count(*) FILTER (route = 'a') AS a, count(*) FILTER (route = 'b') AS b, count(*) FILTER (route IS NULL) AS gone FROM r GROUP BY user_id""",
    "packet_keep": f"""WITH {_E}, f AS (SELECT user_id, min(t) + 345600000000 AS a, min(t) + 1728000000000 AS b FROM e GROUP BY user_id), p AS (SELECT e.*, a, b, t + floor(value)::BIGINT * 3600000000 AS pts, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e JOIN f USING (user_id)),
        k AS (SELECT user_id, min(n) AS begun FROM p WHERE event_type = 'view' AND event_id % 3 = 0 AND t >= a GROUP BY user_id), c AS (SELECT user_id, min(n) AS stop FROM p WHERE event_type = 'view' AND t >= b GROUP BY user_id)
        SELECT p.user_id, p.event_id FROM p LEFT JOIN k USING (user_id) LEFT JOIN c USING (user_id)
        WHERE CASE event_type WHEN 'view' THEN n >= begun AND t < b WHEN 'click' THEN n >= begun AND t < b WHEN 'purchase' THEN pts >= a AND pts < b WHEN 'error' THEN n >= begun AND n < coalesce(stop, 9000000000) ELSE false END""",
    "edge_frames": f"""WITH {_E}, g AS (SELECT user_id, t, sum(event_id)::BIGINT AS size FROM e GROUP BY ALL), w AS (SELECT *, 1706000000000000 AS a, 1706000000000000 + 2592000000000 AS b FROM g),
        s AS (SELECT user_id, count(*) FILTER (t >= a AND t < b) AS n, coalesce(sum(size) FILTER (t < a OR t >= b), 0) AS gone, max(t) FILTER (t < a) AS held, arg_max(size, t) FILTER (t < a) AS size, min(t) FILTER (t >= a AND t < b) AS first, any_value(a) AS a FROM w GROUP BY user_id),
        x AS (SELECT *, coalesce(n > 0 AND a - held < first - a, false) AS early FROM s)
        SELECT user_id, n + early::INT AS kept, (gone - CASE WHEN early THEN size ELSE 0 END)::BIGINT AS dropped, early FROM x""",
    "first_picture": f"WITH {_E} SELECT e.user_id, event_id FROM e JOIN (SELECT user_id, min(t) AS t0 FROM e WHERE event_type = 'purchase' GROUP BY user_id) f ON f.user_id = e.user_id AND e.t >= t0",
    "audio_clock": f"""WITH RECURSIVE {_E}, n AS (SELECT user_id, event_id, CASE WHEN event_type <> 'signup' THEN 1024 + event_id % 512 END AS many, CASE WHEN event_type = 'signup' THEN floor(value)::BIGINT * 1000000 END AS sync,
            row_number() OVER (PARTITION BY user_id ORDER BY t, event_type <> 'signup', event_id) AS rn FROM e),
        f AS (SELECT user_id, 0::BIGINT AS rn, 0::BIGINT AS base, 0::BIGINT AS c, NULL::BIGINT AS seen, false AS started, NULL::BIGINT AS event_id, NULL::BIGINT AS "at", 0::BIGINT AS gap FROM n WHERE rn = 1
        UNION ALL
        SELECT n.user_id, n.rn, CASE WHEN n.many IS NOT NULL AND jump THEN seen ELSE base END, CASE WHEN n.many IS NULL THEN c WHEN jump THEN n.many ELSE c + n.many END, CASE WHEN n.many IS NULL THEN n.sync END, started OR n.many IS NOT NULL,
            CASE WHEN n.many IS NOT NULL THEN n.event_id END, CASE WHEN jump THEN seen ELSE clock END, CASE WHEN jump AND started THEN seen - clock ELSE 0 END
        FROM f JOIN n ON n.user_id = f.user_id AND n.rn = f.rn + 1, LATERAL (SELECT base + c * 1000000000 // 48000 AS clock) k, LATERAL (SELECT coalesce(seen - clock > 40000000, false) AS jump) j)
        SELECT user_id, event_id, "at", gap FROM f WHERE event_id IS NOT NULL""",
    "entry_points": f"WITH {_E} SELECT event_type, event_id, packet FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS packet FROM e) WHERE event_id % 12 = 0",
    "group_lengths": f"""WITH {_E} SELECT event_type, "group", count(*) AS pictures FROM (SELECT event_type, sum((event_id % 12 = 0)::INT) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS "group" FROM e) GROUP BY ALL""",
    "layer_bytes": """WITH a AS (SELECT l_suppkey, l_orderkey, sum(l_quantity::BIGINT) FILTER (l_linenumber % 2 = 0)::BIGINT AS base, sum(l_quantity::BIGINT) FILTER (l_linenumber % 2 = 1)::BIGINT AS other FROM lineitem GROUP BY ALL)
        SELECT l_suppkey, sum(base)::BIGINT AS base_bytes, sum(other)::BIGINT AS other_bytes, round(count(*) FILTER (base IS NOT NULL AND other IS NULL) / count(*) FILTER (base IS NOT NULL), 9) AS missing, max(other) FILTER (base IS NULL) AS dropped FROM a GROUP BY l_suppkey""",
    "subtitle_offset": """SELECT user_id, round(CASE WHEN p > 0 THEN p / 2 + 1 ELSE 0 END, 6) AS "offset" FROM (SELECT user_id, list_sort(list(value - 120))[count(*) - count(*) // 100] AS p FROM events GROUP BY user_id)""",
    "normal_rates": """WITH r(n, d) AS (VALUES (24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (48, 1), (50, 1), (60000, 1001), (60, 1), (100, 1), (120000, 1001), (120, 1)),
        p AS (SELECT p_partkey, p_partkey % 13 * (p_partkey % 5 + 1) * 1000 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 40 END AS num, CASE WHEN p_partkey % 2 = 0 THEN 1001 ELSE 1000 END * (p_partkey % 5 + 1) AS den FROM part),
        l AS (SELECT p_partkey, num // greatest(1, gcd(num, den)) AS num, den // greatest(1, gcd(num, den)) AS den FROM p),
        x AS (SELECT p_partkey, num, den, n, d, abs(1e9::DOUBLE / (1000000000 * den // num) - n / d) / (n / d) AS off, num = n AND den = d AS same FROM l, r WHERE num > 0),
        b AS (SELECT p_partkey, num, den, arg_min((n, d), off) AS best, min(off) AS off, max(same::INT) AS same FROM x GROUP BY ALL)
        SELECT p_partkey, CASE WHEN same = 1 OR off >= 0.002 THEN num ELSE best[1] END::BIGINT AS num, CASE WHEN same = 1 OR off >= 0.002 THEN den ELSE best[2] END::BIGINT AS den FROM b UNION ALL SELECT p_partkey, 0, 0 FROM p WHERE num <= 0""",
    "disc_channels": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN [0, 1, 2, 3, 6, 7, 4, 5][p_partkey % 8 + 1] ELSE p_partkey % 8 END::BIGINT AS channel FROM part",
    "respelled": """WITH w AS (SELECT doc_id, string_split(translate(text, 'I', 'l'), ' ') AS ws FROM documents),
        c AS (SELECT doc_id, list_transform(ws, lambda w: {'w': w, 'core': regexp_replace(w, '[.,!?;:"…]+$', '')}) AS cs FROM w)
        SELECT doc_id, array_to_string(list_transform(cs, lambda x: CASE WHEN MAP {WORDS}[x.core] IS NOT NULL THEN MAP {WORDS}[x.core] || substr(x.w, length(x.core) + 1)
            WHEN (regexp_matches(x.w, '\\p{Lu}') AND NOT regexp_matches(x.w, '[a-km-zß-öø-ÿ]')) OR regexp_replace(x.w, '^[.,!?;:"\\-…]+|[.,!?;:"\\-…]+$', '', 'g') = 'l' THEN translate(x.w, 'l', 'I')
            ELSE regexp_replace(x.w, '(^|[^\\p{L}])l([''’])', '\\1I\\2', 'g') END), ' ') AS text FROM c""".replace("WORDS", ", ".join("'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in facts.READ_WRONG.items())),
}
