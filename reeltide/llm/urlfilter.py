"""URL filters: rules first, then the reputation of the host by empirical Bayes.

Labelled page outcomes (bad or good) are counted by host; a beta-binomial prior is passed down from the suffix to the
registered domain to the host, with strengths fitted by moments from the spread between groups, and a host is blocked when
the lower posterior bound of its share of bad pages is above a limit. An outcome is a label of the document that a page shows, whose number its path ends with. Names that
speak for themselves are prior knowledge, no verdict: a host with such a part has a prior of its own, of NAMED_RATE with the strength of NAMED_STRENGTH pages, which outcomes overrule as they do any prior.

Scale: pages are read as narrow rows (id, host, path); counts are combined before they are shuffled, so a hot host costs one row
a task; the table of hosts is broadcast only up to a checked number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.llm.common import durable, look_up, read, strength

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Parts of a host name (between dots and hyphens) that give it the prior of NAMED_RATE and NAMED_STRENGTH.
BAD_PARTS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "track", "viagra", "warez")

NAMED_RATE, NAMED_STRENGTH = 0.9, 20.0

#: Second-level labels under which names are registered one level deeper, as in co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: What stands for the suffix of hosts that are addresses.
ADDRESS = "(address)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # later ones, the longer, win
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def site_of(host: Column) -> Column:
    """A host without the user and the port: what reputation is kept for."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


def is_address(site: Column) -> Column:
    return site.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^\[")


def registered(site: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The last two labels of a site, three under names such as co.uk; an address is its own domain."""
    labels = F.split(site, r"\.")
    deep = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*second_level)
    return F.when(is_address(site), site).when(deep, F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(site, path) -> counts by site: site, n, bad.

    A page is bad if the document that its path ends with is labelled as of no quality or toxic, good if that is labelled otherwise; other pages have no
    outcome. Several labels of a document count as bad if any is.
    """
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    known = known.groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    doc = F.regexp_extract("path", r"/(\d{1,18})[^/]*/?$", 1)
    seen = pages.select("site", F.when(doc != "", doc.cast("long")).alias("doc_id")).where("doc_id IS NOT NULL")
    return seen.join(known, "doc_id").groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))


def by_name(site: Column, bad_parts: tuple[str, ...]) -> Column:
    return site.rlike(rf"(^|[.\-])({'|'.join(bad_parts)})([.\-]|$)") if bad_parts else F.lit(False)


def reputation(sites: DataFrame, asked: DataFrame, z: float = 1.28, bad_parts: tuple[str, ...] = BAD_PARTS) -> DataFrame:
    """(site, n, bad), and the sites that are asked for -> site, rate, lower: posterior mean and lower bound of the share of bad pages.

    The suffix is shrunk towards the whole, the domain towards its suffix, the host towards its domain, or, if its name has one of `bad_parts`, towards NAMED_RATE with NAMED_STRENGTH. The bound is the mean less z
    posterior standard deviations. Sites without outcomes have the posterior of their domain, of their suffix if that has none either, or of the whole.
    """
    hosts = asked.select("site").distinct().join(sites, "site", "left").select("site", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "bad")])
    suffix = F.when(is_address(F.col("site")), ADDRESS).otherwise(F.substring_index("domain", ".", -1))
    hosts = durable(hosts.withColumn("domain", registered(F.col("site"))).withColumn("suffix", suffix))
    sums = lambda by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = ((whole["bad"] or 0) + 1) / ((whole["n"] or 0) + 2)

    def shrunk(groups: DataFrame, towards: Column, out: str) -> DataFrame:
        k = strength(groups.where("n > 0"), towards)
        return groups.withColumn(out, (F.col("bad") + k * towards) / (F.col("n") + k)).withColumn("weight", F.col("n") + F.lit(k))

    suffixes = shrunk(sums(["suffix"]), F.lit(base), "suffix_rate").select("suffix", "suffix_rate")
    domains = look_up(sums(["suffix", "domain"]), suffixes, ["suffix"])
    domains = shrunk(domains, F.col("suffix_rate"), "domain_rate").select("domain", "domain_rate")
    hosts = look_up(hosts, domains, ["domain"])
    k, named = F.lit(strength(hosts.where("n > 0"), F.col("domain_rate"))), by_name(F.col("site"), bad_parts)
    hosts = hosts.withColumns({"k": F.when(named, NAMED_STRENGTH).otherwise(k), "towards": F.when(named, NAMED_RATE).otherwise(F.col("domain_rate"))})
    out = hosts.withColumns({"rate": (F.col("bad") + F.col("k") * F.col("towards")) / (F.col("n") + F.col("k")), "weight": F.col("n") + F.col("k")})
    return out.select("site", "rate", (F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))).alias("lower"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = 0.4, bad_parts: tuple[str, ...] = BAD_PARTS) -> DataFrame:
    """Every page's url judged: page_id, host, path, rule, verdict, reason, rate, lower.

    verdict is that of the longest fitting rule, else block where the lower bound of the host, whether it has outcomes or not, is above `limit`, else allow; reason is rule or reputation. A name with one of `bad_parts` is known to the host's prior only. A null url, one without :// and an empty host have empty parts, no rule and
    allow. Repeated rows are judged each; an empty table of labels leaves the rules and the priors; an empty table of pages gives no rows. Other columns are not read.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("site", site_of(F.col("host")))
    named = parts.where("site <> ''")
    known = reputation(outcomes(named, labels.select("doc_id", "quality", "toxic")), named, bad_parts=bad_parts)
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    told = look_up(parts, known, ["site"]).withColumns({"rule": rule, "verdict": verdict})
    judged = F.coalesce("verdict", F.when(F.col("lower") > limit, "block").otherwise("allow"))
    reason = F.when(F.col("verdict").isNotNull(), "rule").otherwise("reputation")
    return told.select("page_id", "host", "path", "rule", judged.alias("verdict"), reason.alias("reason"), "rate", "lower")


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")).drop("rate", "lower")


QUERIES = {"op7_urlfilter": op7_urlfilter}
ORACLES = {
    "op7_urlfilter": r"""
    WITH parts AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    marked AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS site FROM parts),
    paged AS (SELECT *, nullif(regexp_extract(path, '/(\d{1,18})[^/]*/?$', 1), '')::BIGINT AS doc_id FROM marked),
    known AS (SELECT doc_id, max((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS bad FROM labels
              WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
    hosts AS (SELECT site, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(site, '.') AS l, regexp_matches(site, '^\d{1,3}(\.\d{1,3}){3}$|^\[') AS address
              FROM paged LEFT JOIN known USING (doc_id) WHERE site <> '' GROUP BY site),
    named AS (SELECT site, n, bad, CASE WHEN address THEN site ELSE array_to_string(list_slice(l, greatest(1, len(l) - CASE WHEN len(l) >= 3 AND length(l[-1]) = 2
              AND l[-2] IN ('ac', 'co', 'com', 'edu', 'go', 'gob', 'gouv', 'gov', 'gv', 'ltd', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'plc', 'sch') THEN 2 ELSE 1 END), len(l)), '.') END AS domain,
              CASE WHEN address THEN '(address)' ELSE l[-1] END AS suffix FROM hosts),
    base AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS rate FROM named),
    s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT rate FROM base) AS up FROM named GROUP BY suffix),
    sk AS (SELECT CASE WHEN coalesce(sum(n * up * (1 - up)), 0) = 0 OR sum(n) = count(*) THEN 2.0 ELSE 1 / least(0.9, greatest(0.02, (sum(n * (bad / n - up) ** 2) / sum(n * up * (1 - up)) - count(*) / sum(n)) / (1 - count(*) / sum(n)))) - 1 END AS k FROM s WHERE n > 0),
    sr AS (SELECT suffix, (bad + k * up) / (n + k) AS rate FROM s, sk),
    d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS up FROM named JOIN sr USING (suffix) GROUP BY suffix, domain),
    dk AS (SELECT CASE WHEN coalesce(sum(n * up * (1 - up)), 0) = 0 OR sum(n) = count(*) THEN 2.0 ELSE 1 / least(0.9, greatest(0.02, (sum(n * (bad / n - up) ** 2) / sum(n * up * (1 - up)) - count(*) / sum(n)) / (1 - count(*) / sum(n)))) - 1 END AS k FROM d WHERE n > 0),
    dr AS (SELECT domain, (bad + k * up) / (n + k) AS up FROM d, dk),
    h AS (SELECT site, n, bad, up FROM named JOIN dr USING (domain)),
    hk AS (SELECT CASE WHEN coalesce(sum(n * up * (1 - up)), 0) = 0 OR sum(n) = count(*) THEN 2.0 ELSE 1 / least(0.9, greatest(0.02, (sum(n * (bad / n - up) ** 2) / sum(n * up * (1 - up)) - count(*) / sum(n)) / (1 - count(*) / sum(n)))) - 1 END AS k FROM h WHERE n > 0),
    hp AS (SELECT site, n, bad, CASE WHEN named THEN 20 ELSE k END AS k, CASE WHEN named THEN 0.9::DOUBLE ELSE up END AS up
           FROM (SELECT h.*, k, regexp_matches(site, '(^|[.\-])(ads|adult|bets|casino|pills|porn|spam|track|viagra|warez)([.\-]|$)') AS named FROM h, hk)),
    hr AS (SELECT site, (bad + k * up) / (n + k) AS rate, n + k AS weight FROM hp),
    told AS (SELECT page_id, host, path, rate - 1.28 * sqrt(rate * (1 - rate) / (weight + 1)) AS lower,
        CASE WHEN host LIKE '%.example.org' OR host = 'example.org' THEN
                  CASE WHEN starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN starts_with(path, '/es/') THEN 'example.org/es/' WHEN starts_with(path, '/') THEN 'org/' END
             WHEN (host LIKE '%.org' OR host = 'org') AND starts_with(path, '/') THEN 'org/'
             WHEN (host LIKE '%.com' OR host = 'com') AND starts_with(path, '/fr/') THEN 'com/fr/'
             WHEN (host LIKE '%.com' OR host = 'com') AND starts_with(path, '/de/') THEN 'com/de/' END AS rule
        FROM paged LEFT JOIN hr USING (site))
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower > 0.4 THEN 'block' ELSE 'allow' END AS verdict,
        CASE WHEN rule IS NOT NULL THEN 'rule' ELSE 'reputation' END AS reason FROM told
    """,
}
