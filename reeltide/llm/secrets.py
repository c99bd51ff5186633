"""Secret scans: candidates by pattern, false positives removed by a random forest, all in SQL expressions.

Candidates are values after = or a colon (quoted ones, and unquoted ones after a name that speaks of secrets), passwords in URLs, signed tokens whose parts are joined by dots, and long runs of token
characters; a name before = is never part of its value. The forest reads their length, character classes and transitions, dictionary coverage, the path
(source) and the neighbouring words. It is trained on labelled findings, lines scanned as any text is; where none are given, on lines made from templates of
known kinds (`made_lines`), the same in every run. The dictionary are the words of the corpus itself that make up RATE of all its words or more, so at most
1 / RATE of them whatever the size of the corpus. The trained trees are written as arrays that built-in functions walk, so scanning is one map of built-in expressions.

Scale: the dictionary is one count of words, combined before its shuffle; a frequent word costs a row a task. A forest is fitted once a session and dictionary.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.llm.common import read

BEFORE, AFTER = 40, 20
MASK = "<SECRET>"
TREES, DEPTH, LIMIT = 20, 8, 0.5
#: A word of the corpus is in the dictionary from this share of all words.
RATE = 1e-4

SECRET_WORDS = "secret|token|passw|pwd|api[_\\- ]?key|apikey|access[_\\- ]?key|auth|bearer|credential|private[_\\- ]?key|signing|client[_\\- ]?key"
PLAIN_WORDS = "commit|sha-?\\d*|md5|hash|checksum|digest|uuid|guid|\\bid\\b|revision|etag|integrity|version|href|src|url|img|image|base64|file|path|doi|isbn|order|invoice|phone|card|account"
#: The kinds of candidates, in the order in which they are tried at a place.
CANDIDATE = "|".join(
    (
        r"""(?<=[=:] ?["'])[^\s"']{8,}+""",
        rf"""(?<=[=:] ?)(?<=(?i:{SECRET_WORDS})[\w\-]{{0,20}}["']? ?[=:] ?)[^\s"'<>,;&]{{8,}}+""",
        r"""(?<=:)(?<=://[^\s:/@]{1,40}:)[^\s@/:]{6,}+(?=@)""",
        r"""(?<=[Bb]earer )[^\s"'<>,;]{8,}+""",
        r"""(?:eyJ[A-Za-z0-9_\-]{8,}+|SG(?=\.))(?:\.[A-Za-z0-9_\-]{10,}+){1,2}""",
        r"""[A-Za-z0-9+/_\-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_\-=]))?""",
    )
)

#: Words that show up inside identifiers, paths and placeholders, not inside random strings.
DICTIONARY = "account admin application auth base build cache change changeme class client code common config content data default demo dist document dummy example field file form function group handler home html http image index info input item java json lib library list local main message method model module name node object office option order package page param password path placeholder private product project property public python query record report request resource response result sample schema script secret server service session setting share source static status string style system table template test text time title token type update user util value version view window your".split()
PARTS = "[A-Z]?[a-z]{2,}|[A-Z]{3,}"

FEATURES = {
    "length": "least(length({s}), 200)",
    "distinct": "size(array_distinct(split({s}, ''))) / length({s})",
    "digits": "regexp_count({s}, '[0-9]') / length({s})",
    "upper": "regexp_count({s}, '[A-Z]') / length({s})",
    "other": "regexp_count({s}, '[^A-Za-z0-9]') / length({s})",
    "transitions": "regexp_count({s}, '[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])') / length({s})",
    "alternating": "regexp_count(lower({s}), '[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])') / length({s})",
    "hex": "cast({s} rlike '^[0-9a-f]+$|^[0-9A-F]+$' as int)",
    "number": "cast({s} rlike '^[0-9=/_+-]+$' as int)",
    "uuid": "cast({s} rlike '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$' as int)",
    "known": "cast({s} rlike '^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk[-_]|pk_live|rk_live|AIza|eyJ|npm_|SG[.])' as int)",
    "words": "1 - length(regexp_replace(lower({s}), '" + "|".join(DICTIONARY) + "', '')) / length({s})",
    "dictionary": "aggregate(filter(regexp_extract_all({s}, '" + PARTS.replace("{", "{{").replace("}", "}}") + "', 0), p -> lower(p) IN ({d})), 0, (n, p) -> n + length(p)) / length({s})",
    "vowels": "regexp_count(lower({s}), '[aeiou]') / greatest(1, regexp_count(lower({s}), '[a-z]'))",
    "filler": "cast({s} rlike '(?i)(.)\\\\1{{4}}|x{{4}}|1234567|abcdef|<.*>|[$][{{(]|[.][.][.]' as int)",
    "code": "cast({s} rlike '[(){{}}\\\\[\\\\]]|[a-z][.][a-z]' as int)",
    "slashes": "regexp_count({s}, '/') / length({s})",
    "secret_word": "cast(lower(right({b}, 25)) rlike '" + SECRET_WORDS.replace("\\", "\\\\") + "' as int)",
    "plain_word": "cast(lower(right({b}, 25)) rlike '" + PLAIN_WORDS.replace("\\", "\\\\") + "' as int)",
    "assigned": "cast({b} rlike '[=:]\\\\s*[\"\\']?$' as int)",
    "names": "cast({a} rlike '^[\"\\']? ?[=:] ?[^\\\\s/]' as int)",
    "quoted": "cast({b} rlike '[\"\\']$' and {a} rlike '^[\"\\']' as int)",
    "in_url": "cast({b} rlike '(?i)(://|www[.])\\\\S*$' as int)",
    "test_path": "cast(lower(coalesce({p}, '')) rlike '(^|[/_.-])(tests?|examples?|fixtures?|mocks?|docs?|samples?)([/_.-]|$)' as int)",
}


def dictionary(docs: DataFrame, rate: float = RATE) -> list[str]:
    """The words of three letters or more, folded, that make up `rate` of all such words or more: at most 1 / rate. Sorted; counted over all rows."""
    text, word = F.lower(F.col("text")), F.lit(r"\p{L}{3,}")
    total = docs.select(F.regexp_count(text, word).alias("n")).agg(F.sum("n")).first()[0] or 0
    counts = docs.select(F.explode(F.regexp_extract_all(text, word, F.lit(0))).alias("word")).groupBy("word").count()
    return sorted(r["word"] for r in counts.where(F.col("count") >= rate * total).select("word").collect())  # at most 1 / rate rows


def _vector(s: str, b: str, a: str, p: str, words: list[str]) -> str:
    known = ", ".join(f"'{w}'" for w in sorted({*words, *DICTIONARY}))  # letters only
    return "array(" + ", ".join(f"cast({e.format(s=s, b=b, a=a, p=p, d=known)} as double)" for e in FEATURES.values()) + ")"


def made_lines(spark: SparkSession, n: int = 5000) -> DataFrame:
    """Labelled findings from templates: text, value (the finding in it), label (1 for a secret), source.

    Values are made from hashes of the row number; a template of a line, a name and one of a value go by row number too.
    """

    def pick(xs: list[str], by: int, quoted: bool = False) -> str:
        items = ["'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if quoted else x for x in xs]
        return f"CASE cast(conv(substr(h2, {by}, 4), 16, 10) as int) % {len(xs)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(items)) + " END"

    known = f"split('{' '.join(DICTIONARY)}', ' ')"
    w = [f"w[{i}]" for i in range(4)]
    joined = lambda sep: f"array_join(w, '{sep}')"
    camel = f"concat({w[0]}, initcap({w[1]}), initcap({w[2]}), initcap({w[3]}))"
    secret_names = ["token", "TOKEN", "GITHUB_TOKEN", "api_key", "API_KEY", "apiKey", "x-api-key", "secret", "client_secret", "AWS_SECRET_ACCESS_KEY", "aws_secret_access_key", "DB_PASSWORD", "password", "passwd", "auth_token", "access_key", "private_key", "signing_secret", "credentials"]
    plain_names = ["commit", "sha256", "sha1", "md5", "checksum", "etag", "digest", "revision", "uuid", "id", "build_id", "version", "file_hash", "image", "path", "class", "href", "order", "card", "account_id", "object_name", "import"]
    symbols = "concat(substr(b64, 1, 6), substr('!#$%*.', 1 + id % 6, 1), substr(b64, 8, 6))"
    real = ["substr(h, 1, 40)", "substr(h, 1, 32)", "h", "substr(both, 1, 40)", "substr(b64, 1, 24)", "concat('AKIA', upper(substr(translate(h, '0189', 'WXYZ'), 1, 16)))", "concat('ghp_', substr(b64, 1, 36))", "concat('sk_live_', substr(b64, 1, 24))", "upper(substr(h, 1, 40))", "base64(unhex(h))", "substr(letters, 1, 36)", "substr(letters, 1, 24)", "substr(b64, 1, 12)", symbols]
    hashes = ["substr(h, 1, 40)", "h", "substr(h, 1, 32)", "base64(unhex(h))", "substr(b64, 1, 40)", "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", "translate(substr(h, 1, 24), 'abcde', '123456')"]
    fillers = ["concat('your-token-goes-here-', id % 10)", "concat('changeme-placeholder-', id % 10)", "concat('xxxxxxxxxxxxxxxxxxxx', id % 10)", "'00000000000000000000'", "concat('example-secret-value-', id % 100)", "concat('12345678901234567890', id % 10)", "concat('<your-api-key-', id % 10, '>')", "concat('$', '{', upper(" + joined("_") + "), '}')", "'********'"]
    named = [camel, joined("_"), joined("-"), f"upper({joined('_')})", f"concat(lower({camel}), '()')", joined("."), joined("/"), f"concat({w[0]}, {w[1]})", f"concat('get', initcap({w[0]}), initcap({w[1]}), '()')", "'required'", "'disabled'", "'not given here'", "'somebody'", "'undefined'"]
    assigned = ['%n = "%v"', '%n="%v"', "%n: '%v'", "export %n=%v", "%n=%v", "%n: %v", '"%n": "%v"', '{"%n":"%v", "x": 1}', "and the %n = \"%v\" of it"]
    loose = ["Authorization: Bearer %v", 'curl -H "%n: %v" https://api.example.com', "https://api.example.com/v1/items?page=2&%n=%v", "postgres://admin:%v@db.example.com/main", "the %n %v"]
    plain = ["%n %v", "%n: %v", '%n = "%v"', "%n=%v", '%n="sha384-%v"', '"%n": "%v"', 'src="data:image/png;base64,%v"', "see https://www.example.com/%v for it", 'href="/static/%v.js"', "the %v of it", "in %v, and", '%n="sha256:%v"']
    kind = "id % 8"
    of = lambda a, b, c, d: f"CASE WHEN {kind} < 4 THEN {a} WHEN {kind} = 4 THEN {b} WHEN {kind} < 7 THEN {c} ELSE {d} END"
    value = of(pick(real, 1), pick(hashes, 1), f"CASE WHEN {kind} = 5 THEN {pick(fillers, 1)} ELSE {pick(named, 1)} END", pick([*named, *hashes], 1))
    line = of(pick([*assigned, *assigned, *loose], 5, True), pick(plain, 5, True), pick([*assigned, *loose], 5, True), pick(plain, 5, True))
    name = of(pick(secret_names, 9, True), pick(plain_names, 9, True), pick(secret_names, 9, True), pick(plain_names, 9, True))
    source = "element_at(array('src0', 'src1', 'lib/main', 'tests/unit'), 1 + cast(conv(substr(sha2(concat('path', id), 256), 1, 2), 16, 10) as int) % 4)"
    base = spark.range(0, n, 1, 2).selectExpr("id", "sha2(concat('finding', id), 256) AS h", "sha2(concat('more', id), 256) AS h2")
    base = base.selectExpr("*", "concat(base64(unhex(h)), base64(unhex(h2))) AS both", f"transform(array(1, 5, 9, 13), i -> {known}[cast(conv(substr(h, i, 4), 16, 10) as int) % {len(DICTIONARY)}]) AS w")
    base = base.selectExpr("*", "translate(both, '+/=', 'pQr') AS b64", "regexp_replace(both, '[^A-Za-z]', '') AS letters")
    rows = base.selectExpr("id", f"{value} AS value", f"{line} AS line", f"{name} AS name", f"cast({kind} < 4 as double) AS label", f"{source} AS source")
    told = rows.selectExpr("replace(replace(concat('and then ', line, '\\n the end'), '%n', name), '%v', value) AS text", "value", "label", "source")
    signed = f"CASE WHEN id % 3 > 0 THEN concat('eyJ', substr(b64, 1, 17 + id % 20), '.eyJ', substr(b64, 5, 40 + id % 37), '.', substr(b64, 20, 32 + id % 12)) ELSE concat('SG.', substr(b64, 1, 22), '.', substr(b64, 30, 43)) END"
    around = pick(["the call sends %v and waits", "%v", "cookie: session=%v; path=/", "Authorization: Bearer %v", "key %v in the log", "see https://x.example.com/a?t=%v&x=1"], 13, True)
    tokens = base.where(f"id < {n // 10}").selectExpr("id", f"{signed} AS value", f"{around} AS line", f"{source} AS source")
    return told.unionByName(tokens.selectExpr("replace(concat('and then ', line, '\\n the end'), '%v', value) AS text", "value", "1D AS label", "source"))


def train(lines: DataFrame, words: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> str:
    """A SQL expression over an array `x.f` of features: the share of trees that vote for a secret.

    lines: text, value, label, source. Every candidate of a text is a row; it has the label if it is the value or part of it, or holds it, else 0.
    """
    return compiled(fitted(vectors(lines, words), trees, depth, seed).toDebugString)


def vectors(lines: DataFrame, words: list[str]) -> DataFrame:
    """(label, f) of every candidate of the lines, found as scan() finds them."""
    rows = scanned(lines.where("value <> '' AND label IS NOT NULL"), None, "c", "p", words)
    each = rows.select("value", "label", F.explode_outer("c").alias("c")).where("c IS NOT NULL")
    own = F.col("c.secret").contains(F.col("value")) | F.col("value").contains(F.col("c.secret"))
    return each.select(F.when(own, F.col("label")).otherwise(0.0).cast("double").alias("label"), F.col("c.f").alias("f"))


def fitted(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
    """The library's model of (label, f)."""
    from pyspark.ml.classification import RandomForestClassifier  # only training needs it, and it is large
    from pyspark.ml.functions import array_to_vector

    ready = rows.coalesce(1).sortWithinPartitions("label", "f").select("label", array_to_vector("f").alias("features")).persist()  # findings, labelled by hand or made
    try:
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)
    finally:
        ready.unpersist()


def compiled(told: str) -> str:
    """The forest's printed form as SQL: nodes of all trees in arrays, walked from each root; a leaf leads to itself."""
    nodes: list[tuple[int, float, int, int, float]] = []  # feature, threshold, where to go if not above it, where else, vote
    roots: list[int] = []
    lines: Iterator[str] = iter(told.splitlines())

    def node() -> tuple[int, int]:
        """(the node's number, how many steps there are below it)"""
        line, at = next(lines).strip(), len(nodes)
        nodes.append((0, 0.0, at, at, 0.0))
        if m := re.fullmatch(r"Predict: (\S+)", line):
            nodes[at] = (0, 0.0, at, at, float(m[1]))
            return at, 0
        m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        low, below = node()
        next(lines)  # Else
        high, other = node()
        nodes[at] = (int(m[1]), float(m[2]), low, high, 0.0)
        return at, 1 + max(below, other)

    deep = 1
    for line in lines:
        if line.strip().startswith("Tree "):
            root, depth = node()
            roots.append(root)
            deep = max(deep, depth)
    column = lambda i, kind: "cast(split('" + " ".join(repr(n[i]) for n in nodes) + f"', ' ') as array<{kind}>)"
    feature, threshold, low, high, vote = (column(i, kind) for i, kind in enumerate(("int", "double", "int", "int", "double")))
    walked = f"aggregate(sequence(1, {deep}), root, (n, step) -> if(x.f[{feature}[n]] <= {threshold}[n], {low}[n], {high}[n]))"
    return f"(aggregate(array({', '.join(map(str, roots))}), 0D, (votes, root) -> votes + {vote}[{walked}]) / {float(len(roots))!r}D)"


_FORESTS: dict[tuple[str, str], str] = {}


def forest_of(docs: DataFrame, lines: DataFrame | None, words: list[str]) -> str:
    """The compiled forest; that of the made lines is fitted once a session and dictionary."""
    if lines is not None:
        return train(lines, words)
    spark = docs.sparkSession
    key = spark.sparkContext.applicationId, hashlib.md5(" ".join(words).encode(), usedforsecurity=False).hexdigest()
    if key not in _FORESTS:
        _FORESTS.clear()
        _FORESTS[key] = train(made_lines(spark), words)
    return _FORESTS[key]


def scanned(docs: DataFrame, forest: str | None, out: str, pieces: str, words: list[str]) -> DataFrame:
    """docs with `pieces`, what stands between the candidates of the text, and `out`, the candidates: secret, before, after, and score, or f without a forest.

    before and after are of the text itself, so they reach over candidates next to this one.
    """
    text, m = F.coalesce(F.col("text"), F.lit("")), f"{out}_m"
    rows = docs.withColumns({m: F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), pieces: F.split(text, CANDIDATE, -1)})
    source = "source" if "source" in docs.columns else "cast(null as string)"
    at = lambda a, i: f"coalesce(get(`{a}`, {i}), '')"
    before = f"right(concat({at(pieces, 'i - 1')}, {at(m, 'i - 1')}, {at(pieces, 'i')}), {BEFORE})"
    after = f"left(concat({at(pieces, 'i + 1')}, {at(m, 'i + 1')}, {at(pieces, 'i + 2')}), {AFTER})"
    rows = rows.withColumn(out, F.expr(f"transform(`{m}`, (s, i) -> named_struct('secret', s, 'before', {before}, 'after', {after}))"))
    rows = rows.withColumn(out, F.expr(f"transform(`{out}`, x -> named_struct('secret', x.secret, 'before', x.before, 'after', x.after, 'f', {_vector('x.secret', 'x.before', 'x.after', source, words)}))"))
    if forest:
        rows = rows.withColumn(out, F.expr(f"transform(`{out}`, x -> named_struct('secret', x.secret, 'before', x.before, 'after', x.after, 'score', {forest}))"))
    return rows.drop(m)


def scan(docs: DataFrame, lines: DataFrame | None = None, limit: float = LIMIT) -> DataFrame:
    """Every candidate: doc_id, source, nth (its place among those of the text), length, sha256, masked, score, is_secret.

    `lines` are labelled findings: text, value, label, source. The secret itself is not given: masked has its first three characters. A null or empty text
    has no candidates; repeated rows are told of each; an empty table gives no rows. Columns other than doc_id, text and source are not read.
    """
    own = docs.select("doc_id", "source", "text")
    words = dictionary(own)
    rows = scanned(own, forest_of(own, lines, words), "c", "p", words)
    # outer, as a filter on the candidates, inferred for an inner one, would find them all over again below this
    each = rows.select("doc_id", "source", F.posexplode_outer("c").alias("nth", "c")).where("c IS NOT NULL")
    secret: Column = F.col("c.secret")
    return each.select(
        "doc_id", "source", "nth", F.length(secret).alias("length"), F.sha2(secret, 256).alias("sha256"), F.concat(F.substring(secret, 1, 3), F.lit("...")).alias("masked"), F.col("c.score").alias("score"), (F.col("c.score") >= limit).alias("is_secret")
    )


def redact(docs: DataFrame, lines: DataFrame | None = None, limit: float = LIMIT) -> DataFrame:
    """docs with every secret in text replaced by MASK, and n_chars, if there is one, the new length; no row is dropped.

    Rows without a secret stay as they are, null texts too; an empty table stays empty. Other columns pass through, whatever their names.
    """
    words = dictionary(docs.select("text"))
    forest = forest_of(docs, lines, words)
    out, pieces = "__secrets", "__pieces"
    while {out, pieces, f"{out}_m"} & set(docs.columns):
        out, pieces = out + "_", pieces + "_"
    rows = scanned(docs, forest, out, pieces, words)
    hit = F.expr(f"exists(`{out}`, x -> x.score >= {limit}D)")
    clean = F.expr(f"concat(array_join(transform(`{out}`, (x, i) -> concat(`{pieces}`[i], CASE WHEN x.score >= {limit}D THEN '{MASK}' ELSE x.secret END)), ''), element_at(`{pieces}`, -1))")
    rows = rows.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


QUERIES = {"op6_secrets": op6_secrets}
ORACLES: dict[str, str] = {}
