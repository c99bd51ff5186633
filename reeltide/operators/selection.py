"""Choosing titles and tracks: predicates, guards, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Requested language code and the codes that it stands for; other codes stand for themselves.
LANG_ALIASES = {
    "pt": ["por", "pob", "ptb"],
    "pt-br": ["por", "pob", "ptb"],
    "ptbr": ["por", "pob", "ptb"],
    "pob": ["por", "pob", "ptb"],
    "ptb": ["por", "pob", "ptb"],
    "por": ["por", "pob", "ptb"],
    "en": ["eng"],
    "es": ["spa", "esp"],
    "fr": ["fra", "fre"],
    "de": ["deu", "ger"],
    "it": ["ita"],
    "ja": ["jpn"],
    "zh": ["zho", "chi"],
    "fra": ["fra", "fre"],
    "fre": ["fra", "fre"],
    "deu": ["deu", "ger"],
    "ger": ["deu", "ger"],
    "zho": ["zho", "chi"],
    "chi": ["zho", "chi"],
}


def spelled(langs: list[str]) -> list[str]:
    """Every spelling of the requested languages."""
    keys = [k for k in (x.strip().lower() for x in langs) if k]
    return list(dict.fromkeys(s for k in keys for s in LANG_ALIASES.get(k, [k])))


def language(lang: Column) -> Column:
    """Lower case and trimmed; null and empty are undetermined."""
    return F.lower(F.coalesce(F.nullif(F.trim(lang), F.lit("")), F.lit("und")))


def bare(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", "")


def codec_hit(hay: Column, codecs: list[str]) -> Column:
    """Whether a codec is part of `hay`, as written or without punctuation."""
    low, plain = F.lower(hay), bare(hay)
    hits = []
    for c in codecs:
        c = c.lower()
        letters = "".join(x for x in c if x.isalnum())
        if c:
            hits.append(low.contains(c) | (plain.contains(letters) if letters else F.lit(False)))
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def matches(lang: Column, hay: Column, commentary: Column, langs: list[str], codecs: list[str], no_commentary: bool) -> Column:
    """The track predicate: language, codec and commentary; an empty list asks for nothing."""
    ok = F.lit(True)
    if no_commentary:
        ok = ok & ~F.coalesce(commentary, F.lit(False))
    if langs:
        ok = ok & language(lang).isin(*spelled(langs))
    if codecs:
        ok = ok & codec_hit(hay, codecs)
    return ok


def guarded(df: DataFrame, keep: Column, keys: list[str], none_asked: bool = False) -> DataFrame:
    """Rows that pass, with the count that each key offered; a key with rows of which none passes fails the query, unless none was asked for."""
    if none_asked:
        return df.where(F.lit(False)).withColumn("offered", F.lit(0).cast("long"))
    w = Window.partitionBy(*keys)
    d = df.withColumn("_keep", keep).withColumns({"offered": F.count(F.lit(1)).over(w), "_kept": F.sum(F.col("_keep").cast("int")).over(w)})
    checked = F.when(F.col("_kept") == 0, F.raise_error(F.lit("no track passes the filter"))).otherwise(F.col("_keep"))
    return d.where(checked).drop("_keep", "_kept")


def first_match(hay: Column, table: list[tuple[str, object]], default: object) -> Column:
    """The value of the first listed text that is part of `hay`; the order of the list decides."""
    out = F.lit(default)
    for text, value in reversed(table):
        out = F.when(F.lower(hay).contains(text), F.lit(value)).otherwise(out)
    return out


def best(df: DataFrame, keys: list[str], rank: list[Column], carry: list[str]) -> DataFrame:
    """Of each key the row of the greatest `rank`, combined before it is shuffled; no key is sorted."""
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*carry), F.struct(*rank)).alias("_t"))
    return top.select(*keys, "_t.*")


def best_by_language(df: DataFrame, keys: list[str], lang: str, ident: str, rank: list[Column], langs: list[str], carry: list[str]) -> DataFrame:
    """The best track of each requested language in the order of the request, a track being used once: keys, carry, place.

    The input is read once: a place needs no more than its own number and one of the best tracks of its language, as those before it took no more, so each place keeps so many, and the few that are left of a key are dealt out in one row. Tracks of equal rank go by `ident`.
    """
    asked = F.array(*[F.struct(F.lit(i).alias("place"), F.array(*[F.lit(x) for x in spelled([one])]).alias("of")) for i, one in enumerate(langs)])
    fits = F.transform(F.filter(asked, lambda a: F.array_contains(a["of"], language(F.col(lang)))), lambda a: a["place"])
    pool = df.withColumn("_r", F.struct(*rank)).select(*keys, F.col(ident).alias("_i"), F.struct(*carry).alias("_c"), "_r", F.explode(fits).alias("_p"))
    pool = pool.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(F.desc("_r"), "_i"))).where(F.col("_n") <= len(langs)).where(F.col("_n") <= F.col("_p") + 1)
    few = pool.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", "_n", "_i", "_c"))).alias("_all"))
    start = F.filter("_all", lambda _: F.lit(False))

    def deal(taken: Column, place: Column) -> Column:
        free = F.filter("_all", lambda t: (t["_p"] == place) & ~F.exists(taken, lambda x: x["_i"] == t["_i"]))
        return F.concat(taken, F.slice(free, 1, 1))

    dealt = few.select(*keys, F.explode(F.aggregate(F.sequence(F.lit(0), F.lit(len(langs) - 1)), start, deal)).alias("_t"))
    return dealt.select(*keys, F.col("_t._c.*"), F.col("_t._p").alias("place"))


def fallbacks(kept: DataFrame, offered: DataFrame, keys: list[str], ident: str, rank: list[Column]) -> DataFrame:
    """The best track not kept for each kept one of the same keys; a track is used once: the n-th kept one of a key takes the n-th best.

    A null key is equal to a null key: tracks without a language fall back on one another.
    """
    taken = kept.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate([*keys, ident])])
    free = offered.join(taken, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate([*keys, ident])]), "left_anti")
    by = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    a = kept.select(*keys, F.col(ident).alias("kept_id")).withColumn("_n", by(["kept_id"]))
    b = free.withColumn("_m", by([F.struct(*rank).desc()])).select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)], "_m", F.col(ident).alias("fallback_id"))
    same = [F.col(k).eqNullSafe(F.col(f"_f{i}")) for i, k in enumerate(keys)]
    return a.join(b, reduce(lambda x, y: x & y, same, F.col("_n") == F.col("_m"))).select(*keys, "kept_id", "fallback_id")


def one_of_each(df: DataFrame, keys: list[str], roles: dict[str, Column]) -> DataFrame:
    """The keys that have exactly one row of each role, with how many rows they have of each."""
    counts = df.groupBy(*keys).agg(*[F.count_if(c).alias(f"n_{r}") for r, c in roles.items()])
    return counts.withColumn("ok", reduce(lambda a, b: a & b, [F.col(f"n_{r}") == 1 for r in roles]))


def top_that_exist(df: DataFrame, keys: list[str], order: list, k: int, others: DataFrame, on: list[str]) -> DataFrame:
    """The first k rows of each key, and of those the ones that have a match in `others`: the limit comes before the test."""
    d = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)
    return d.join(others.select(*on).distinct(), on, "left_semi")
