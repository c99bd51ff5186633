"""What tracks are and how they are called: kinds, release names, languages, channels, rates, spelling of read captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reeltide.functions.numbers import RATES, bound, rate_from_duration
from reeltide.functions.text import CHANNELS, slug
from reeltide.operators.selection import LANG_ALIASES

#: Stream ids of each kind; ids of sound begin with A_, of captions with S_.
DEPENDENT, ENHANCEMENT = ("V_MPEG4/ISO/MVC", "V_MPEGH/ISO/HEVC/MV"), ("V_MPEGH/ISO/HEVC/EL",)
BASE = ("V_MPEG4/ISO/AVC", "V_MPEGH/ISO/HEVC", "V_MS/VFW/FOURCC", "V_MPEG2")
#: What a sound track's type holds, in upper case, and what releases call it; the first that fits.
SOUNDS = (("TRUE", "TrueHD"), ("MASTER", "DTS-HD-MA"), ("DTS-HD", "DTS-HD-HRA"), ("DTS", "DTS"), ("E-AC3", "DDP"), ("EAC3", "DDP"), ("AC3", "DD"), ("PCM", "LPCM"))
#: How a track's name begins, and the language that it gives.
NAMES = (
    ("english", "eng"), ("portug", "por"), ("brazil", "por"), ("japanese", "jpn"), ("french", "fre"), ("français", "fre"), ("spanish", "spa"), ("español", "spa"), ("castellano", "spa"),
    ("german", "ger"), ("deutsch", "ger"), ("italian", "ita"), ("italiano", "ita"), ("korean", "kor"), ("chinese", "chi"),
)
#: Words that are none if their first letter is a small l, and what they are.
READ_WRONG = {"lt": "It", "lt's": "It's", "lt'll": "It'll", "lts": "Its", "ls": "Is", "lsn't": "Isn't", "lf": "If", "ln": "In", "lnto": "Into", "lsso": "Isso", "lsto": "Isto", "lsa": "Isa"}
#: The channel of a disc that each channel of a WAV file with eight, one of them low, takes.
EIGHT = (0, 1, 2, 3, 6, 7, 4, 5)


def kind(stream_id: Column) -> Column:
    """dependent, enhancement, base, audio, subtitles or other."""
    told = F.when(stream_id.isin(*DEPENDENT), "dependent").when(stream_id.isin(*ENHANCEMENT), "enhancement").when(stream_id.isin(*BASE), "base")
    return told.when(stream_id.startswith("A_"), "audio").when(stream_id.startswith("S_"), "subtitles").otherwise("other")


def audio_tag(what: Column, info: Column) -> Column:
    """A sound track as releases name it, from its type and stream id (`what`) and description: TrueHD-Atmos 7.1, DDP 5.1; the slug of `what` for others."""
    big = F.upper(what)
    name = F.lit(None).cast("string")
    for part, called in reversed(SOUNDS):
        name = F.when(big.contains(part), F.lit(called)).otherwise(name)
    name = F.when(big.contains("TRUE") & F.upper(info).contains("ATMOS"), F.lit("TrueHD-Atmos")).otherwise(F.coalesce(name, slug(what)))
    front, low = F.regexp_extract(info, CHANNELS, 1), F.regexp_extract(info, CHANNELS, 2)
    layout = F.when(front != "", F.concat(front, F.lit("."), F.when(low != "", low).otherwise("0")))
    return F.concat_ws(" ", name, layout)


def language_code(said: Column) -> Column:
    """The three-letter code that a code or alias stands for; empty where none does."""
    low = F.lower(said)
    table = F.create_map(*[F.lit(x) for k, v in LANG_ALIASES.items() for x in (k, v[0])])
    return F.coalesce(F.try_element_at(table, low), F.when(F.octet_length(low) == 3, low), F.lit(""))


def language_of_name(name: Column) -> Column:
    """The language that a track's name begins with; empty where it begins with none."""
    low, out = F.lower(F.trim(name)), F.lit("")
    for begin, lang in reversed(NAMES):
        out = F.when(low.startswith(begin), F.lit(lang)).otherwise(out)
    return out


def described(lang: Column, known: Column) -> Column:
    """The language of a stream: its own descriptor, else what a lookup by its number knows, if that has three letters."""
    own = F.nullif(lang, F.lit(""))
    return F.coalesce(own, F.when(F.octet_length(known) == 3, known), F.lit(""))


def disc_channel(channels: Column, low: Column, channel: Column) -> Column:
    """The channel of the disc that a channel of a WAV file takes; all but those of eight with a low one are the same."""
    return F.when((channels == 8) & low & channel.between(0, 7), F.get(F.array(*[F.lit(c) for c in EIGHT]), channel.cast("int"))).otherwise(channel)


def reduced(num: Column, den: Column) -> Column:
    """num/den in lowest terms, as a struct; positive whole numbers below 2**31. Euclid's steps, of which there are at most 46."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1))).alias("b")))
    last = lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(46)), p, step)["a"]
    least = lambda p: bound(last(p), lambda d: F.struct((p["a"] / d).cast("long").alias("num"), (p["b"] / d).cast("long").alias("den")))
    return bound(F.struct(num.cast("long").alias("a"), den.cast("long").alias("b")), least)


def normal_rate(num: Column, den: Column) -> Column:
    """A decoder's rate as video states it: in lowest terms; the standard one within a fifth of a per cent, if any; 0/0 where it is not above 0."""
    pair = lambda r: F.struct(r["num"].cast("long").alias("num"), r["den"].cast("long").alias("den"))
    rates = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n, d in RATES])

    def stated(least: Column) -> Column:
        exact = F.exists(rates, lambda r: (r["n"] == least["num"]) & (r["d"] == least["den"]))
        near = rate_from_duration(F.floor(F.lit(1_000_000_000) * least["den"] / least["num"]))
        return F.when(exact, pair(least)).otherwise(bound(near, lambda r: F.when(r.isNull(), pair(least)).otherwise(pair(r))))

    return F.when((num <= 0) | (den <= 0), F.struct(F.lit(0).cast("long").alias("num"), F.lit(0).cast("long").alias("den"))).otherwise(bound(reduced(num, den), stated))


def respelled(line: Column) -> Column:
    """Small l read for a capital I put right: in words that are none with it, in words of capitals, alone, and before an apostrophe where a word begins."""
    words = F.create_map(*[F.lit(x) for kv in READ_WRONG.items() for x in kv])
    others = r"[\p{Ll}&&[^l]]"

    def one(w: Column) -> Column:
        core = F.regexp_replace(w, r"""[.,!?;:"…]+$""", "")
        whole = F.try_element_at(words, core)
        alone = F.regexp_replace(w, r"""^[.,!?;:"\-…]+|[.,!?;:"\-…]+$""", "") == "l"
        capitals = w.rlike(r"\p{Lu}") & ~w.rlike(others)
        start = F.regexp_replace(w, r"(?<!\p{L})l(?=['’])", "I")
        return F.when(whole.isNotNull(), F.concat(whole, F.substr(w, F.length(core) + 1))).when(capitals | alone, F.translate(w, "l", "I")).otherwise(start)

    return F.array_join(F.transform(F.split(line, " "), one), " ")
