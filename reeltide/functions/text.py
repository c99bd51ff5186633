"""Text rules: channel counts, slugs, cue styling, captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: How a track's description states its channels and its bit rate.
CHANNELS, BITRATE = r"(?i)Channels:\s*(\d+)(?:\.(\d+))?", r"(?i)Bitrate:\s*(\d+)\s*Kbps"


def channels(info: Column) -> Column:
    """Channels: 7.1 is eight, 2 is two; 0 where nothing is stated."""
    at = lambda i: F.coalesce(F.regexp_extract(info, CHANNELS, i).try_cast("int"), F.lit(0))
    return at(1) + at(2)


def bitrate(info: Column) -> Column:
    """Kilobits a second where stated, else 0."""
    return F.coalesce(F.regexp_extract(info, BITRATE, 1).try_cast("int"), F.lit(0))


def slug(name: Column) -> Column:
    """A name safe for files: runs of other characters than letters, digits, . and + become one dash, none at the ends; audio for nothing."""
    s = F.regexp_replace(F.trim(name), r"[^A-Za-z0-9.+]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", F.lit("audio")).otherwise(s)


def file_safe(name: Column) -> Column:
    """ASCII letters and digits only."""
    return F.regexp_replace(name, "[^A-Za-z0-9]", "")


def without_markup(text: Column) -> Column:
    """A cue's text without tags (a letter follows their bracket or slash, so 1 < 2 stays), its line ends as newlines, trimmed."""
    s = F.regexp_replace(text, r"</?[A-Za-z][^>]*>", "")
    return F.regexp_replace(F.regexp_replace(s, "\r\n", "\n"), r"^\s+|\s+$", "")


def without_overrides(event: Column) -> Column:
    """The text of an ASS event of nine fields, without override blocks; empty if it has fewer."""
    parts = F.split(event, ",", 9)
    s = F.regexp_replace(F.try_element_at(parts, F.lit(9)), r"\{[^}]*\}", "")
    s = F.replace(F.replace(F.replace(s, F.lit("\\N"), F.lit("\n")), F.lit("\\n"), F.lit("\n")), F.lit("\\h"), F.lit(" "))
    return F.coalesce(F.trim(s), F.lit(""))


def parse_list(text: Column) -> Column:
    """The items of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def with_details(path: Column, tags: Column) -> Column:
    """Tags after a space before the extension of a path; a layout that the name already ends with is not said twice."""
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    base = F.trim(F.substring(path, F.lit(1), F.length(path) - F.length(ext)))
    own = tags
    for lead in ("3D FSBS", "3D HSBS"):
        own = F.when(base.endswith(lead) & tags.startswith(lead), F.trim(F.substring(tags, len(lead) + 1, 1 << 20))).otherwise(own)
    return F.when(tags == "", path).otherwise(F.concat(base, F.lit(" "), own, ext))
