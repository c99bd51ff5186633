"""Times: ticks, clocks and their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp column without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")


def ticks_to_ns(ticks: Column, rate: int) -> Column:
    """Ticks of a clock of `rate` a second as whole nanoseconds, truncated."""
    return F.call_function("div", ticks * F.lit(1_000_000_000), F.lit(rate))


def clock_text(ms: Column) -> Column:
    """Milliseconds as H:MM:SS.mmm."""
    hour, minute = 3_600_000, 60_000
    h = F.floor(ms / hour)
    m = F.floor((ms % hour) / minute)
    s = ms % minute
    return F.format_string("%d:%02d:%02d.%03d", h, m, F.floor(s / 1000), s % 1000)


def parse_clock(text: Column) -> Column:
    """Milliseconds of [[H:]M:]S[.f] or 1h30m; null if it is neither."""
    t = F.trim(text)
    parts = F.reverse(F.split(t, ":"))
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    plain = t.rlike(r"^(\d+:){0,2}\d+(\.\d+)?$") & ((F.size(parts) < 2) | (at(1) < 60)) & ((F.size(parts) < 3) | (at(2) < 60))
    unit = lambda u: F.coalesce(F.regexp_extract(t, rf"(\d+(?:\.\d+)?){u}(?![a-z])", 1).try_cast("double"), F.lit(0.0))
    worded = t.rlike(r"^(\d+(\.\d+)?h)?(\d+(\.\d+)?m)?(\d+(\.\d+)?s)?$") & t.rlike("[hms]")
    whole = lambda x: F.round(x * 1000).cast("long")
    return F.when(plain, whole(at(3) * 3600 + at(2) * 60 + at(1))).when(worded, whole(unit("h") * 3600 + unit("m") * 60 + unit("s")))
