"""Caption texts as cues, in SQL expressions: SRT, WebVTT and ASS. Times are milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIME = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})"
ARROW = TIME + r"\s*-->\s*" + TIME


def _ms(line: Column, group: int) -> Column:
    at = lambda i: F.coalesce(F.nullif(F.regexp_extract(line, ARROW, group + i), F.lit("")).cast("int"), F.lit(0))
    frac = F.rpad(F.regexp_extract(line, ARROW, group + 3), 3, "0").cast("int")
    return ((at(0) * 60 + at(1)) * 60 + at(2)) * 1000 + frac


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text (line ends as newlines, without a byte order mark) of whole files."""
    df = spark.read.format("text").option("wholetext", "true").load(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    return df.withColumn("text", F.regexp_replace("text", "^﻿", ""))


def arrow_cues(df: DataFrame) -> DataFrame:
    """(file, text) of SRT or WebVTT -> file, ord, begin, finish, cue: one row a block with a time line; notes, styles and headers have none.

    In WebVTT (a text that says so in its first line) the time line is the first of a block, or the second after an id. Cues that do not end after they begin are none.
    """
    vtt = F.col("text").startswith("WEBVTT")
    blocks = df.select("file", vtt.alias("vtt"), F.posexplode(F.split("text", r"\n[ \t]*\n+")).alias("ord", "block"))
    every = F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), "\n")
    lines = F.filter(F.when(F.col("vtt"), F.slice(every, 1, 2)).otherwise(every), lambda l: l.rlike(ARROW))
    b = blocks.where(~F.ltrim("block").rlike("^(NOTE|STYLE|REGION)")).withColumn("line", F.try_element_at(lines, F.lit(1))).where("line IS NOT NULL")
    body = F.call_function("substring_index", F.col("block"), F.col("line"), F.lit(-1))
    b = b.select("file", "ord", _ms(F.col("line"), 1).alias("begin"), _ms(F.col("line"), 5).alias("finish"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("cue"))
    return b.where("cue <> '' AND finish > begin")


def ass_cues(df: DataFrame) -> DataFrame:
    """(file, text) of an ASS or SSA script -> file, ord, begin, finish, style, cue; fields are found by the Format line of the events."""
    events = F.regexp_extract("text", r"(?s)\[Events\](.*)$", 1)
    form = F.transform(F.split(F.regexp_extract(events, r"(?m)^Format:\s*(.*)$", 1), ","), lambda x: F.lower(F.trim(x)))
    d = df.select("file", form.alias("form"), F.posexplode(F.split(events, "\n")).alias("ord", "line")).where(F.col("line").startswith("Dialogue:"))
    n = F.size("form")
    d = d.withColumn("parts", F.expr("split(regexp_extract(line, '^Dialogue:\\\\s*(.*)$', 1), ',')"))
    field = lambda name: F.trim(F.try_element_at("parts", F.array_position("form", name).cast("int")))
    time = lambda name: F.regexp_extract(field(name), r"(\d+):(\d+):(\d+)\.(\d+)", 1).cast("int") * 3_600_000 + F.regexp_extract(field(name), r"(\d+):(\d+):(\d+)\.(\d+)", 2).cast("int") * 60_000 + F.regexp_extract(field(name), r"(\d+):(\d+):(\d+)\.(\d+)", 3).cast("int") * 1000 + F.rpad(F.regexp_extract(field(name), r"(\d+):(\d+):(\d+)\.(\d+)", 4), 3, "0").cast("int")
    cue = F.array_join(F.slice("parts", n, F.greatest(F.size("parts") - n + 1, F.lit(1))), ",")
    return d.where(F.size("parts") >= n).select("file", "ord", time("start").alias("begin"), time("end").alias("finish"), field("style").alias("style"), cue.alias("cue")).where("finish > begin")


def shots(df: DataFrame) -> DataFrame:
    """(file, text) of graded stretches, a line each: START [END] key=value ... -> file, line, start, end, settings.

    A stretch without an end is closed by the start of the next one; the last stays open (0). Times are seconds or clock times, in milliseconds.
    """
    from pyspark.sql import Window

    from reeltide.functions.clock import parse_clock

    lines = df.select("file", F.posexplode(F.split("text", "\n")).alias("line", "said")).withColumn("said", F.trim(F.regexp_replace("said", "#.*$", ""))).where("said <> ''")
    words = F.split("said", r"\s+")
    d = lines.select("file", "line", parse_clock(words[0]).alias("start"), parse_clock(F.get(words, F.lit(1))).alias("end"), F.filter(words, lambda w: w.contains("=")).alias("kv"))
    d = d.withColumn("settings", F.map_from_entries(F.transform("kv", lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.regexp_replace(w, "^[^=]*=", "").alias("v"))))).drop("kv")
    following = F.lead("start").over(Window.partitionBy("file").orderBy("line"))
    return d.withColumn("end", F.coalesce("end", following, F.lit(0)))
