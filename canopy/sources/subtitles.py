"""Subtitle and plain text sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SEGMENTS = "array<struct<text:string,start:double,duration:double>>"
# What bytes 0x80 to 0x9F mean in the Western Windows code page; five of them mean nothing.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def encoding(content: Column) -> Column:
    """What bytes are read as: utf-8, else cp1252, else latin-1 where one of them means nothing in that; what isn't utf-8 deserves a warning."""
    undefined = F.decode(content, "ISO-8859-1").rlike("[\u0081\u008d\u008f\u0090\u009d]")
    return F.when(F.is_valid_utf8(content.cast("string")), "utf-8").when(undefined, "latin-1").when(content.isNotNull(), "cp1252")


def warning(content: Column) -> Column:
    """What to tell about bytes that aren't UTF-8, null for others."""
    kind = encoding(content)
    return F.when(kind != "utf-8", F.concat(F.lit("not UTF-8, read as "), kind, F.lit("; some characters may be wrong")))


def decode(content: Column) -> Column:
    """Bytes as UTF-8, else in the Windows code page, else in Latin-1; a byte order mark goes."""
    latin = F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, "".join(map(chr, CP1252_BYTES)), CP1252)
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(latin.rlike("[\u0081\u008d\u008f\u0090\u009d]"), latin).otherwise(windows)
    return F.regexp_replace(text, "^﻿", "")


def cue_blocks(text: Column) -> Column:
    """Segments of timed cues: blocks between blank lines, with an arrow in their first line (after a number)."""
    blocks = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]*\n")
    lines = F.transform(blocks, lambda b: F.filter(F.transform(F.split(b, "\n"), T.strip), lambda s: s != ""))
    lines = F.filter(lines, lambda b: (F.size(b) > 0) & ~F.coalesce(F.get(b, F.lit(0)).rlike("(?i)^(?:WEBVTT|NOTE|STYLE)"), F.lit(False)))
    lines = F.transform(lines, lambda b: F.when(F.get(b, F.lit(0)).rlike("^[0-9]+$"), F.slice(b, 2, F.size(b))).otherwise(b))
    lines = F.filter(lines, lambda b: F.coalesce(F.get(b, F.lit(0)).contains("-->"), F.lit(False)))

    def cue(b: Column) -> Column:
        times = F.split(F.get(b, F.lit(0)), "-->")
        start, end = T.timestamp_seconds(F.get(times, F.lit(0))), T.timestamp_seconds(F.coalesce(F.get(times, F.lit(1)), F.lit("")))
        body = T.clean_caption(F.regexp_replace(F.array_join(F.slice(b, 2, F.size(b)), " "), "<[^>]+>", ""))
        return F.struct(body.alias("text"), start.alias("start"), F.greatest(F.lit(0.0), end - start).alias("duration"))

    return F.filter(F.transform(lines, cue), lambda s: s["text"] != "")


def plain_lines(text: Column) -> Column:
    cleaned = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), T.clean_caption), lambda s: s != "")
    return F.transform(cleaned, lambda s: F.struct(s.alias("text"), F.lit(0.0).alias("start"), F.lit(0.0).alias("duration")))


def parse(files: DataFrame, key: str = "source", text_col: str = "text") -> DataFrame:
    """(key, seq, text, start, duration) of subtitle texts; a text without an arrow is plain lines."""
    segs = F.when(F.col(text_col).contains("-->"), cue_blocks(F.col(text_col))).otherwise(plain_lines(F.col(text_col)))
    return files.select(key, F.posexplode(segs).alias("seq", "s")).select(key, "seq", "s.text", "s.start", "s.duration")


def read(spark, path: str) -> DataFrame:
    """Subtitle files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{vtt,srt,txt}").load(path)
    return parse(files.select(F.col("path").alias("source"), decode(F.col("content")).alias("text")))


def captions(items: DataFrame, key: str = "source", json_col: str = "items") -> DataFrame:
    """Segments of caption lists in JSON, [{text, start, duration}]; pure noise goes."""
    rows = items.select(key, F.posexplode(F.from_json(json_col, SEGMENTS)).alias("pos", "s"))
    kept = rows.select(key, "pos", T.clean_caption(F.col("s.text")).alias("text"), "s.start", "s.duration").filter("text <> ''")
    packed = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "start", "duration"))).alias("s"))
    return packed.select(key, F.posexplode("s").alias("seq", "s")).select(key, "seq", "s.text", "s.start", "s.duration")


def stats(segments: DataFrame, key: str = "source") -> DataFrame:
    """(key, n_segments, n_words, duration): the duration is the end of the last segment."""
    end = F.max_by(F.col("start") + F.col("duration"), "seq")
    return segments.groupBy(key).agg(F.count("*").alias("n_segments"), F.sum(T.word_count(F.col("text"))).cast("long").alias("n_words"), end.alias("duration"))
