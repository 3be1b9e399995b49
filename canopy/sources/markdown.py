"""Markdown and article sources: sections by heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

HEADING = r"^(#{1,6})\s+(.*)$"


def sections(docs: DataFrame, key: str = "source", text_col: str = "text", title: Column | None = None) -> DataFrame:
    """(key, seq, level, heading, text) of each section; text before the first heading has level 0.

    A first heading of level 1 that repeats the title is skipped. A section's text begins with its heading; blank lines
    go, and so do sections without text. Null texts give none; rows of one key are documents of their own. The places of
    the headings are found once and the lines cut there, all in the row, so time grows with the text alone.
    """
    title = F.lit("") if title is None else title
    marks, name = (lambda x: F.regexp_extract(x, HEADING, 1)), (lambda x: T.strip(F.regexp_extract(x, HEADING, 2)))
    rows = docs.select(F.col(key).alias("key"), title.alias("title"), F.split(F.coalesce(text_col, F.lit("")), r"\r\n|\r|\n").alias("lines"))
    at = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(HEADING), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", at).withColumn("first", F.get("at", F.lit(0))).withColumn("top", F.get("lines", F.col("first")))
    again = F.coalesce((F.length(marks(F.col("top"))) == 1) & (F.lower(name(F.col("top"))) == F.lower("title")), F.lit(False))
    rows = rows.withColumn("again", again)
    lines = F.when(F.col("again"), F.filter("lines", lambda x, i: i != F.col("first"))).otherwise(F.col("lines"))
    at = F.when(F.col("again"), F.transform(F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda i: i - 1)).otherwise(F.col("at"))
    rows = rows.select("key", lines.alias("lines"), at.alias("at"))
    rows = rows.withColumn("cuts", F.concat(F.array(F.lit(0)), "at", F.array(F.size("lines"))))

    def section(start: Column, k: Column) -> Column:
        part = F.slice("lines", start + 1, F.coalesce(F.get("cuts", k + 1), start) - start)
        head = F.get("lines", start)
        own = F.when(k == 0, part).otherwise(F.concat(F.array(name(head)), F.slice(part, 2, F.greatest(F.size(part), F.lit(1)))))
        text = T.strip(F.array_join(F.filter(own, lambda x: T.strip(x) != ""), "\n"))
        level, heading = F.when(k == 0, 0).otherwise(F.length(marks(head))), F.when(k == 0, "").otherwise(name(head))
        return F.struct(level.alias("level"), heading.alias("heading"), text.alias("text"))

    made = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), section)
    return rows.select(F.col("key").alias(key), F.posexplode(F.filter(made, lambda s: s["text"] != "")).alias("seq", "s")).select(key, "seq", "s.level", "s.heading", "s.text")


def outline(found: DataFrame, key: str = "source", least: int = 2) -> DataFrame:
    """(source, seq, level, title, page) of the headings, of sources that have at least two."""
    heads = found.filter("level > 0")
    enough = heads.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(key)
    return heads.join(enough, key, "left_semi").select(F.col(key).alias("source"), "seq", "level", F.col("heading").alias("title"), F.col("seq").alias("page"))
