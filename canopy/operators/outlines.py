"""Outlined sources: the pages that belong to each entry, and the map that they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .trees import outline_tree


def leaf_texts(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, seq, title, path, page, text) of outline entries; leaves have the text of [page, next entry's page), one page at least.

    outline: (source, seq, level, title, page), seq being unique in a source; pages: (source, seq, text). A leaf is dealt
    to its pages by number and joined with them by equality, so that a page is copied only to the leaves that hold it and
    a long source is many tasks. Entries that aren't leaves have a null text; leaves without pages, or of a null page, an
    empty one; null and blank pages are passed over; pages of one number are joined in the order of their texts.
    """
    by = Window.partitionBy("source").orderBy("seq")
    placed = outline_tree(outline).withColumns({"next_page": F.lead("page").over(by), "next_level": F.lead("level").over(by)})
    leaf = F.coalesce(F.col("next_level") <= F.col("level"), F.lit(True))
    extent = pages.groupBy("source").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    leaves = placed.filter(leaf).select("source", "seq", "page", "next_page").join(extent, "source")
    end = F.when(F.col("next_page").isNull(), F.col("n")).otherwise(F.greatest("next_page", F.col("page") + 1))
    ranged = leaves.withColumns({"first": F.greatest("page", F.lit(0)), "end": F.least(end, F.col("last") + 1)}).filter("first < end and page is not null")
    dealt = ranged.select("source", "seq", F.explode(F.sequence(F.col("first").cast("long"), F.col("end").cast("long") - 1)).alias("number"))
    told = pages.select("source", F.col("seq").cast("long").alias("number"), T.strip(F.col("text")).alias("t")).filter("t <> ''")
    found = dealt.join(told, ["source", "number"]).groupBy("source", "seq").agg(F.array_sort(F.collect_list(F.struct("number", "t"))).alias("ps"))
    texts = found.select("source", "seq", F.array_join(F.transform("ps", lambda p: p["t"]), " ").alias("found"))
    text = F.when(leaf, F.coalesce("found", F.lit("")))
    return placed.join(texts, ["source", "seq"], "left").select("source", "seq", "title", "path", "page", text.alias("text"))


def skeleton(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes of outlined sources: entries as they stand, leaves with a note that begins with their page."""
    rows = leaf_texts(outline, pages)
    note = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("(p. "), (F.col("page") + 1).cast("string"), F.lit(") "), T.truncate(F.col("text"), 500)))
    return rows.select(F.col("source").alias("map_id"), "path", "title", F.lit("topic").alias("type"), note.alias("note"))
