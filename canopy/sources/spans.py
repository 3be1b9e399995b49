"""Laid-out pages: spans of text with their font sizes, put together to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(spans: DataFrame) -> DataFrame:
    """(source, seq, page, size, text) of the lines of spans (source, page, block, line, span, size, text), as heading_levels takes them.

    A line is its spans' texts, one right after another, without white space at its ends; its size is the largest of
    them, to the nearest half point, halfway to the even one. A line without text isn't one; seq counts from 0 in the
    order of page, block and line. A span without a size counts as 0, one without text as empty.
    """
    part = F.struct("span", F.coalesce("text", F.lit("")).alias("t"))
    made = spans.groupBy("source", "page", "block", "line").agg(
        F.array_sort(F.collect_list(part)).alias("ps"), (F.bround(F.max(F.coalesce("size", F.lit(0.0))) * 2) / 2).alias("size")
    )
    told = made.withColumn("text", T.strip(F.array_join(F.transform("ps", lambda p: p["t"]), ""))).filter("text <> ''")
    order = Window.partitionBy("source").orderBy("page", "block", "line")
    return told.select("source", (F.row_number().over(order) - 1).alias("seq"), "page", "size", "text")
