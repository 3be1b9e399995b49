"""Offline structuring: topics and supporting points without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .segments import even_chunks, lines

TOPICS = {"brief": 5, "full": 9, "expert": 12}
LEAVES = {"brief": 0, "full": 3, "expert": 4}
NODE = "map_id, path, title, type, note, timestamp"


def leaves(every: Column, n: int) -> Column:
    """Evenly spaced sentences after the first, n at most, shortened."""
    body = F.slice(every, 2, F.greatest(F.size(every), F.lit(1)))
    step = F.greatest(F.lit(1), F.floor(F.size(body) / n).cast("int")) if n else F.lit(1)
    picked = F.slice(F.filter(body, lambda s, i: i % step == 0), 1, n) if n else F.array().cast("array<string>")
    return F.transform(picked, lambda s: T.truncate(s, 90, stripped=True))


def flat_map(docs: DataFrame, level: str = "full", key: str = "doc_id", title: Column | None = None, text_col: str = "text") -> DataFrame:
    """Nodes (map_id, path, title, type, note, timestamp) of each document: root, topics, points.

    All of a document is one row until its nodes are exploded, so there is no shuffle. A document without text gets one
    node that says so.
    """
    level = level if level in TOPICS else "full"
    title = F.lit(None).cast("string") if title is None else title
    named = F.coalesce(F.nullif(title, F.lit("")), F.lit("Mind Map"))
    rows = lines(docs, text_col).select(F.col(key).alias("map_id"), named.alias("root"), even_chunks(F.col("segs"), TOPICS[level]).alias("chunks"))
    # A chunk is a row of its own before its text is looked at, so what is made of it is generated code.
    rows = rows.select("map_id", "root", F.posexplode_outer("chunks").alias("i", "chunk"))
    rows = rows.select("map_id", "root", "i", F.array_join("chunk", " ").alias("text"))
    rows = rows.withColumn("sents", T.split_sentences(F.col("text")))
    n = LEAVES[level]
    step = F.greatest(F.lit(1), F.floor((F.size("sents") - 1) / n).cast("int")) if n else None
    # A node before its title is cut: which point of the chunk it is, -1 for the topic, -2 for the map's root.
    node = lambda j, raw, note: F.struct(j.alias("j"), raw.cast("string").alias("raw"), note.cast("string").alias("note"))
    none = F.lit(None)
    topic = node(F.lit(-1), F.coalesce(F.get("sents", F.lit(0)), F.col("text")), T.truncate(F.col("text"), 500, stripped=True))
    points = [F.when(F.size("sents") > 1 + j * step, node(F.lit(j), F.get("sents", 1 + j * step), none)) for j in range(n)]
    root = F.when(F.coalesce("i", F.lit(0)) == 0, node(F.lit(-2), F.col("root"), none))
    nodes = rows.select("map_id", "i", F.explode_outer(F.array(root, topic, *points)).alias("n")).filter("n is not null").select("map_id", "i", "n.*")
    empty, top = F.col("i").isNull(), F.col("j") == -2
    title = F.when(top, F.col("raw")).when(empty, "(no content extracted)").when(F.col("j") == -1, T.snippet_title(F.col("raw"), stripped=True)).otherwise(T.truncate(F.col("raw"), 90, stripped=True))
    path = F.when(top, F.array().cast("array<int>")).when(empty, F.array(F.lit(0))).when(F.col("j") == -1, F.array("i")).otherwise(F.array("i", "j"))
    kind = F.when(top, "root").when(empty | (F.col("j") >= 0), "detail").otherwise("topic")
    return nodes.select("map_id", path.alias("path"), title.alias("title"), kind.alias("type"), "note", F.lit(None).cast("double").alias("timestamp"))


def enumerated_map(sections: DataFrame, intro: DataFrame, level: str = "full", least_intro: int = 40) -> DataFrame:
    """Nodes of enumerated sources, from sections (map_id, number, heading, start, text) and intro (map_id, start, text)."""
    over = intro.filter(T.word_count(F.col("text")) >= least_intro).select("map_id", F.lit(-1).alias("number"), F.lit("Overview").alias("heading"), "start", "text")
    named = F.concat(F.col("number").cast("string"), F.lit(". "), F.coalesce(F.nullif("heading", F.lit("")), F.concat(F.lit("Part "), F.col("number").cast("string"))))
    rows = sections.withColumn("heading", named).select("map_id", "number", "heading", "start", "text").unionByName(over)
    packed = rows.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("number", "heading", "start", "text"))).alias("s"))
    rows = packed.select("map_id", F.posexplode("s").alias("i", "s"))
    topics = rows.select("map_id", F.array("i").alias("path"), F.col("s.heading").alias("title"), F.lit("topic").alias("type"), F.when(F.col("s.text") != "", T.truncate(F.col("s.text"), 500)).alias("note"), F.col("s.start").alias("timestamp"))
    points = rows.select("map_id", "i", F.posexplode(leaves(T.sentences(F.col("s.text")), LEAVES[level])).alias("j", "title"))
    points = points.select("map_id", F.array("i", "j").alias("path"), "title", F.lit("detail").alias("type"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("double").alias("timestamp"))
    return topics.unionByName(points)
