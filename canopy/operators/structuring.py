"""Structuring around a provider and after it: reduction, links by number, merging, routing, previews."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import trees
from .heuristic import LEAVES, TOPICS, leaves
from .provider import Provider
from .segments import even_chunks

# What stands for a node's type in a preview.
ICONS = {
    "root": "*", "topic": "#", "concept": "o", "definition": "[D]", "example": "[EX]", "insight": "[!]", "action": "[OK]", "warning": "[WARN]",
    "question": "[?]", "detail": "-",
}


def reduce_maps(mapped: DataFrame, model: Provider, key: str = "doc_id", level: str = "full") -> DataFrame:
    """Nodes (map_id, path, title, type, note) of one reduction a source, from map replies (key, chunk, value).

    The topics of a source, in the order of its chunks, are one request; a reply has a central title and nested
    children. A reply without children gives no nodes; level brief keeps the branches only.
    """
    topic = F.coalesce(F.get_json_object("value", "$.topic"), F.lit(""))
    asked = mapped.filter("value is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", topic.alias("t")))).alias("ts"))
    asked = asked.select(F.col(key).alias("map_id"), F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("user"))
    kind = asked.schema["map_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for map_id, user in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reply = model.complete_json("TASK: reduce", user)
                if not reply.get("children"):
                    continue
                todo = [((), reply | {"title": reply.get("central") or "Mind Map", "type": "root"})]
                for path, node in todo:  # grows as it is walked
                    rows.append((map_id, list(path), node.get("title") or "", node.get("type") or "topic", node.get("note")))
                    todo.extend(((*path, i), child) for i, child in enumerate(node.get("children") or []))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [batch.schema.field(0).type, pa.list_(pa.int32()), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["map_id", "path", "title", "type", "note"])

    nodes = asked.mapInArrow(run, f"map_id {kind}, path array<int>, title string, type string, note string")
    typed = nodes.withColumn("type", F.when(F.size("path") == 0, "root").otherwise(T.node_type(F.col("type"))))
    return typed.filter(F.size("path") <= 1) if level == "brief" else typed


def links_by_number(nodes: DataFrame, links: DataFrame, cross: bool = False) -> DataFrame:
    """Links (map_id, seq, a, b) by depth-first number, the root left out, as (map_id, seq, a_path, b_path).

    Numbers out of range go, and so do self-links and pairs seen before either way; ancestor pairs too or, if cross,
    pairs within one top-level branch.
    """
    placed = trees.walk(nodes).filter("position > 0").select("map_id", (F.col("position") - 1).alias("n"), "path")
    end = lambda side: placed.select("map_id", F.col("n").alias(side), F.col("path").alias(f"{side}_path"))
    both = links.select("map_id", "seq", "a", "b").join(end("a"), ["map_id", "a"]).join(end("b"), ["map_id", "b"]).select("map_id", "seq", "a_path", "b_path")
    if cross:
        both = both.filter(F.get("a_path", F.lit(0)) != F.get("b_path", F.lit(0)))
    return trees.valid_links(both, hierarchical=cross)


def parent_and_index(nodes: DataFrame) -> DataFrame:
    """(map_id, path, parent, index) of each node but the root."""
    k = F.size("path")
    return nodes.filter(k > 0).select("map_id", "path", F.slice("path", 1, F.greatest(k - 1, F.lit(0))).alias("parent"), F.try_element_at("path", F.lit(-1)).alias("index"))


def node_at(nodes: DataFrame, map_id, path: list[int]) -> DataFrame:
    return nodes.filter((F.col("map_id") == F.lit(map_id)) & (F.col("path") == F.array(*[F.lit(p) for p in path]).cast("array<int>")))


def preview(nodes: DataFrame, max_depth: int | None = None, note_length: int = 50) -> DataFrame:
    """(map_id, path, line) of each node down to max_depth: indent, icon, title, the note's beginning, how many lie below the cut."""
    below = trees.subtree(nodes).select("map_id", "path", "n_nodes")
    note = T.strip(F.coalesce("note", F.lit("")))
    head = F.substring(note, 1, note_length)
    cut = F.when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    short = F.when(F.length(note) > note_length, F.concat(cut, F.lit("…"))).otherwise(note)
    depth = F.size("path")
    shown = nodes if max_depth is None else nodes.filter(depth <= max_depth)
    icons = F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv])
    more = F.when((depth == (-1 if max_depth is None else max_depth)) & (F.col("n_nodes") > 1), F.format_string("  (+%d more)", F.col("n_nodes") - 1)).otherwise("")
    told = F.when((note != "") & (depth > 0), F.concat(F.lit("  — "), short)).otherwise("")
    line = F.concat(F.repeat(F.lit("  "), depth), icons[F.col("type")], F.lit(" "), F.col("title"), told, more)
    return shown.join(below, ["map_id", "path"]).select("map_id", "path", line.alias("line"))


def merge_maps(nodes: DataFrame, links: DataFrame, items: DataFrame, title: str) -> tuple[DataFrame, DataFrame]:
    """One tree of many, and their links (map_id, seq, a_path, b_path, label) moved along; items (map_id, ordinal, label)."""
    moved = links.join(items.select("map_id", "ordinal"), "map_id")
    under = lambda c: F.concat(F.array(F.col("ordinal").cast("int")), c)
    return trees.union_maps(nodes, items, title), moved.select("ordinal", "seq", under("a_path").alias("a_path"), under("b_path").alias("b_path"), "label")


def timed_topics(segments: DataFrame, level: str = "full", key: str = "source") -> DataFrame:
    """(map_id, path, timestamp, text) of each topic of segmented sources: where its first segment starts.

    A source has a clock if any segment has a start or a duration; else its timestamps are null.
    """
    text = T.strip(F.col("text"))
    seg = F.struct("seq", text.alias("text"), "start")
    real = F.bool_or((F.coalesce("start", F.lit(0.0)) != 0) | (F.coalesce("duration", F.lit(0.0)) != 0))
    rows = segments.filter(text != "").groupBy(key).agg(F.array_sort(F.collect_list(seg)).alias("s"), real.alias("timed"))
    each = rows.select(F.col(key).alias("map_id"), "timed", "s", F.posexplode(even_chunks(F.transform("s", lambda x, i: i.cast("string")), TOPICS[level])).alias("i", "run"))
    first = F.get("run", F.lit(0)).cast("int")
    words = F.transform(F.slice("s", first + 1, F.size("run")), lambda x: x["text"])
    return each.select("map_id", F.array("i").alias("path"), F.when(F.col("timed"), F.get("s", first)["start"]).alias("timestamp"), F.array_join(words, " ").alias("text"))


def timed_map(segments: DataFrame, sources: DataFrame, level: str = "full", key: str = "source") -> DataFrame:
    """Nodes (map_id, path, title, type, note, timestamp) of segmented sources (key, seq, text, start, duration) without a model.

    As heuristic.flat_map makes them, with the time at which each topic starts. sources (key, title) has every source:
    one without text gets a node that says so.
    """
    level = level if level in TOPICS else "full"
    rows = timed_topics(segments, level, key).withColumn("sents", T.sentences(F.col("text")))
    null = F.lit(None)
    row = lambda df, path, title, kind, note, at: df.select("map_id", path.cast("array<int>").alias("path"), title.alias("title"), F.lit(kind).alias("type"), note.cast("string").alias("note"), at.cast("double").alias("timestamp"))
    roots = sources.select(F.col(key).alias("map_id"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Mind Map")).alias("title"))
    silent = roots.join(rows.select("map_id").distinct(), "map_id", "left_anti")
    head = F.coalesce(F.get("sents", F.lit(0)), "text")
    topics = row(rows, F.col("path"), T.snippet_title(head), "topic", T.truncate(F.col("text"), 500), F.col("timestamp"))
    points = rows.select("map_id", "path", F.posexplode(leaves(F.col("sents"), LEAVES[level])).alias("j", "point"))
    points = row(points, F.concat("path", F.array("j")), F.col("point"), "detail", null, null)
    return (
        row(roots, F.array(), F.col("title"), "root", null, null).unionByName(topics).unionByName(points)
        .unionByName(row(silent, F.array(F.lit(0)), F.lit("(no content extracted)"), "detail", null, null))
    )


def polished(sections: DataFrame, headings: DataFrame, key: str = "map_id") -> DataFrame:
    """sections (key, number, heading) with the headings (key, headings: array) a provider gave, by position; all or none of a source."""
    sizes = sections.groupBy(key).agg(F.count("*").alias("n"))
    whole = headings.join(sizes, key).filter(F.size("headings") == F.col("n")).select(key, "headings")
    given = F.nullif(T.strip(F.get("headings", F.col("number") - 1)), F.lit(""))
    return sections.join(whole, key, "left").withColumn("heading", F.coalesce(given, "heading")).drop("headings")


def route(sources: DataFrame, has_outline: Column, has_provider: bool) -> DataFrame:
    """sources with the engine that structures them: document where there is an outline, else a provider, else heuristic."""
    return sources.withColumn("engine", F.when(has_outline, "document").otherwise(F.lit("llm" if has_provider else "heuristic")))


def failover(sources: DataFrame, attempts: list[DataFrame], key: str = "map_id") -> DataFrame:
    """(key, engine, used_fallback): the first of attempts (key, engine) that has a source, in order; heuristic for the others."""
    tried = None
    for i, done in enumerate(attempts):
        rows = done.select(key, "engine", F.lit(i).alias("turn"))
        tried = rows if tried is None else tried.unionByName(rows)
    if tried is None:
        return sources.select(key, F.lit("heuristic").alias("engine"), F.lit(False).alias("used_fallback"))
    best = tried.groupBy(key).agg(F.min_by("engine", "turn").alias("engine"), F.min("turn").alias("turn"))
    told = sources.select(key).join(best, key, "left")
    return told.select(key, F.coalesce("engine", F.lit("heuristic")).alias("engine"), (F.coalesce("turn", F.lit(len(attempts))) > 0).alias("used_fallback"))
