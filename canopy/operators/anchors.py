"""Anchors: numbers, listed examples and names of a source that its map must not lose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import trees
from .store import MOST, written


def anchors(sources: DataFrame, key: str = "map_id", text_col: str = "text") -> DataFrame:
    """(key, kind, at, anchor, norm) of each distinct anchor: kind 0 numbers, 1 listed items, 2 names, in text order."""
    text = F.coalesce(text_col, F.lit(""))
    tag = lambda values, kind: F.transform(values, lambda a, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), a.alias("anchor"), (T.number_key(a) if kind == 0 else T.norm(a)).alias("norm")))
    every = F.concat(tag(T.number_anchors(text), 0), tag(T.list_items(text), 1), tag(T.proper_nouns(text), 2))
    rows = sources.select(key, F.explode(every).alias("a")).select(key, "a.*").filter("norm <> ''")
    first = F.min(F.struct("kind", "at", "anchor")).alias("m")
    kind = F.when(F.col("kind") == 0, 0).otherwise(1)
    return rows.groupBy(key, kind.alias("k"), "norm").agg(first).select(key, "m.kind", "m.at", "m.anchor", "norm")


def missing(sources: DataFrame, nodes: DataFrame, most: int = 8, text_col: str = "text") -> DataFrame:
    """(map_id, rank, anchor) of a source's anchors that its map lacks: numbers by key, terms by substring; most a map."""
    found = written(anchors(sources, "map_id", text_col), "anchors")
    nodes = _of(nodes, found)
    text = F.concat_ws(" ", "title", "note")
    numbers = nodes.select("map_id", F.explode(F.transform(T.number_anchors(text), T.number_key)).alias("norm")).distinct()
    lost = found.filter("kind = 0").join(numbers, ["map_id", "norm"], "left_anti")
    said = nodes.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("path", text.alias("t")))).alias("ts"))
    said = said.select("map_id", T.norm(F.array_join(F.transform("ts", lambda x: x["t"]), " ")).alias("said"))
    terms = found.filter("kind > 0").join(said, "map_id", "left").filter(~F.coalesce(F.col("said").contains(F.col("norm")), F.lit(False)))
    order = Window.partitionBy("map_id").orderBy("kind", "at")
    every = lost.unionByName(terms.select(*lost.columns)).withColumn("rank", F.row_number().over(order))
    return every.filter(F.col("rank") <= most).select("map_id", "rank", "anchor")


def _of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of the maps that rows (map_id) name, where those are few; else all, for picking them would move all."""
    maps = written(rows.select("map_id").distinct(), "maps")
    return nodes.join(F.broadcast(maps), "map_id", "left_semi") if maps.count() <= MOST else nodes


def repair(nodes: DataFrame, repairs: DataFrame) -> DataFrame:
    """nodes with new leaves from repairs (map_id, seq, to, title, type), to being a node's number in the walk, the root left out.

    Repairs of one node come after its children, in the order of seq; a number that no node has and an empty title are
    passed over, an unknown type is topic. Other columns of nodes are null in the new ones.
    """
    told = T.strip(F.coalesce("title", F.lit("")))
    good = written(repairs.select("map_id", "seq", "to", told.alias("title"), T.node_type(F.col("type")).alias("type")).filter("title <> ''"), "repairs")
    mine = _of(nodes, good)
    placed = trees.walk(mine).filter("position > 0").select("map_id", (F.col("position") - 1).alias("to"), F.col("path").alias("parent"))
    return trees.insert(nodes, good.join(placed, ["map_id", "to"]).select("map_id", "parent", "seq", "title", "type"), mine)
