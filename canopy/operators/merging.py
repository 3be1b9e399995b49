"""Maps read from files, merged into one with their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import mapfiles
from . import structuring
from .store import written


def resolve_links(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (map_id, seq, from_id, to_id, label) as (map_id, seq, a_path, b_path, label), and (map_id, lost) of those with an end that no node has.

    nodes: (map_id, path, node_id, ...); of nodes of one id in a map the first in the walk counts. A map is in the
    second table only if it lost a link.
    """
    ids = nodes.filter("node_id is not null").groupBy("map_id", "node_id").agg(F.min("path").alias("path"))
    end = lambda of, to: ids.select("map_id", F.col("node_id").alias(of), F.col("path").alias(to))
    both = links.join(end("from_id", "a_path"), ["map_id", "from_id"], "left").join(end("to_id", "b_path"), ["map_id", "to_id"], "left")
    whole = F.col("a_path").isNotNull() & F.col("b_path").isNotNull()
    lost = both.filter(~whole).groupBy("map_id").agg(F.count("*").alias("lost"))
    return both.filter(whole).select("map_id", "seq", "a_path", "b_path", "label"), lost


def merge_files(files: DataFrame, title: str = "Merged Map") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One map of map files (path, content, ordinal), two at least: its nodes, its links, and (map_id, lost) links a file lost.

    Each file is a branch named by its map's title, else by its file name, in the order of ordinal (gapless from 0,
    which is the branch's place). Links are each file's own, with both ends moved below its branch; seq orders them by
    file, then as they stand there.
    """
    nodes = written(mapfiles.parse(files), "merge-nodes")
    heads = written(mapfiles.heads(files), "merge-heads")
    if heads.limit(2).count() < 2:
        raise ValueError("two maps at least are merged")
    stem = F.regexp_replace(F.regexp_extract("map_id", "([^/]*)$", 1), r"\.[^.]*$", "")
    items = heads.select("map_id", F.coalesce(F.nullif("title", F.lit("")), stem).alias("label"))
    items = items.join(files.select(F.col("path").alias("map_id"), "ordinal"), "map_id")
    links, lost = resolve_links(nodes, written(mapfiles.parse_links(files), "merge-links"))
    tree, moved = structuring.merge_maps(nodes, links, items, title)
    order = (F.col("ordinal").cast("long") * (1 << 32) + F.col("seq")).alias("seq")
    return tree, moved.select(order, "a_path", "b_path", "label"), lost


def counts(nodes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(map_id, n_nodes, depth, n_links) of each map; a map without links has 0."""
    told = nodes.groupBy("map_id").agg(F.count("*").alias("n_nodes"), (F.max(F.size("path")) + 1).alias("depth"))
    if links is None:
        return told.withColumn("n_links", F.lit(0).cast("long"))
    drawn = links.groupBy("map_id").agg(F.count("*").alias("n_links"))
    return told.join(drawn, "map_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))


def _first_hits(nodes: DataFrame, most: int) -> DataFrame:
    first = Window.partitionBy("map_id").orderBy("path")
    found = nodes.withColumn("r", F.row_number().over(first))
    return found.filter(F.col("r") <= most).select("map_id", "path", "title", "note")


def _hit(query: str) -> Column:
    if not query:
        raise ValueError("what is searched for is empty")
    return F.lower(F.concat(F.col("title"), F.lit(" "), F.coalesce("note", F.lit("")))).contains(query.lower())


def lenient_search(files: DataFrame, query: str, most: int = 10) -> DataFrame:
    """(map_id, path, title, note) of the first `most` nodes of each file that hold the query; all outlines and sheets count, broken files give nothing."""
    return _first_hits(mapfiles.parse(files, lenient=True).filter(_hit(query)), most)


def search(files: DataFrame, query: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """What lenient_search finds, and (map_id, error) of the files that couldn't be read, so that none is taken for one without a hit."""
    rows = written(mapfiles.parse(files, lenient=True, told=True).filter(_hit(query) | F.col("error").isNotNull()), "search")
    return _first_hits(rows.filter("error is null"), most), rows.filter("error is not null").select("map_id", "error")
