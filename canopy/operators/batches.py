"""Batches of sources, structured once: unchanged items are restored from the last version, the others are built."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import snapshots, structuring
from .store import Store, numbered, written

NODES = ["map_id", "path", "title", "type", "note"]
LINKS = ["map_id", "seq", "a_path", "b_path", "label"]
#: What a version of a batch holds.
TABLES = ["items", "nodes", "links"]
Build = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]


@dataclass
class Batch:
    """nodes and links of the combined map; outcomes (source, label, status: ok, failed, reused); diff (label, status), None on a first run."""

    nodes: DataFrame
    links: DataFrame
    outcomes: DataFrame
    diff: DataFrame | None
    version: int


def run(store: Store, batch: str, items: DataFrame, build: Build, title: str, level: str = "full", incremental: bool = True, blocks: int = 1) -> Batch:
    """The map of a batch of items (source, label, ordinal, fingerprint), each a branch, in the order of ordinal.

    An item whose fingerprint is as it was, or had none, is restored from the batch's last version of the same level;
    the others go to build, which gives nodes and links with map_id = source. An item that build gives no nodes is
    failed, has no branch and isn't stored. Items are built in `blocks` steps, by hash, and each step is committed with
    all before it; a step that raises an error leaves the last commit. A source stands once in items; without any
    branch the map says so.
    """
    spark, params = store.spark, json.dumps({"level": level})
    before = store.version(batch, params) if incremental else None
    version = time.time_ns()
    items = written(items.select("source", "label", "ordinal", "fingerprint"), "batch-items")
    reused = old = None
    if before is not None:
        old = store.read("items", batch, before)
        status = snapshots.reuse(items, old)
        reused = written(status.filter("status = 'reused'").select("source"), "batch-reused")
        kept = reused.withColumnRenamed("source", "map_id")
        for name in ("nodes", "links"):
            rows = store.read(name, batch, before)
            if rows is not None:
                store.append(name, batch, version, rows.join(kept, "map_id", "left_semi"))
        store.append("items", batch, version, items.join(reused, "source", "left_semi"))
    todo = items if reused is None else items.join(reused, "source", "left_anti")
    for block in range(blocks):
        part = todo if blocks == 1 else todo.filter(F.pmod(F.xxhash64("source"), F.lit(blocks)) == block)
        nodes, links = build(part)
        # Nodes first, then what says that they are whole: an item counts once its row is there.
        store.append("nodes", batch, version, nodes.select(NODES))
        if links is not None:
            store.append("links", batch, version, links.select(LINKS))
        built = store.read("nodes", batch, version).select(F.col("map_id").alias("source")).distinct()
        store.append("items", batch, version, part.join(built, "source", "left_semi"))
        store.commit(batch, version, params)

    done = store.read("items", batch, version)
    nodes, links = combined(done, store.read("nodes", batch, version), store.read("links", batch, version), title)
    known = done.select("source", F.lit("ok").alias("built"))
    outcomes = items.select("source", "label").join(known, "source", "left")
    told = F.coalesce("built", F.lit("failed"))
    if reused is not None:
        outcomes = outcomes.join(reused.withColumn("again", F.lit(True)), "source", "left")
        told = F.when(F.col("again"), "reused").otherwise(told)
    outcomes = outcomes.select("source", "label", told.alias("status"))
    if old is None:
        return Batch(nodes, links, outcomes, None, version)
    gone = old.join(items.select("source"), "source", "left_anti").select("label", F.lit("removed").alias("status"))
    here = outcomes.select("label", F.when(F.col("status") == "reused", "reused").otherwise("added").alias("status"))
    return Batch(nodes, links, outcomes, here.unionByName(gone), version)


def combined(items: DataFrame, nodes: DataFrame, links: DataFrame | None, title: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, title, type, note) and links (seq, a_path, b_path, label) of one map with a branch for each item.

    Branches are numbered without gaps, in the order of ordinal and source; links keep the order of their branches.
    """
    spark = items.sparkSession
    branches = numbered(items.select("source", "label", "ordinal"), ["ordinal", "source"], "at")
    branches = branches.select(F.col("source").alias("map_id"), F.col("at").alias("ordinal"), "label")
    if links is None:
        kinds = f"map_id {nodes.schema['map_id'].dataType.simpleString()}, seq long, a_path array<int>, b_path array<int>, label string"
        links = spark.createDataFrame([], kinds)
    tree, moved = structuring.merge_maps(nodes, links, branches, title)
    if items.isEmpty():
        empty = spark.range(1).select(F.array(F.lit(0)).alias("path"), F.lit("(no items processed successfully)").alias("title"), F.lit("detail").alias("type"), F.lit(None).cast("string").alias("note"))
        tree = tree.unionByName(empty)
    return tree, moved.select((F.col("ordinal") * (1 << 32) + F.col("seq")).alias("seq"), "a_path", "b_path", "label")


def result(batch: Batch, **about) -> DataFrame:
    """One row (result): the counts of a batch as a JSON object, with what is said `about` it before them.

    reused, added and removed are null on a first run. What failed or went is rows of outcomes and diff, not a list
    here, for either may be as long as the batch. Links across branches are cross_source_relationships.
    """
    nodes = batch.nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.max(F.size("path")) + 1, F.lit(0)).alias("depth"))
    across = F.get("a_path", F.lit(0)) != F.get("b_path", F.lit(0))
    links = batch.links.agg(F.count("*").alias("relationships"), F.count_if(across).alias("cross_source_relationships"))
    done = batch.outcomes.agg(F.count("*").alias("items_total"), F.count_if(F.col("status") != "failed").alias("items_ok"), F.count_if(F.col("status") == "failed").alias("items_failed"))
    kinds = ("reused", "added", "removed")
    if batch.diff is None:
        changes = batch.nodes.sparkSession.range(1).select(*[F.lit(None).cast("long").alias(k) for k in kinds])
    else:
        changes = batch.diff.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    row = nodes.crossJoin(links).crossJoin(done).crossJoin(changes)  # of one row each
    said = [F.lit(v).alias(k) for k, v in {"ok": True, **about}.items()]
    return row.select(F.to_json(F.struct(*said, *row.columns), {"ignoreNullFields": "false"}).alias("result"))
