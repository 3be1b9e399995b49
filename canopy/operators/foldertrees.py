"""Folder trees as maps: depth and file caps, notes, signatures, and labels kept from run to run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import folders
from . import snapshots
from .store import Store, written

#: (path, parent, name, is_dir, size, mtime, depth) of everything below a root, the root itself with depth 0 and no parent.
FILES = ["path", "parent", "name", "is_dir", "size", "mtime", "depth"]


def build(files: DataFrame, max_depth: int = 8, max_files: int = 20, everything: DataFrame | None = None) -> DataFrame:
    """Nodes (path, title, type, note, folder) of a listing's tree; folder is the path of a folder's own node, else null.

    Folders come before files, each by lower-case name. A folder shows max_files files and one row for the rest; its
    note counts its folders and all its files. A folder at max_depth isn't looked into: one row says how many items lie
    below it, at any depth, which are counted in `everything` (path), a listing that left nothing out, if it is given.
    Files that stand out are definitions, others details. Folders nest as deep as the listing does.
    """
    shown = files.filter(F.col("depth") <= max_depth)
    inside = shown.filter("depth > 0")
    order = Window.partitionBy("parent").orderBy(F.when(F.col("is_dir"), 0).otherwise(1), F.lower("name"), "name")
    counted = Window.partitionBy("parent")
    # The places first: what sorts them serves the counts too.
    placed = inside.withColumn("at", F.row_number().over(order) - 1)
    placed = placed.withColumns({"dirs": F.sum(F.col("is_dir").cast("int")).over(counted), "all": F.count("*").over(counted)})
    placed = placed.withColumn("file", F.when(~F.col("is_dir"), F.col("at") - F.col("dirs")))
    # One pass over all files leaves the shown ones and the first of the others, which has a folder's counts.
    first = placed.filter(F.col("is_dir") | (F.col("file") <= max_files) | (F.col("at") == 0))
    first = written(first.select("parent", "at", "name", "is_dir", F.when(F.col("is_dir"), F.col("path")).alias("folder"), "dirs", "all", "file"), "folder-files")
    kept = first.filter(F.col("is_dir") | (F.col("file") < max_files))
    kind = F.when(F.col("is_dir"), "topic").when(folders.notable(F.col("name")), "definition").otherwise("detail")
    rows = kept.select("parent", "at", F.col("name").alias("title"), kind.alias("type"), "folder")
    rest = first.filter(F.col("file") == max_files).select("parent", "at", F.concat(F.lit("+"), (F.col("all") - F.col("dirs") - max_files).cast("string"), F.lit(" more file(s)")).alias("title"))
    cut = _below(files, max_depth, everything)
    more = rest.unionByName(cut).select("parent", "at", "title", F.lit("detail").alias("type"), F.lit(None).cast("string").alias("folder"))
    rows = written(rows.unionByName(more), "folder-rows")
    notes = first.filter("at = 0").select(F.col("parent").alias("folder"), F.concat(F.col("dirs").cast("string"), F.lit(" folder(s), "), (F.col("all") - F.col("dirs")).cast("string"), F.lit(" file(s)")).alias("note"))

    # From the root down, a level a step: what lies in a folder is placed below it by an equi-join.
    top = files.filter("depth = 0").select(F.array().cast("array<int>").alias("path"), F.col("name").alias("title"), F.lit("root").alias("type"), F.col("path").alias("folder"))
    out = level = written(top, "folder-level")
    for _ in range(max_depth + 1):
        above = level.filter("folder is not null").select(F.col("path").alias("above"), F.col("folder").alias("parent"))
        level = rows.join(above, "parent").select(F.concat("above", F.array(F.col("at").cast("int"))).alias("path"), "title", "type", "folder")
        level = written(level, "folder-level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    # At the cap a folder's children weren't looked at, so it has no counts.
    return _told(out.withColumn("note", F.lit(None).cast("string")), notes.withColumnRenamed("note", "_label"))


def _told(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with the notes that labels (folder, _label) have for their folders; other nodes, which are most, aren't joined."""
    named = nodes.filter("folder is not null").join(labels, "folder", "left").withColumn("note", F.coalesce("_label", "note"))
    columns = ["path", "title", "type", "note", "folder"]
    return named.select(columns).unionByName(nodes.filter("folder is null").select(columns))


def _below(files: DataFrame, max_depth: int, everything: DataFrame | None) -> DataFrame:
    """(parent, at, title) of the row that stands for all below a folder at the cap, where there is something.

    Paths begin with /, and their parts are counted: what lies deeper tells the folder that its first parts name.
    """
    every = files if everything is None else everything
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    deeper = every.withColumn("parts", parts).filter(F.size("parts") > max_depth)
    owner = F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, max_depth), "/"))
    told = deeper.groupBy(owner.alias("parent")).agg(F.count("*").alias("n"))
    capped = files.filter(F.col("is_dir") & (F.col("depth") == max_depth)).select(F.col("path").alias("parent"))
    return told.join(capped, "parent", "left_semi").select("parent", F.lit(0).alias("at"), F.concat(F.lit("+"), F.col("n").cast("string"), F.lit(" more item(s)")).alias("title"))


def signatures(files: DataFrame, max_depth: int = 8) -> DataFrame:
    """(folder, signature) of the folders above the cap; a folder at the cap wasn't looked into and has none.

    A signature hashes the names, sizes and times of a folder's files, capped ones too, and the names and signatures of
    its folders; one at the cap tells its name alone.
    """
    # A folder at the cap counts with what lies right in it left out; files of a folder above the cap may lie at the cap.
    seen = files.filter(F.col("depth") <= max_depth)
    looked_into = files.filter(F.col("is_dir") & (F.col("depth") < max_depth)).select("path")
    return snapshots.merkle(seen).join(looked_into, "path", "left_semi").select(F.col("path").alias("folder"), "signature")


@dataclass
class Tree:
    """nodes of the map; diff (folder, status) against the last version, None on a first run; wanted (path) to be labelled."""

    nodes: DataFrame
    diff: DataFrame | None
    wanted: DataFrame
    version: int | None


def run(store: Store, root: str, files: DataFrame, max_depth: int = 8, max_files: int = 20, everything: DataFrame | None = None, incremental: bool = True,
        label: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Tree:
    """The map of a folder, and what changed since the last version with the same caps.

    A folder whose signature is as it was keeps the label it had; the other folders but the root are wanted, and label,
    if given, gets (nodes, wanted) and gives the nodes with labels for their notes. Signatures and labels are written
    and committed last, so a run that fails while labelling leaves what was there.
    """
    files = written(files.select(FILES), "folder-listing")  # what lists them, joins maybe, is done once
    params = json.dumps({"max_depth": max_depth, "max_files": max_files})
    marks = written(signatures(files, max_depth), "folder-signatures")
    nodes = written(build(files, max_depth, max_files, everything), "folder-nodes")
    before = store.version(root, params) if incremental else None
    old = None if before is None else store.read("folders", root, before)
    changed, diff = nodes.filter("folder is not null").select("folder"), None
    if old is not None:
        told = snapshots.tree_diff(marks.withColumnRenamed("folder", "relpath"), old.withColumnRenamed("folder", "relpath"))
        diff = written(told, "folder-diff")
        kept = diff.filter("status = 'reused'").select(F.col("relpath").alias("folder"), F.col("label").alias("_label"))
        nodes = _told(nodes, kept)
        changed = changed.join(kept.select("folder"), "folder", "left_anti")
        diff = diff.select(F.col("relpath").alias("folder"), "status")
    wanted = nodes.filter(F.size("path") > 0).join(changed, "folder", "left_semi").select("path")
    labels = nodes.select("folder", F.lit(None).cast("string").alias("label")).limit(0) if old is None else kept.select("folder", F.col("_label").alias("label"))
    if label is not None:
        plain = nodes.filter("folder is not null").select("path", F.col("note").alias("_was"))
        nodes = written(label(nodes, wanted), "folder-labelled")
        fresh = nodes.join(plain, "path").filter("folder is not null and note is not null and not note <=> _was").select("folder", F.col("note").alias("label"))
        labels = labels.join(fresh.select("folder"), "folder", "left_anti").unionByName(fresh)
    version = time.time_ns()
    store.append("folders", root, version, marks.join(labels.filter("label is not null"), "folder", "left").select("folder", "signature", "label"))
    store.commit(root, version, params)
    return Tree(nodes, diff, wanted, version)
