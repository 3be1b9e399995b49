"""What changed since last time: fingerprints, reuse, folder signatures, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written


def reuse(current: DataFrame, old: DataFrame, key: str = "source", mark: str = "fingerprint") -> DataFrame:
    """(key, status) of each item: reused (known, and its old mark null or the same), new, or removed."""
    a = current.select(key, F.col(mark).alias("new"), F.lit(True).alias("here"))
    b = old.select(key, F.col(mark).alias("old"), F.lit(True).alias("there"))
    both = a.join(b, key, "full_outer")
    same = F.col("there") & (F.col("old").isNull() | F.col("old").eqNullSafe(F.col("new")))
    status = F.when(F.col("here").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "reused").otherwise("new")
    return both.select(key, status.alias("status"))


def tree_diff(current: DataFrame, old: DataFrame, key: str = "relpath", mark: str = "signature") -> DataFrame:
    """(key, status, label): reused, changed, added, deleted; an unchanged folder keeps its label."""
    a = current.select(key, F.col(mark).alias("new"), F.lit(True).alias("here"))
    b = old.select(key, F.col(mark).alias("old"), F.col("label") if "label" in old.columns else F.lit(None).cast("string").alias("label"), F.lit(True).alias("there"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull(), "added").when(F.col("old").eqNullSafe(F.col("new")), "reused").otherwise("changed")
    return both.select(key, status.alias("status"), F.when(status == "reused", F.col("label")).alias("label"))


def signature(rows: Column) -> Column:
    """Sixteen digits of the hash of sorted lines."""
    return F.substring(F.sha2(F.array_join(F.array_sort(rows), "\n"), 256), 1, 16)


def merkle(files: DataFrame) -> DataFrame:
    """(path, signature) of each folder of files (path, parent, name, is_dir, size, mtime, depth), from the leaves up.

    A round for each depth, deepest first; depth is bounded by the folder cap, and a round's rows are folders only. What
    lies right in a folder is collected before, and each round is written, so that none is made again for what is above it.
    """
    name = lambda *parts: F.concat_ws(":", *parts)
    leaves = files.filter(~F.col("is_dir")).select("parent", name(F.lit("f"), "name", F.col("size").cast("string"), F.col("mtime").cast("string")).alias("line"))
    by_parent = leaves.groupBy("parent").agg(F.collect_list("line").alias("own"))
    folders = files.filter("is_dir").select("path", "parent", "name", "depth").join(by_parent.withColumnRenamed("parent", "path"), "path", "left")
    folders = written(folders, "merkle-files")  # so that files are collected once, not in every round
    deepest = folders.agg(F.max("depth")).first()[0]
    done, below = None, None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = folders.filter(F.col("depth") == depth)
        own = F.coalesce("own", F.array().cast("array<string>"))
        if below is not None:
            level, own = level.join(below, level["path"] == F.col("up"), "left"), F.concat(own, F.coalesce("subs", F.array().cast("array<string>")))
        level = written(level.select("path", "parent", "name", signature(own).alias("signature")), "merkle")
        done = level if done is None else done.unionByName(level)
        below = level.groupBy(F.col("parent").alias("up")).agg(F.collect_list(name(F.lit("d"), "name", "signature")).alias("subs"))
    if done is None:
        return folders.select("path", F.lit("").alias("signature"))
    return done.select("path", "signature")


def capped(files: DataFrame, most: int) -> DataFrame:
    """(parent, rank, title): folders first, then files by lower-case name up to most, then one line for the rest."""
    order = Window.partitionBy("parent").orderBy(F.when(F.col("is_dir"), 0).otherwise(1), F.lower("name"), "name")
    dirs = F.sum(F.col("is_dir").cast("int")).over(Window.partitionBy("parent"))
    ranked = files.withColumn("rank", F.row_number().over(order)).withColumn("file_rank", F.when(~F.col("is_dir"), F.col("rank") - dirs))
    kept = ranked.filter(F.col("is_dir") | (F.col("file_rank") <= most)).select("parent", "rank", F.col("name").alias("title"))
    rest = ranked.filter(F.col("file_rank") > most).groupBy("parent").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    return kept.unionByName(rest.select("parent", "rank", F.concat(F.lit("+"), F.col("n").cast("string"), F.lit(" more file(s)")).alias("title")))


def folder_counts(files: DataFrame) -> DataFrame:
    """(parent, note): how many folders and files each folder has."""
    n = files.groupBy("parent").agg(F.count_if("is_dir").alias("d"), F.count_if(~F.col("is_dir")).alias("f"))
    return n.select("parent", F.concat(F.col("d").cast("string"), F.lit(" folder(s), "), F.col("f").cast("string"), F.lit(" file(s)")).alias("note"))


def sidecars(media: DataFrame, subtitles: DataFrame, key: str = "stem") -> DataFrame:
    """(key, path, needs_transcription): media with their subtitles by stem (of several the last), then other subtitles."""
    best = subtitles.groupBy(key).agg(F.max("path").alias("subtitle"))
    named = media.select(key, "path").join(best, key, "left")
    av = named.select(key, F.coalesce("subtitle", "path").alias("path"), F.col("subtitle").isNull().alias("needs_transcription"))
    alone = subtitles.join(media.select(key).distinct(), key, "left_anti").select(key, "path", F.lit(False).alias("needs_transcription"))
    return av.unionByName(alone)


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key, ...) whose key the cache (key, value) lacks."""
    return requests.join(cache.select("key"), "key", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"))


def manifest_lookup(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """wanted (source, level, format) with the output that was last recorded for it, null where there's none."""
    last = manifest.groupBy("source", "level", "format").agg(F.max_by("output", "recorded").alias("output"))
    return wanted.join(last, ["source", "level", "format"], "left")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row of counts from (status): how a batch went; failed if nothing went well."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "failed", "reused", "added", "removed")]
    return outcomes.agg(*counts).withColumn("all_failed", (F.col("ok") + F.col("reused") == 0) & (F.col("failed") > 0))


def diagnostics(checks: DataFrame) -> DataFrame:
    """(group, worst) of checks (group, status): fail over warn over ok."""
    rank = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return checks.groupBy("group").agg(F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), rank + 1).alias("worst"))


def first_items(items: DataFrame, most: int, *order) -> DataFrame:
    """The first items in an order, the same ones each time."""
    return items.orderBy(*order).limit(most)
