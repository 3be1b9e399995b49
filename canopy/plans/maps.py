"""From documents to maps in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import heuristic, trees


def star_tree(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """Nodes (map_id, path, title, type, note) of one map: regions, their nations, their customers, each by key."""
    rank = lambda df, by, key: df.withColumn("o", F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1)
    node = lambda df, path, title, kind: df.select(F.lit("world").alias("map_id"), path.cast("array<int>").alias("path"), title.alias("title"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("note"))
    r = region.select("r_regionkey", "r_name", F.col("r_regionkey").cast("int").alias("ro"))
    n = rank(nation, "n_regionkey", "n_nationkey").select("n_nationkey", "n_name", "n_regionkey", F.col("o").alias("no")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    c = rank(customer, "c_nationkey", "c_custkey").select("c_custkey", "c_name", "c_nationkey", "o").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    root = region.sparkSession.range(1)
    return (
        node(root, F.array(), F.lit("World"), "root").unionByName(node(r, F.array("ro"), F.col("r_name"), "topic"))
        .unionByName(node(n, F.array("ro", "no"), F.col("n_name"), "concept")).unionByName(node(c, F.array("ro", "no", "o"), F.col("c_name"), "detail"))
    )


def batch_map(docs: DataFrame, title: str, key: str = "doc_id", level: str = "brief") -> DataFrame:
    """One map of all docs: each document's map is a branch, numbered by its key, a whole number."""
    nodes = heuristic.flat_map(docs, level, key)
    # A key is an ordinal already: branches only need its order, and numbering all rows would take one task.
    items = docs.select(F.col(key).alias("map_id"), F.col(key).cast("int").alias("ordinal"), F.concat(F.lit("Document "), F.col(key).cast("string")).alias("label"))
    return trees.union_maps(nodes, items, title)
