"""Connected components by randomised contraction, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, root) for each node that has an edge; nodes of one component share their root.

    In each round a node goes to the neighbour (or itself) of the smallest hash, seeded by the round. The expected
    number of nodes shrinks by a constant factor a round, for chains and stars alike, so the rounds grow with the
    logarithm of the input. Round results are written tables, so that a lost executor costs one round at most.
    Self-loops and repeated edges do no harm; an empty input gives an empty result; edges with a null end are left out.
    """
    live = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    live = materialize(live.distinct(), "cc-edges")
    nodes = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    live, seed = live.filter("a <> b"), 0
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), c.alias("v"))
        step = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select(
            F.col("a").alias("old"), F.least(F.col("m"), rank(F.col("a")))["v"].alias("new")
        )
        step = materialize(step, "cc-step")
        roots = materialize(
            roots.join(step, roots.root == step.old, "left").select("node", F.coalesce("new", "root").alias("root")), "cc-roots"
        )
        first = live.join(step, live.a == step.old).select(F.col("new").alias("a"), "b")
        live = first.join(step, first.b == step.old).select("a", F.col("new").alias("b"))
        live = live.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        live, seed = materialize(live, "cc-edges"), seed + 1
    return roots
