"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a sample; every vector is then put into a leaf. A search walks the tree by a priority queue, best
centroid first, and reads leaves in that order; how many is calibrated: a bounded set of queries is compared with all
vectors in blocks, and visits widen until their recall reaches the target. A query whose leaves hold too few vectors
for a whole result reads on.

The leaves are half the square root of the distinct vectors, so neither the tree nor a leaf grows with all of the data.
Equal vectors are one entry with their smallest ids (no more than a result can show), so a vector that a third of the
rows share costs one comparison. The members and the queries of a large leaf are dealt in blocks over several tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors the tree is fitted on, at least, and those for each leaf beyond; queries it is calibrated on.
SAMPLE, A_LEAF, CALIBRATION = 20_000, 8, 200
#: Bytes of the centroids, which every worker holds. Beyond, leaves grow: that costs time and changes no comparison.
TREE_BYTES = 128 << 20
#: Members and queries of a leaf that one task compares.
BLOCK = 4096


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centre.T - (centre**2).sum(1) / 2).argmax(1)
        for c in range(k):
            if (near == c).any():
                centre[c] = x[near == c].mean(0)
    return centre


def build_tree(sample: np.ndarray, leaves: int, branch: int = 8, seed: int = 11) -> dict:
    """Nodes in arrays: centroids, the children of each (none for a leaf), leaf numbers (-1 inside)."""
    rng = np.random.default_rng(seed)
    centroids, children, leaf = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [[]], [0]
    queue, count = [(-len(sample), 0, np.arange(len(sample)))], 1
    while queue and count < leaves:  # the largest node is split next
        _, node, rows = heapq.heappop(queue)
        k = min(branch, leaves - count + 1, len(rows))
        if k < 2:
            continue
        x = sample[rows]
        centre = np.unique(_kmeans(x, k, rng), axis=0)
        near = (x @ centre.T - (centre**2).sum(1) / 2).argmax(1)
        if len(centre) < 2 or len(np.unique(near)) < 2:
            continue
        for c in range(len(centre)):
            child = len(centroids)
            centroids.append(centre[c])
            children.append([])
            leaf.append(0)
            children[node].append(child)
            heapq.heappush(queue, (-int((near == c).sum()), child, rows[near == c]))
        count += len(centre) - 1
    number = 0
    for node in range(len(centroids)):
        leaf[node] = -1 if children[node] else number
        number += not children[node]
    return {"centroids": np.array(centroids), "children": children, "leaf": leaf, "leaves": number}


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    """One more component, so that the largest inner product is the smallest distance."""
    rest = np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def assign(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each augmented vector: the nearest child, down from the root."""
    out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not tree["children"][node]:
            out[rows] = tree["leaf"][node]
            continue
        kids = np.array(tree["children"][node])
        c = tree["centroids"][kids]
        near = (x[rows] @ c.T - (c**2).sum(1) / 2).argmax(1)
        todo += [(int(kids[k]), rows[near == k]) for k in range(len(kids)) if (near == k).any()]
    return out


def visits(tree: dict, q: np.ndarray) -> Iterator[int]:
    """The leaves in the order in which a best-bin-first walk for an augmented query reaches them."""
    queue = [(0.0, 0)]
    halves = tree.setdefault("halves", (tree["centroids"] ** 2).sum(1) / 2)
    near = halves - tree["centroids"] @ q
    while queue:
        _, node = heapq.heappop(queue)
        kids = tree["children"][node]
        if not kids:
            yield tree["leaf"][node]
        for kid in kids:
            heapq.heappush(queue, (float(near[kid]), kid))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _compare(k: int):
    """The best k of one block of members for each query that visits it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, queries = left.column("gid").to_numpy(), right.column("qid").to_numpy()
        out_q, out_g, out_s = [], [], []
        if len(ids) and len(queries):
            members, wanted = _matrix(left.column("v")), _matrix(right.column("v"))
            for at in range(0, len(queries), 512):
                scores = wanted[at : at + 512] @ members.T
                for q, row in zip(queries[at : at + 512], scores, strict=True):
                    best = _top(row, ids, k)
                    out_q.append(np.full(len(best), q))
                    out_g.append(ids[best])
                    out_s.append(row[best])
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"qid": cat(out_q, pa.int64()), "gid": cat(out_g, pa.int64()), "score": cat(out_s, pa.float64())})

    return run


def _best(found: DataFrame, k: int, *order: str) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(F.desc("score"), *order)
    return found.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k)


def search(vectors: DataFrame, is_query, k: int = 20, target: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """(query_id, rank, id, score, recall) of the k nearest found for each row of vectors where is_query holds.

    Each query gets k rows, or all candidates if there are fewer; recall is what calibration measured, for all queries. Nearness is the inner product in double precision; a query's own id is no candidate; ties go to the smaller id.
    Rows whose vector is null, zero, of another length than most, or holds a null or non-finite component, and rows with
    a null id, take no part. Repeated ids count once if the vectors are equal. report, if given, gets the number of
    leaves, the calibrated visits and the measured recall. Other columns aren't read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    sound = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec_col, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(sound)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("asks"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("v") == (dims.d if dims else 0))
    # Equal vectors: the k + 1 smallest ids are all that a result can show.
    keep = rows.select("id", "v").distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    groups = materialize(keep.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("gid"), "v", "ids"), "ann-groups")
    asked = rows.filter("asks").select(F.col("id").alias("query_id"), "v").distinct()
    asked = materialize(asked.join(groups.select("gid", "v"), "v").select("query_id", F.col("gid").alias("qid"), "v"), "ann-queries")
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double, recall double").withColumnRenamed("id", id_col)
    total = groups.count()
    if not total or asked.isEmpty():
        return empty
    sums = groups.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m")).first()
    largest = float(np.sqrt(sums.m))
    leaves = int(max(1, min(np.ceil(np.sqrt(total) / 2), TREE_BYTES // (8 * (dims.d + 1)))))
    most = max(SAMPLE, A_LEAF * leaves)
    share = min(1.0, most / total)
    picked = groups.filter(F.pmod(F.xxhash64("gid", F.lit("tree")), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).select("v").limit(int(1.2 * most))
    sample = _matrix(picked.toArrow().column("v"))
    if not len(sample):
        sample = _matrix(groups.select("v").limit(1000).toArrow().column("v"))
    tree = build_tree(augmented(sample, largest), leaves)
    shared = spark.sparkContext.broadcast(tree)  # centroids of TREE_BYTES at most, and their parents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = assign(shared.value, augmented(_matrix(batch.column(1)), largest))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaves)], ["gid", "v", "leaf"])

    kind = groups.schema["v"].dataType.simpleString()
    members = materialize(groups.select("gid", "v").mapInArrow(place, f"gid long, v {kind}, leaf int"), "ann-members")

    # Calibration: queries of the smallest hashes against all members, in blocks.
    wanted = asked.select("qid", "v").distinct()
    probes = wanted.orderBy(F.xxhash64("qid", F.lit("probe")), "qid").limit(CALIBRATION).toArrow()
    probe_ids, probe_vecs = probes.column("qid").to_numpy(), _matrix(probes.column("v"))
    probe = spark.sparkContext.broadcast((probe_ids, probe_vecs))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = probe.value
        for batch in batches:
            if batch.num_rows:
                gids, leaves = np.asarray(batch.column(0)), np.asarray(batch.column(2))
                scores = vecs @ _matrix(batch.column(1)).T
                for q, row in zip(ids, scores, strict=True):
                    at = _top(row, gids, k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q)), pa.array(gids[at]), pa.array(row[at]), pa.array(leaves[at])], ["qid", "gid", "score", "leaf"])

    truth = _best(members.select("gid", "v", "leaf").mapInArrow(exact, "qid long, gid long, score double, leaf int"), k + 1, "gid").toPandas()
    order = {int(q): {leaf: i for i, leaf in enumerate(visits(tree, np.append(v, 0.0)))} for q, v in zip(probe_ids, probe_vecs, strict=True)}
    needed = np.sort(np.array([order[q][leaf] + 1 for q, leaf in zip(truth.qid, truth.leaf, strict=True)]))
    widen = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])
    recall = float((needed <= widen).mean())
    if report is not None:
        report |= {"leaves": tree["leaves"], "visits": widen, "recall": recall, "vectors": total}

    # Search: each query goes to its leaves, as many as are calibrated and on until they hold a whole result.
    sizes = {r.leaf: r.n for r in members.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    held = spark.sparkContext.broadcast(sizes)
    ids_in = {r.leaf: r.n for r in members.join(groups.select("gid", F.size("ids").alias("n")), "gid").groupBy("leaf").agg(F.sum("n").alias("n")).collect()} if any(n <= k for n in sizes.values()) else sizes
    enough = spark.sparkContext.broadcast(ids_in)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, column = np.asarray(batch.column(0))[at : at + 256], batch.column(1)[at : at + 256]
                rows, chosen = [], []
                for i, q in enumerate(_matrix(column)):
                    candidates = 0
                    for n, leaf in enumerate(visits(shared.value, np.append(q, 0.0))):
                        if n >= widen and candidates > k:
                            break
                        candidates += enough.value.get(leaf, 0)
                        if held.value.get(leaf):
                            rows.append(i)
                            chosen.append(leaf)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), column.take(pa.array(rows, pa.int32())), pa.array(chosen, pa.int32())], ["qid", "v", "leaf"])

    routed = materialize(wanted.mapInArrow(route, f"qid long, v {kind}, leaf int"), "ann-routed")
    asks = {r.leaf: r.n for r in routed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    # A leaf of many members or queries is a grid of blocks; each cell is compared by itself.
    large = [(leaf, -(-n // BLOCK), -(-asks.get(leaf, 1) // BLOCK)) for leaf, n in sizes.items() if n > BLOCK or asks.get(leaf, 1) > BLOCK]
    grid = spark.createDataFrame(large, "leaf int, m int, q int")
    blocks = lambda df, own, other, name, id_: df.join(F.broadcast(grid), "leaf", "left").withColumn(name[0], F.coalesce(F.pmod(F.xxhash64(id_), F.col(own)).cast("int"), F.lit(0))).withColumn(name[1], F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other) - 1, F.lit(0))))).drop("m", "q")
    left = blocks(members, "m", "q", ("i", "j"), "gid") if large else members.withColumns({"i": F.lit(0), "j": F.lit(0)})
    right = blocks(routed, "q", "m", ("j", "i"), "qid") if large else routed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    pairs = left.groupBy("leaf", "i", "j").cogroup(right.groupBy("leaf", "i", "j"))
    found = pairs.applyInArrow(_compare(k + 1), "qid long, gid long, score double")
    best = materialize(_best(found, k + 1, "gid").select("qid", "gid", "score"), "ann-found")
    # Groups to ids, k + 1 for each distinct query vector; then the queries, without themselves.
    ids = _best(best.join(groups.select("gid", "ids"), "gid").select("qid", "score", F.explode("ids").alias("id")), k + 1, "id").select("qid", "id", "score")
    told = asked.select("query_id", "qid").join(ids, "qid").filter("query_id <> id")
    ranked = told.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score", F.lit(recall).alias("recall"))
