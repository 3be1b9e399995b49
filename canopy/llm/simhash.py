"""SimHash near-duplicates by anchor-point covering.

A pair at Hamming distance 3 or less differs in at most one bit in one of two 31-bit halves (bits 31 and 63 lie in
neither). On each half the anchors are the code words of the perfect Hamming(31,26) code, whose covering radius is 1:
a fingerprint belongs to its nearest anchor and is replicated to every anchor within radius + 1 = 2, at most 16 of
them. If two fingerprints differ in at most one bit of the half, the anchor of one is within 2 of the other, so each
link is found at an anchor. Each anchor keeps about 1/2^26 of the fingerprints.

Equal fingerprints count as one before anything is replicated, so a group of exact copies is one row. At an anchor,
a spanning forest of the links is emitted, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components
from .similar import grouped

BITS = 31
#: An anchor with more rows than this is compared in blocks, dealt over many tasks.
BLOCK = 8192
#: A side of at most so many ids, counted first, is broadcast.
BROADCAST_ROWS = 500_000
#: Shingles hashed at a time, so that memory doesn't grow with a text.
CHUNK = 1 << 16


def _stream(hashes: np.ndarray, part: int) -> np.ndarray:
    """The hashes for one part of a longer fingerprint; part 0 has them as they are."""
    if not part:
        return hashes
    x = hashes * np.uint64((2 * part + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def simhash(text: str | None, n: int = 3, parts: int = 1) -> list[int]:
    """The fingerprint of a text as unsigned numbers of 64 bits, one a part; zeros if it has no words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * parts
    n = min(n, len(words))
    count = len(words) - n + 1
    ones = np.zeros((parts, 64), np.int64)
    for at in range(0, count, CHUNK):
        some = words[at : at + CHUNK + n - 1]
        grams = map(b" ".join, zip(*(some[k:] for k in range(n)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(some) - n + 1)
        for part in range(parts):
            bits = np.unpackbits(_stream(hashes, part).view(np.uint8), bitorder="little")
            ones[part] += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > count, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def fingerprints(docs: DataFrame, n: int = 3, parts: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fps: array of signed longs) of each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t.as_py(), n, parts) for t in batch.column(1)], np.uint64).reshape(-1).view(np.int64)
            offsets = np.arange(0, len(values) + 1, parts, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()))], [id_col, "fps"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fps array<bigint>")


def _masks() -> list[list[int]]:
    """For each syndrome s: what, xored to a word, gives the code words within 2; the nearest one first."""
    out = [[0]]
    for s in range(1, BITS + 1):
        out.append([1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, BITS + 1) if i < (i ^ s)])
    return out


def _syndrome(word):
    """The exclusive or of the positions (from 1) of a word's set bits."""
    parts = []
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, BITS + 1) if i >> j & 1)
        parts.append(F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(mask))) % 2, j))
    return parts[0] + parts[1] + parts[2] + parts[3] + parts[4]


def replicate(fps: DataFrame) -> DataFrame:
    """(half, anchor, fp, own, node) for every anchor within 2 of the halves of each (node, part, fp); own: the nearest."""
    table = F.array(*[F.array(*[F.lit(m) for m in row]) for row in _masks()])
    low = F.col("fp").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    high = F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    halves = fps.select("node", "fp", "part", F.posexplode(F.array(low, high)).alias("half", "word"))
    halves = halves.withColumn("half", F.col("half") + 2 * F.col("part"))
    spread = halves.select("node", "fp", "half", "word", F.posexplode(F.element_at(table, _syndrome(F.col("word")) + 1)).alias("k", "mask"))
    return spread.select("half", F.col("word").bitwiseXOR(F.col("mask")).alias("anchor"), "fp", (F.col("k") == 0).cast("int").alias("own"), "node")


def _forest(own: np.ndarray, fps: np.ndarray, nodes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the own rows and all rows of an anchor."""
    labels = {x: x for x in nodes.tolist()}

    def root(x: int) -> int:
        while labels[x] != x:
            labels[x] = labels[labels[x]]
            x = labels[x]
        return x

    edges, values = [], fps.view(np.uint64)
    for i in np.flatnonzero(own).tolist():
        x = int(nodes[i])
        for y in nodes[np.bitwise_count(values ^ values[i]) <= limit].tolist():
            a, b = root(x), root(y)
            if a != b:
                labels[b] = a
                edges.append((x, y))
    return edges


#: Rows of _compare: half, anchor, fp, own, node and the cell (i, j); what tells one comparison from the next.
_KEY = [0, 1, 5, 6]
LINKS = "a long, b long, half int, anchor int, fp long, own int"


def _compare(limit: int, block: int | None):
    """Compare the rows of each anchor, which come sorted; anchors over block rows are handed on as they are."""

    def handed(edges: list, rest: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "half", "anchor", "fp", "own"]
        if edges:
            e, none = np.array(edges, np.int64), pa.nulls(len(edges))
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int32())], names)
        for r in rest:
            if len(r):
                small = [pa.array(r[:, k].astype(np.int32)) for k in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(r[:, 4]), pa.nulls(len(r)).cast(pa.int64()), *small[:2], pa.array(r[:, 2]), small[2]], names)

    def settle(rows: np.ndarray) -> tuple[list, list]:
        """Whole anchors: those with a partner are compared."""
        cuts = np.flatnonzero((rows[1:, _KEY] != rows[:-1, _KEY]).any(1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))
        pairs = (np.add.reduceat(rows[:, 3], starts) > 0) & (ends - starts > 1)
        edges, rest = [], []
        for i, j in zip(starts[pairs].tolist(), ends[pairs].tolist(), strict=True):
            part = rows[i:j]
            if block and j - i > block:
                rest.append(part)
            else:
                edges += _forest(part[:, 3] == 1, np.ascontiguousarray(part[:, 2]), part[:, 4], limit)
        return edges, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_rows, over = 0, None
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(k).cast(pa.int64())) for k in range(7)], axis=1)
            if not len(rows):
                continue
            key = tuple(rows[-1, _KEY].tolist())
            if over is not None:  # the rest of an anchor that is handed on
                same = (rows[:, _KEY] == np.array(over)).all(1)
                yield from handed([], [rows[same]])
                rows = rows[~same]
                if not len(rows):
                    continue
                over = None
            last = (rows[:, _KEY] == np.array(key)).all(1)  # this anchor may go on in the next batch
            head, tail = rows[~last], rows[last]
            if held and (len(head) or tuple(held[-1][-1, _KEY].tolist()) != key):
                yield from handed(*settle(np.concatenate([*held, head])))
                held, held_rows = [], 0
            elif len(head):
                yield from handed(*settle(head))
            held.append(tail)
            held_rows += len(tail)
            if block and held_rows > block:  # all of one anchor
                yield from handed([], held)
                held, held_rows, over = [], 0, key
        if held:
            yield from handed(*settle(np.concatenate(held)))

    return run


def links(fps: DataFrame, limit: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links between nodes of (node, part, fp) that span what is within limit bits in a part.

    All links of up to 3 bits are spanned; beyond that, those whose halves happen to share an anchor.
    """
    keys = ["half", "anchor", "i", "j"]
    spread = replicate(fps).select("half", "anchor", "fp", "own", "node", F.lit(0).alias("i"), F.lit(0).alias("j"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = spread.repartition(n, "half", "anchor").sortWithinPartitions(*keys).mapInArrow(_compare(limit, block), LINKS)
    found = materialize(found, "simhash-links")
    edges, rest = found.filter("b is not null").select("a", "b"), found.filter("b is null")
    if rest.isEmpty():
        return edges
    # Anchors beyond a block: own rows in blocks i, all rows in blocks j, each cell of the grid by itself.
    sizes = rest.groupBy("half", "anchor").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    grid = rest.join(sizes, ["half", "anchor"]).withColumn("at", F.pmod(F.xxhash64("a"), F.col("n")).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    every = grid.select("half", "anchor", "fp", F.lit(0).alias("own"), F.col("a").alias("node"), all_blocks.alias("i"), F.col("at").alias("j"))
    own = grid.filter("own = 1").select("half", "anchor", "fp", "own", F.col("a").alias("node"), F.col("at").alias("i"), all_blocks.alias("j"))
    cells = every.union(own).repartition(n, *keys).sortWithinPartitions(*keys)
    more = cells.mapInArrow(_compare(limit, None), LINKS).select("a", "b")
    return edges.union(materialize(more, "simhash-cells"))


def near_duplicates(docs: DataFrame, n: int = 3, limit: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row of docs.

    Words are lower-cased in A-Z; a fingerprint bit is 1 if it is set in over half the shingles. component_id is the
    smallest id that is reachable over links of at most limit (0 to 3) bits. A null text counts as empty, an empty text
    has fingerprint zero and links like any other; a row with a null id keeps its place and never names a component;
    repeated rows stay. Other columns of docs are not read; an empty table gives no rows.
    """
    if not 0 <= limit <= 3:
        raise ValueError("the anchors cover distances up to 3")
    table = materialize(fingerprints(docs, n, 1, id_col, text_col).select(id_col, F.element_at("fps", 1).alias("fp")), "simhash-fp")
    least = materialize(table.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    roots = connected_components(links(least.select(F.col("fp").alias("node"), F.lit(0).alias("part"), "fp"), limit)).withColumnRenamed("node", "fp")
    named = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(smallest, "root").select("fp", "component_id"), "simhash-named")
    return table.join(named, "fp").select(id_col, "fp", "component_id")


def near_pairs(texts: DataFrame, n: int = 3, limit: int = 3) -> DataFrame:
    """(a, b), a < b: pairs of the texts (node, t) that span what is linked by fingerprints of at most limit (0 to 3) differing bits."""
    table = materialize(fingerprints(texts, n, 1, "node", "t").select("node", F.element_at("fps", 1).alias("fp")), "simhash-fp")
    least = materialize(table.groupBy("fp").agg(F.min("node").alias("least")), "simhash-distinct")
    same = table.join(least, "fp").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    named = lambda fp, to: least.select(F.col("fp").alias(fp), F.col("least").alias(to))
    apart = links(least.select(F.col("fp").alias("node"), F.lit(0).alias("part"), "fp"), limit).withColumnsRenamed({"a": "x", "b": "y"})
    apart = apart.join(named("x", "a"), "x").join(named("y", "b"), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.union(apart).distinct()


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, that of the smallest id; all columns as they are.

    Texts within 3 bits of each other's SimHash are looked at first and joined where their n-word shingles have a Jaccard
    similarity of num/den or more; no distance of fingerprints bounds that, so similar.py then finds the other pairs.

    Null and empty texts are copies of each other; rows with a null id stay. Rows of one id are documents of their own:
    each belongs to the group of its text. Where several of a group have its smallest id, the one of the smallest hash of
    its text stays, and of rows equal in id and text any one. An empty table gives no rows.
    """
    groups = materialize(grouped(docs, n, num, den, id_col, text_col, first=near_pairs), "similar-groups")
    raw = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    repeated = materialize(groups.groupBy("id", "raw").agg(F.count("*").alias("rows")).groupBy("id").agg(F.sum("rows").alias("rows")).filter("rows > 1").select("id"), "similar-repeated")
    if repeated.isEmpty():
        out = groups.filter("id <> group_id").select(F.col("id").alias(id_col))
        return docs.join(F.broadcast(out) if out.count() <= BROADCAST_ROWS else out, id_col, "left_anti").select(*docs.columns)
    first = groups.filter("id = group_id").groupBy("root").agg(F.min("raw").alias("first"))
    out = groups.join(first, "root").filter("id <> group_id or raw <> first").select(F.col("id").alias(id_col), F.col("raw").alias("_similar_raw")).distinct()
    out = F.broadcast(out) if out.count() <= BROADCAST_ROWS else out
    kept = docs.withColumn("_similar_raw", raw).join(out, [id_col, "_similar_raw"], "left_anti")
    again = repeated.select(F.col("id").alias(id_col))
    once = kept.join(again, id_col, "left_semi").dropDuplicates([id_col, "_similar_raw"])
    return kept.join(again, id_col, "left_anti").unionByName(once).select(*docs.columns)
