"""Near copies by exact Jaccard similarity of word shingles: a prefix-filter join, then verification on the texts.

All shingles of all texts have one order. If two texts of x and y shingles have a similarity of num/den or more, they
share at least num/den of either, so the first shingle that they share stands among the first x - ceil(x num/den) + 1
of the one and likewise of the other. So each text is dealt by its first shingles only, and no pair is missed, wherever
and in whatever lengths the texts differ. Each candidate pair is then compared by bits of its shingles' hashes, which
tell how much the two can share at most, and what is left by the whole sets of shingles.

The order is by hash, but with shingles of many texts last, by their number (told on a sample of texts; any order gives
the same result), so that a passage that many texts share deals few of them, and what a text has for itself counts
against it before. Where more than SMALL texts meet at a shingle, they are first
compared with one of them, the leader, which needs no more comparing then; what verified links have joined is not
compared again. After ROUNDS leaders, all pairs that are still apart are compared. So links are spanned as they are
found, and none is left out for one that isn't verified.

Candidates that another method found may be looked at first; what of them is verified is joined from the start, and all
else is found as above.

A shingle of more than BLOCK texts is no task's group: its rows are passed on as they come, its leader is found by
aggregation and joined to them, and its last pairs are dealt in cells of two blocks each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

#: A side of at most so many rows (a few numbers each, counted first) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: At a shingle of at most so many texts all pairs are compared at once.
SMALL = 16
#: At a larger one, so many leaders before all pairs.
ROUNDS = 4
#: A shingle of more texts than this is compared in blocks, dealt over many tasks.
BLOCK = 1 << 16
#: The leaders end sooner where all pairs of what is left are no more than this.
FEW_PAIRS = 2_000_000
#: So many candidate pairs are compared by a task; that many in all need no sketches first.
TASK_PAIRS = 10_000
#: Texts looked at for the shingles of many texts.
SAMPLE = 20_000
#: Shingles of at least so many sampled texts come last, at most so many of them.
OFTEN, MOST_OFTEN = 10, 300_000
#: Rows or pairs put out at a time.
CHUNK = 1 << 17


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased in A-Z, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, n: int) -> set[bytes]:
    """The distinct n-word shingles; a shorter text is one shingle, an empty one none."""
    words = words_of(text)
    k = min(n, len(words))
    return set(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def hashes(text: str | None, n: int) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    import xxhash

    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, n), repeat(42)), np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, key, t) of (id, t); texts of the same words have one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys = [xxhash.xxh3_128_digest(b" ".join(words_of(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], ["id", "key", "t"])

    return docs.mapInArrow(run, "id long, key binary, t string")


def _often(texts: DataFrame, n: int, count: int) -> np.ndarray:
    """Rows (hash, as it sorts; rank by number of texts) of the shingles of many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(hashes(text.as_py(), n).view(np.int64))], ["h"])

    every = -(-count // SAMPLE)
    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0) if every > 1 else texts
    seen = some.select("node", "t").mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= OFTEN)
    found = seen.orderBy(F.desc("count"), "h").limit(MOST_OFTEN).select("h").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(found)
    return np.stack([found[order], (len(found) - order).astype(np.uint64)])


#: A place is a text's share of often met shingles (to 127), the place of the shingle, and the number of shingles.
_BITS = 28


def _first_shingles(texts: DataFrame, n: int, num: int, den: int, often) -> DataFrame:
    """(h, node, place, root) of the first shingles of each text (node, t, root); often: a broadcast of the hashes that come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ranks = np.frombuffer(often.value, np.uint64).reshape(2, -1)

        def made(parts: list) -> pa.RecordBatch:
            h, node, place, root = (np.concatenate([p[k] for p in parts]) for k in range(4))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node), pa.array(place), pa.array(root)], ["h", "node", "place", "root"])

        for batch in batches:
            parts, held = [], 0
            for node, text, root in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                hs = hashes(text.as_py(), n)
                if not len(hs):
                    continue
                share, size = 0, len(hs)
                if len(last):
                    found = np.minimum(np.searchsorted(last, hs), len(last) - 1)
                    met = last[found] == hs
                    share = int(met.sum()) * 127 // size
                    hs = np.concatenate([hs[~met], hs[met][np.argsort(ranks[found[met]])]])
                first = hs[: size - -(-num * size // den) + 1]
                place = (np.arange(len(first), dtype=np.int64) << _BITS) + ((share << 2 * _BITS) + size)
                parts.append((first, np.full(len(first), node, np.int64), place, np.full(len(first), root, np.int64)))
                held += len(first)
                if held >= CHUNK:
                    yield made(parts)
                    parts, held = [], 0
            if parts:
                yield made(parts)

    return texts.select("node", "t", "root").mapInArrow(run, "h long, node long, place long, root long")


MET = "a long, b long, h long, place long"


def _meet(num: int, den: int, last: bool, block: int):
    """Pairs (a, b) of the rows (h, node, place, root) of one h, which come sorted, that can be similar enough.

    Where many meet, those of the leader, and the others again as (a, null, h, place); unless it is the last round. Where
    more than block meet, all of them again, passed on as they come; the last round has no such shingles.
    """
    mask = (1 << _BITS) - 1

    def can_be(rows: np.ndarray, x, y) -> np.ndarray:
        at, size = rows[:, 2] >> _BITS & mask, rows[:, 2] & mask
        left = np.minimum(size[x] - at[x], size[y] - at[y])  # shared at most, if this is the first they share
        alike = np.minimum(size[x], size[y]) * den >= np.maximum(size[x], size[y]) * num
        ok = alike & (left * (num + den) >= num * (size[x] + size[y])) & (rows[x, 3] != rows[y, 3])
        a, b = np.broadcast_arrays(rows[x, 1], rows[y, 1])
        return np.stack([np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])], axis=1)

    def met_by_size(rows: np.ndarray) -> np.ndarray:
        """Which rows of one shingle have another there of a size that can_be allows them."""
        at, size = rows[:, 2] >> _BITS & mask, rows[:, 2] & mask
        least, most = -(-size * num // den), np.minimum(size * den // num, (size - at) * (num + den) // num - size)
        order = np.sort(size)
        return np.searchsorted(order, most, "right") - np.searchsorted(order, least) > (size <= most)

    def pairs(rows: np.ndarray) -> Iterator[np.ndarray]:
        h, i, k, found, held = rows[:, 0], np.arange(len(rows)), 0, [], 0
        while True:
            k += 1
            i = i[: np.searchsorted(i, len(rows) - k)]
            i = i[h[i + k] == h[i]]
            if not len(i):
                break
            found.append(can_be(rows, i, i + k))
            held += len(found[-1])
            if held >= CHUNK:
                yield np.concatenate(found)
                found, held = [], 0
        if held:
            yield np.concatenate(found)

    def settle(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Whole shingles: pairs, and rows for another round."""
        starts = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        counts = np.diff(np.concatenate((starts, [len(rows)])))
        small = np.repeat(counts <= SMALL, counts)
        for p in pairs(rows[small]):
            yield p, None
        for i, m in zip(starts[counts > SMALL].tolist(), counts[counts > SMALL].tolist(), strict=True):
            some = rows[i : i + m]
            roots, sizes = np.unique(some[:, 3], return_counts=True)
            if len(roots) == 1:
                continue
            if m - sizes.max() <= SMALL:  # nearly all are joined
                inside = some[:, 3] == roots[sizes.argmax()]
                for x in np.flatnonzero(~inside).tolist():
                    yield can_be(some, np.array([x]), np.flatnonzero(inside)), None
                some = some[~inside]
            elif not last:
                leader = np.lexsort((some[:, 1], -(some[:, 2] >> 2 * _BITS)))[0]
                others = np.delete(np.arange(m), leader)
                yield can_be(some, np.array([leader]), others), some[others][met_by_size(some[others])]
                continue
            for p in pairs(some):
                yield p, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            found, again, held = [], [], 0

            def made() -> Iterator[pa.RecordBatch]:
                if found:
                    p = np.unique(np.concatenate(found), axis=0)
                    none = pa.nulls(len(p), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), none, none], ["a", "b", "h", "place"])
                if again:
                    r = np.concatenate(again)
                    yield pa.RecordBatch.from_arrays([pa.array(r[:, 1]), pa.nulls(len(r), pa.int64()), pa.array(r[:, 0]), pa.array(r[:, 2])], ["a", "b", "h", "place"])

            for p, rest in settle(rows):
                found.append(p)
                held += len(p)
                if rest is not None:
                    again.append(rest)
                    held += len(rest)
                if held >= CHUNK:
                    yield from made()
                    found, again, held = [], [], 0
            yield from made()

        def passed(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.nulls(len(rows), pa.int64()), pa.array(rows[:, 0]), pa.array(rows[:, 2])], ["a", "b", "h", "place"])

        held: list[np.ndarray] = []
        over = None  # the shingle that is passed on
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(k)) for k in range(4)], axis=1)
            if over is not None:
                end = int(np.searchsorted(rows[:, 0], over, "right"))
                if end:
                    yield passed(rows[:end])
                rows = rows[end:]
            if not len(rows):
                continue
            over = None
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if cut or held and held[-1][-1, 0] != rows[-1, 0]:
                yield from out(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
            if not last and sum(map(len, held)) > block:  # all of one shingle
                over = held[-1][-1, 0]
                yield from map(passed, held)
                held = []
        if held:
            yield from out(np.concatenate(held))

    return run


def _can_be(num: int, den: int):
    """The condition that rows x and y (node, place, root) of one shingle are apart and can be similar enough, as in _meet."""
    part = lambda side, shift: F.shiftright(F.col(f"{side}.place"), shift).bitwiseAND((1 << _BITS) - 1)
    x, y = part("x", 0), part("y", 0)
    left = F.least(x - part("x", _BITS), y - part("y", _BITS))
    alike = F.least(x, y) * den >= F.greatest(x, y) * num
    return alike & (left * (num + den) >= (x + y) * num) & (F.col("x.root") != F.col("y.root"))


def _ends() -> list:
    return [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]


def _led(rows: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of the rows of shingles of very many texts, the pairs (a, b) with their leaders, and the others as (h, node, place).

    A leader is an aggregate of its shingle; so few shingles have that many rows that they are broadcast if counted so.
    """
    share = F.shiftright("place", 2 * _BITS)
    leaders = rows.groupBy("h").agg(F.min(F.struct((-share).alias("share"), "node", "place", "root")).alias("l"))
    leaders = materialize(leaders.select("h", "l.node", "l.place", "l.root"), "similar-leaders")
    leaders = F.broadcast(leaders) if leaders.count() <= BROADCAST_ROWS else leaders
    both = rows.alias("x").join(leaders.alias("y"), F.col("x.h") == F.col("y.h")).filter(F.col("x.node") != F.col("y.node"))
    return both.filter(_can_be(num, den)).select(*_ends()), both.select("x.h", "x.node", "x.place")


def _all_apart(rows: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(a, b): all pairs that are apart and can be similar enough, of shingles of very many texts.

    What is joined with most of its shingle needs no comparing with itself; so only the others, in blocks, meet all of
    it, in blocks: a cell holds a block of either, and each pair meets in one cell.
    """
    roots = rows.groupBy("h", "root").agg(F.count("*").alias("n"))
    most = roots.groupBy("h").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n")).select("h", F.col("m.root").alias("most"), "n", (F.col("n") - F.col("m.n")).alias("out"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    cells = most.filter("out > 0").select("h", "most", blocks("out").alias("ni"), blocks("n").alias("nj"))
    cells = materialize(cells, "similar-cells")
    placed = rows.join(F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells, "h")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = placed.filter("root <> most").select("h", "node", "place", "root", at("ni").alias("i"), every("nj").alias("j"))
    y = placed.select("h", "node", "place", "root", "most", every("ni").alias("i"), at("nj").alias("j"))
    cell = (F.col("x.h") == F.col("y.h")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("y.root") == F.col("y.most")) | (F.col("x.node") < F.col("y.node"))
    return x.alias("x").hint("merge").join(y.alias("y"), cell & once & _can_be(num, den)).select(*_ends())


def _sketch(hs: np.ndarray) -> bytes:
    """A bit for each hash among four to eight times as many bits, a power of two."""
    bits = np.zeros(max(256, 1 << (4 * len(hs)).bit_length()), np.uint8)
    bits[(hs & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _sketches(texts: DataFrame, n: int) -> DataFrame:
    """(node, size: number of shingles, bits: their sketch) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [hashes(t.as_py(), n) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in every], pa.int64()), pa.array([_sketch(h) for h in every], pa.binary())], ["node", "size", "bits"])

    return texts.select("node", "t").mapInArrow(run, "node long, size long, bits binary")


def _can_share(left: tuple[int, np.ndarray], right: tuple[int, np.ndarray]) -> int:
    """The most shingles that two texts can share: each bit of one alone is a shingle that the other lacks."""
    (x, a), (y, b) = left, right
    m = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(v.reshape(-1, m), axis=0) for v in (a, b))
    return min(x - int(np.bitwise_count(a & ~b).sum()), y - int(np.bitwise_count(b & ~a).sum()))


def _pairs_of(batches: Iterator[pa.RecordBatch], value, keep) -> Iterator[pa.RecordBatch]:
    """The pairs of rows (a, b, side, ...), which come sorted, that keep(left, right) holds for; value: what a row is compared by."""
    a, left, done = None, None, None
    for batch in batches:
        found = []
        for i, (x, y, side) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
            if side == 0:
                if x != a:
                    a, left = x, value(batch, i)
            elif (x, y) != done:
                done = x, y
                if keep(left, value(batch, i)):
                    found.append(done)
        e = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose shingles have a Jaccard similarity of num/den or more.

    First by sketches, a few bytes a shingle, which only drop pairs that can't have it; then by the texts of the others.
    """
    shuffles = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def enough(both: int, x: int, y: int) -> bool:
        return both * den >= (x + y - both) * num

    def sides(some: DataFrame) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.lit(1).alias("side"))))
        out = some.select("a", "b", ends.alias("end")).select("a", "b", "end.side", "end.node")
        return F.broadcast(out) if 2 * some.count() <= BROADCAST_ROWS else out

    def dealt(table: DataFrame, some: DataFrame, rows: int, *columns: str) -> DataFrame:
        both = table.join(sides(some), "node").select("a", "b", "side", *columns)
        return both.repartition(max(1, min(shuffles, -(-rows // TASK_PAIRS))), "a", "b").sortWithinPartitions("a", "b", "side")

    def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = lambda batch, i: (batch.column(3)[i].as_py(), np.frombuffer(batch.column(4)[i].as_py(), np.uint8))
        return _pairs_of(batches, value, lambda x, y: enough(_can_share(x, y), x[0], y[0]))

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = lambda batch, i: shingles(batch.column(3)[i].as_py(), n)
        return _pairs_of(batches, value, lambda x, y: enough(len(x & y), len(x), len(y)))

    rows = pairs.count()
    if rows > TASK_PAIRS:
        nodes = sides(pairs).select("node").distinct()
        nodes = F.broadcast(nodes) if 2 * rows <= BROADCAST_ROWS else nodes
        sketches = materialize(_sketches(texts.join(nodes, "node", "left_semi"), n), "similar-sketches")
        pairs = materialize(dealt(sketches, pairs, rows, "size", "bits").mapInArrow(by_sketch, "a long, b long"), "similar-likely")
        rows = pairs.count()
    return dealt(texts, pairs, rows, "t").mapInArrow(by_text, "a long, b long")


def _links(texts: DataFrame, count: int, n: int, num: int, den: int, block: int, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b): verified links between the texts (node, t) that span all of them; first(texts): pairs (a, b) to look at before any others."""
    spark = texts.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    often = spark.sparkContext.broadcast(_often(texts, n, count).tobytes())
    rows = texts.select("node", "t", F.col("node").alias("root"))
    edges, hot = None, None  # hot: (h, count) of the shingles of more than block rows
    if first is not None:
        edges = materialize(_verified(materialize(first(texts), "similar-first"), texts, n, num, den), "similar-links")
        # Joined here, so that no shingle has its rows compared where all are of one root.
        roots = connected_components(edges)
        roots = F.broadcast(roots) if roots.count() <= BROADCAST_ROWS else roots
        rows = texts.join(roots, "node", "left").select("node", "t", F.coalesce("root", "node").alias("root"))
    rows = _first_shingles(rows, n, num, den, often)
    last, parts = ROUNDS, shuffles
    for turn in range(ROUNDS + 1):
        cold = rows if hot is None else rows.join(hot, "h", "left_anti")
        met = cold.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_meet(num, den, turn >= last, block), MET)
        met = materialize(met, "similar-met")
        found, rest = met.filter("b is not null").select("a", "b"), met.filter("b is null").select("h", F.col("a").alias("node"), "place")
        if hot is not None and turn >= last:
            found = found.union(_all_apart(rows.join(hot, "h", "left_semi"), num, den, block))
        elif hot is not None:
            led, others = _led(rows.join(hot, "h", "left_semi"), num, den)
            found, rest = found.union(led), rest.union(others)
        pairs = materialize(found.distinct(), "similar-pairs")
        more = materialize(_verified(pairs, texts, n, num, den), "similar-links")
        edges = more if edges is None else edges.union(more)
        if turn >= last:
            break
        counts = rest.groupBy("h").count()
        left = counts.agg(F.sum("count").alias("rows"), F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs"), F.max("count").alias("most")).first()
        if not left.rows:
            break
        last = turn + 1 if left.pairs <= FEW_PAIRS else last
        parts = max(1, min(shuffles, -(-left.rows // CHUNK)))
        hot = materialize(counts.filter(F.col("count") > block), "similar-hot") if left.most > block else None
        roots = connected_components(edges)
        rows = rest.join(roots, "node", "left").select("h", "node", "place", F.coalesce("root", "node").alias("root"))
        if hot is not None:
            rows = materialize(rows, "similar-rows")
    return edges


def grouped(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, block: int = BLOCK, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, raw: hash of the text as it is, root: of its group, group_id) of each row with an id.

    Repeated rows stay, each with its group; an empty table gives no rows. block: texts of a shingle that one task may
    hold; first: candidate pairs (a, b) of the distinct texts (node, t), looked at before others. Neither changes the result.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity lies in (0, 1]")
    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    read = _keyed(named)
    keyed = materialize(read.select("id", "key", F.xxhash64("t").alias("raw")), "similar-keyed")
    least = keyed.groupBy("key").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    least = materialize(least, "similar-distinct")
    count = least.count()
    small = F.broadcast(least) if count <= BROADCAST_ROWS else least
    # Written, so that each later stage runs one Python function: two in a stage would be two workers for each core.
    texts = read.join(small, "key").filter("id = least").select("node", "t")
    # An id with several rows gives one text of a key: rows of one key have the same words.
    texts = materialize(texts.dropDuplicates(["node"]) if _repeats(keyed, "id", "key") else texts, "similar-texts")
    roots = materialize(connected_components(_links(texts, count, n, num, den, block, first)), "similar-roots")
    named = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("group_id"))
    groups = materialize(named.join(smallest, "root").select("key", "root", "group_id"), "similar-named")
    return keyed.join(groups, "key").select("id", "raw", "root", "group_id")


def _repeats(df: DataFrame, *columns: str) -> bool:
    return not df.groupBy(*columns).count().filter("count > 1").isEmpty()


def similar_groups(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, group_id) of each row with an id; group_id is the smallest id of the group.

    A group is what is reachable over pairs whose distinct n-word shingles have a Jaccard similarity of num/den or more.
    Texts of the same words are one candidate. Rows with a null id take no part; null texts count as empty, and
    documents without words are copies of each other. An empty table gives no rows. block as in grouped.
    """
    return grouped(docs, n, num, den, id_col, text_col, block).select(F.col("id").alias(id_col), "group_id")
