"""Ranked lexical search by windowed bucket scoring.

Documents are dealt by ranges of doc_id and sorted; a task takes them in windows of a fixed number of documents. A
window's postings are turned over, term by term; a query's postings add their scores to an array with one bucket a
document, small enough for a core's cache, and mark their buckets in a bitset; the marked buckets are harvested into
the query's heap, and only they are cleared. What leaves a task is its best documents of each query.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, byte_classes, byte_words, materialize

TERMS = byte_classes("abcdefghijklmnopqrstuvwxyz0123456789")
#: Documents of a window, a multiple of 64, and postings at which one ends earlier.
WINDOW, POSTINGS = 16_384, 4_000_000
#: Terms of the items that are searched for together; more items are searched for in blocks.
BLOCK_TERMS = 500_000


def _counted(raw: bytes) -> Counter:
    out: Counter = Counter()
    for words in byte_words(raw, TERMS):
        out.update(words)
    return out


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(id, item, terms: array<binary>) of the distinct items that have terms; id is theirs, item a number."""
    rows = items.select(F.col(item_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [list(_counted(raw.as_py())) for raw in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["id", "terms"])

    found = rows.mapInArrow(run, f"id {kind}, terms array<binary>").filter(F.size("terms") > 0)
    return materialize(found.withColumn("item", F.monotonically_increasing_id()), "lexical-items")


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, times) of each document that has terms: how many it has, and which numbers of the vocabulary how often."""
    share = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})  # BLOCK_TERMS bounds it
    plain = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = plain.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = share.value
        for batch in batches:
            sizes, ends, terms, times = [], [0], [], []
            for raw in batch.column(1).cast(pa.binary()):
                counts = _counted(raw.as_py())
                sizes.append(counts.total())
                known = counts.keys() & numbers.keys()
                terms += [numbers[t] for t in known]
                times += [counts[t] for t in known]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc", "n", "terms", "times"])

    return plain.mapInArrow(run, f"doc {kind}, n long, terms array<int>, times array<int>").filter("n > 0")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in windows of WINDOW documents, or fewer where they have very many postings."""
    held: list[pa.RecordBatch] = []
    rows = load = 0
    for batch in batches:
        ends = np.cumsum(batch.column(2).value_lengths().to_numpy())
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            fit = int(np.searchsorted(ends, before + POSTINGS - load, side="right")) - at
            take = min(batch.num_rows - at, WINDOW - rows, max(fit, 0 if rows else 1))
            held.append(batch.slice(at, take))
            rows, load, at = rows + take, load + int(ends[at + take - 1] - before) if take else load, at + take
            if at < batch.num_rows or rows == WINDOW:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, load = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _best(placed: DataFrame, queries: list[tuple], n_terms: int, total: int, words: int, k: int) -> DataFrame:
    """(item, doc, score): the k best of each query among each task's documents; queries are (item, term numbers, weights)."""
    share = placed.sparkSession.sparkContext.broadcast([(i, np.array(t, np.int32), np.array(w, np.int64)) for i, t, w in queries])
    kind = placed.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        score, marked = np.zeros(WINDOW, np.int64), np.zeros(WINDOW // 64, np.uint64)
        met = 0
        arrow = pa.int64()
        for window in _windows(batches):
            ids, n = window.column(0), window.column(1).to_numpy()
            arrow = ids.type
            terms, times = (window.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            slots = np.repeat(np.arange(len(n)), window.column(2).value_lengths().to_numpy())
            # A document's length, against the mean, in hundredths.
            length = 100 - 90 + 90 * n * total // words
            gain = 1_000_000_000 * times // (1000 * times + 8 * length[slots])
            by_term = np.argsort(terms, kind="stable")
            terms, slots, gain = terms[by_term], slots[by_term], gain[by_term]
            bit = np.uint64(1) << (slots & 63).astype(np.uint64)
            first = np.searchsorted(terms, np.arange(n_terms + 1))
            for item, wanted, weights in share.value:
                for term, weight in zip(wanted, weights, strict=True):
                    lo, hi = first[term], first[term + 1]
                    if lo < hi:
                        score[slots[lo:hi]] += weight * gain[lo:hi]
                        np.bitwise_or.at(marked, slots[lo:hi] >> 6, bit[lo:hi])
                groups = np.flatnonzero(marked)
                if not groups.size:
                    continue
                inside = np.unpackbits(marked[groups].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
                row, column = np.nonzero(inside)
                touched = groups[row] * 64 + column
                got = score[touched]
                heap = heaps.setdefault(item, [])
                # Later documents lose ties, so a full heap takes only what is above its least.
                floor = max(0, heap[0][0]) if len(heap) == k else 0
                good = np.flatnonzero(got > floor)
                if good.size > k:
                    least = np.partition(got[good], good.size - k)[good.size - k]
                    good = np.concatenate((good[got[good] > least], good[got[good] == least][:k]))
                for g in good:
                    entry = int(got[g]), -(met + int(touched[g])), ids[int(touched[g])].as_py()
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry[:2] > heap[0][:2]:
                        heapq.heapreplace(heap, entry)
                score[touched], marked[groups] = 0, 0
            met += len(n)
        rows = [(item, doc, s) for item, heap in heaps.items() for s, _, doc in heap]
        if rows:
            items, found, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(found, arrow), pa.array(scores, pa.int64())], ["item", "doc", "score"])

    return placed.select("doc", "n", "terms", "times").mapInArrow(run, f"item long, doc {kind}, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, doc, score): each item's k documents of the highest score above 0, equal scores by ascending id.

    Terms are longest runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))), N being the documents with terms, df those with the term; a document's length
    m is 10 + 90 n N div L, n being its terms and L all terms; it scores the sum, over the item's distinct terms, of
    weight * (10^9 tf div (1000 tf + 8 m)).

    Null and empty texts have no terms: such documents are in no count, such items in no row. Rows of one doc_id are
    documents of their own, a null doc_id comes first among equal scores; items that agree in id and text are one,
    others of one id are ranked each by itself. Empty tables give no rows; other columns aren't read.

    The items' terms are the vocabulary; items come in blocks of about BLOCK_TERMS terms, and each block is searched for
    in all documents: counted first, then scored, both over whole texts.
    """
    bounded_batches(docs.sparkSession)
    asked = item_terms(items, item_col, item_text)
    blocks = 1 + (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "terms").collect()  # bounded by BLOCK_TERMS
        vocabulary = sorted({bytes(t) for r in rows for t in r.terms})
        index = materialize(postings(docs, vocabulary, id_col, text_col), "lexical-postings")
        total, words = index.agg(F.count("*"), F.sum("n")).first()
        in_docs = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row a term
        weight = {vocabulary[t]: (t, math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))) for t, df in in_docs.items()}
        known = [(r.item, [weight[t] for t in map(bytes, r.terms) if t in weight]) for r in rows]
        queries = [(item, *zip(*found, strict=True)) for item, found in known if found]
        order = ["doc", "tie"]
        placed = index.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
        best = materialize(_best(placed, queries, len(vocabulary), total, words or 1, k), "lexical-best")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = asked.select("item", F.col("id").alias("_id"))
    return ranked.join(named, "item").select(F.col("_id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


ORACLE = r"""
WITH t AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)
), w AS (SELECT kind, r, id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
d AS (SELECT r, id, count(*) AS n FROM w WHERE kind = 'd' GROUP BY ALL),
a AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM w WHERE kind = 'd' GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, a GROUP BY term, nn),
i AS (SELECT DISTINCT r, id, term FROM w WHERE kind = 'i'),
s AS (
  SELECT i.r AS item, i.id AS item_id, d.id AS doc_id, d.r, CAST(sum(df.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN df USING (term) JOIN d ON d.r = tf.r, a GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
