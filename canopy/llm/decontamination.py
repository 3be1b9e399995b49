"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Test items are short and documents long, so their Jaccard similarity says nothing; what counts is the share of an item's
shingles that a document contains. Items are partitioned by the power of two of their number of distinct shingles; in
each partition an item's sketch is its shingles of the smallest hash, as many as the partition's largest item may
lack and one more. A document that contains the required share of an item must contain one of its sketch, however long
it is and wherever the shingles stand; so the candidates miss nothing. They are then verified by exact containment of
the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_column

#: A side of at most so many rows (a few numbers each, counted first) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def _hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words) of the texts that have words."""
    return df.select(F.col(key).alias("key"), words_column(F.col(text)).alias("words")).filter(F.size("words") > 0)


def _shingles(words: DataFrame, n: int) -> DataFrame:
    """(key, words, at, h): a row for each n-word shingle, its hash being that of its words' hashes.

    The arrays of words and hashes are made once a text; a shingle costs a few long reads in generated code. A text of
    fewer than n words has none.
    """
    hashed = words.filter(F.size("words") >= n).select("key", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))
    placed = hashed.select("key", "words", "hs", F.explode(F.sequence(F.lit(0), F.size("hs") - n)).alias("at"))
    return placed.select("key", "words", "at", F.xxhash64(*[F.get("hs", F.col("at") + k) for k in range(n)]).alias("h"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, n_item, n_shared, containment) for each pair whose containment is at least threshold.

    Words are lower-cased and split at ASCII white space; containment is the share of the item's distinct n-word
    shingles that the document contains. An item of k < n words is one shingle of k words, and is looked for among the
    k-word shingles of all documents. Rows of one id are one document (or item) with the shingles of all of them; rows
    with a null id take no part; null and empty texts have no shingles and are in no pair; empty tables give no rows;
    other columns aren't read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold lies in (0, 1]")
    text_of = lambda words, k: F.array_join(F.slice(words, F.col("at") + 1, k), " ")
    items, docs = items.filter(F.col(item_col).isNotNull()), docs.filter(F.col(id_col).isNotNull())
    item_words = _words(items, item_col, item_text).withColumn("k", F.least(F.size("words"), F.lit(n)))
    lengths = sorted(r.k for r in item_words.select("k").distinct().collect()) or [n]  # n rows at most
    grams = _union([_shingles(item_words.filter(F.col("k") == k).drop("k"), k).select(F.col("key").alias("item"), F.lit(k).alias("k"), "h", text_of(F.col("words"), k).alias("gram")) for k in lengths])
    grams = materialize(grams.distinct(), "decontam-items")
    sizes = grams.groupBy("item").agg(F.count("*").alias("n_item"))
    sizes = sizes.withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    sizes = materialize(sizes.withColumn("sketch", F.floor(F.round(largest * (1 - threshold), 6)).cast("long") + 1), "decontam-sizes")
    order = Window.partitionBy("item").orderBy(F.xxhash64("h", F.lit("minhash")), "h", "k", "gram")
    sketch = grams.join(sizes.select("item", "sketch"), "item").withColumn("rank", F.row_number().over(order))
    sketch = materialize(sketch.filter("rank <= sketch").select("h", "k", "item").distinct(), "decontam-sketch")
    rows = sketch.count()
    doc_words = _words(docs, id_col, text_col)
    hits = _union([_shingles(doc_words, k).select("key", "h").join(_hinted(sketch.filter(F.col("k") == k).drop("k"), rows), "h") for k in lengths])
    candidates = materialize(hits.groupBy("key", "item").agg(F.count("*").alias("hits")).select("key", "item"), "decontam-candidates")
    some = candidates.select("key").distinct()
    suspects = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("t")).join(_hinted(some, some.count()), "key", "left_semi")
    suspects, gram_rows = _words(suspects, "key", "t"), grams.count()
    found = [_shingles(suspects, k).join(_hinted(grams.filter(F.col("k") == k), gram_rows), "h").filter(text_of(F.col("words"), k) == F.col("gram")) for k in lengths]
    found = _union([x.select("key", "item", "k", "gram") for x in found]).distinct()
    shared = found.groupBy("key", "item").agg(F.count("*").alias("n_shared")).join(candidates, ["key", "item"], "left_semi")
    out = shared.join(_hinted(sizes, rows), "item").withColumn("containment", F.col("n_shared") / F.col("n_item"))
    out = out.filter(F.col("containment") >= threshold)
    return out.select(F.col("key").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared", "containment")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that contain an item; rows with a null id stay.

    Null and empty texts contain nothing and stay; an id goes with all its rows; empty tables take nothing out; all
    columns stay as they are.
    """
    found = materialize(contained(docs, items, id_col=id_col, **options).select(id_col).distinct(), "decontam-found")
    return docs.join(_hinted(found, found.count()), id_col, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')
  FROM benchmark WHERE item_id IS NOT NULL
), i AS (SELECT id, w, least(len(w), 5) AS k FROM w WHERE kind = 'i' AND len(w) > 0),
gi AS (
  SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS gram FROM i
), gd AS (
  SELECT DISTINCT id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS gram
  FROM w, (SELECT DISTINCT k FROM i) WHERE kind = 'd' AND len(w) >= k
), n AS (SELECT id, count(*) AS n_item FROM gi GROUP BY id),
s AS (SELECT gd.id AS doc_id, gi.id AS item_id, count(*) AS n_shared FROM gd JOIN gi USING (k, gram) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM s JOIN n ON n.id = s.item_id WHERE CAST(n_shared AS DOUBLE) / n_item >= 0.8
"""
