"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a table of ranges.

The jump hash of Lamping and Veach (2014) draws, from a key's own random sequence, the shard counts at which the key
would move; where it last moved below the count asked for is its shard. So with one more shard a key stays or goes to
the new one, and about one key in n + 1 goes. A key's sequence begins at the first 64 bits of the MD5 digest of its
text, which no engine or version changes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

# Fixed value: the multiplier of the published linear congruential sequence.
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0, of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("there is at least one shard")
    out = np.zeros(len(keys), np.int64)
    moving, state, to = np.arange(len(keys)), keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    while moving.size:
        out[moving] = to
        state = state * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = 2.0**31 / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        to = ((to + 1) * draw).astype(np.int64)
        more = to < shards
        moving, state, to = moving[more], state[more], to[more]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """The shard (int) of a key of any type that has a text; a null key is placed as the empty text is.

    Only 8 bytes a row go to Python and 4 come back.
    """
    digest = F.unhex(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 16))

    @F.pandas_udf("int")
    def placed(raw: pd.Series) -> pd.Series:
        return pd.Series(jump(np.frombuffer(b"".join(raw), ">u8"), shards).astype(np.int32))

    return placed(digest)


def assign(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """docs with their shard; equal keys share a shard, a column named shard is replaced, an empty table stays empty."""
    return docs.withColumn("shard", shard_of(F.col(key), shards))


def moved(docs: DataFrame, before: int, after: int, key: str = "doc_id") -> DataFrame:
    """The rows of docs that leave their shard when the number of shards changes, with from_shard and shard."""
    both = docs.withColumns({"from_shard": shard_of(F.col(key), before), "shard": shard_of(F.col(key), after)})
    return both.filter("from_shard <> shard")


def place(docs: DataFrame, shards: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of each row: its shard, its place there, its shard with one more.

    size is the UTF-8 bytes of the text and 16. Slots count a shard's rows from 0, in the order of key (nulls first),
    checksum and size; which of two rows that agree in all of these comes first doesn't show. Rows of one key share a
    shard and are numbered each, null and empty texts have the same size and checksum, other columns aren't read, and an
    empty table gives no rows.

    Rows without texts are sorted by ranges of shard and place, so a large shard, or a key of a third of all rows, is
    many partitions; a row's slot is its number in its partition and what the partitions before hold of its shard. Those
    counts are one row a shard and partition where a shard begins or a partition does.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), shards).alias("shard"), shard_of(F.col(key), shards + 1).alias("grown_shard"),
    )
    order = ["shard", "key", "text_crc32", "size", "tie"]
    rows = materialize(rows, "shard-rows").withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("part", F.shiftright("at", 33)).drop("tie"), "shard-order")
    runs = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("shard", "part", (F.coalesce(ahead, F.lit(0)) - F.col("first")).alias("shift"))
    # At most one row a shard and one a partition.
    out = dealt.join(F.broadcast(runs), ["shard", "part"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """docs as Parquet below path, a folder shard=k each; a large shard is several files, each written by one task."""
    dealt = assign(docs, shards, key).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt.repartitionByRange("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)


#: DuckDB has no CRC-32: it is taken byte by byte with a table that is made from the polynomial.
ORACLE = f"""
WITH RECURSIVE k AS (
  SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents
), walk AS (
  SELECT k, CAST(CAST('0x' || substring(md5(k), 1, 16) AS UBIGINT) AS HUGEINT) AS state, CAST(0 AS BIGINT) AS j FROM k
  UNION ALL
  SELECT k, state, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST((state // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT k, j, (state * {MULTIPLIER} + 1) % 18446744073709551616 AS state FROM walk WHERE j < 41)
), placed AS (
  SELECT k, CAST(max(j) FILTER (WHERE j < 40) AS INTEGER) AS shard, CAST(max(j) FILTER (WHERE j < 41) AS INTEGER) AS grown_shard FROM walk GROUP BY k
), tab AS (
  SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY b) AS tab
  FROM range(256) r(b)
), hexed AS (SELECT DISTINCT coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents
), bytes AS (
  SELECT t, list_transform(range(0, strlen(t)), lambda i:
    CAST(instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17 AS BIGINT)) AS bs FROM hexed
), crc AS (
  SELECT t, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS crc
  FROM bytes, tab
), d AS (
  SELECT doc_id, CAST(strlen(t) + 16 AS BIGINT) AS size, crc AS text_crc32, shard, grown_shard
  FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents) JOIN placed USING (k) JOIN crc USING (t)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM d
"""
