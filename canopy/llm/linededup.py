"""Cross-site boilerplate lines by distinct-site spread.

Each distinct line has a HyperLogLog sketch of the sites it stands on; sketches merge by aggregation, on the map side
first, so a line that a third of all documents share is a few rows. Lines whose estimate is near the threshold get
an exact distinct count. Lines of at least min_sites sites are removed wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: White space that doesn't count at the ends of a line.
BLANKS = " \t\r"
#: Up to so many boilerplate lines (16 bytes each, counted first) go to every task; more are joined by shuffle.
BROADCAST_LINES = 200_000


def _key(line):
    """Two 64-bit hashes of a line, the second seeded by the first."""
    return F.xxhash64(line).alias("h1"), F.xxhash64(line, line).alias("h2")


def _lines(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    lines = docs.select(*more, F.explode(F.split(text_col, "\n")).alias("line"))
    return lines.withColumn("line", F.trim("line", F.lit(BLANKS))).filter("line <> ''")


def spread_lines(docs: DataFrame, min_sites: int = 10, text_col: str = "text", site_col: str = "source", lg_k: int = 12) -> DataFrame:
    """(h1, h2, n_sites) of each line that stands on min_sites sites or more; n_sites is exact near the threshold.

    A line counts once a site, however often it stands there; a null site counts for nothing; blank lines and null
    texts have no part.
    """
    placed = _lines(docs, text_col, site_col).select(*_key(F.col("line")), F.col(site_col).cast("string").alias("site"))
    sketches = placed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    # A line is on no more sites than it has places.
    spread = sketches.filter(F.col("n") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("n_sites"))
    margin = max(1, round(4 * 1.04 / 2 ** (lg_k / 2) * min_sites))
    spread = materialize(spread.filter(F.col("n_sites") >= min_sites - margin), "lines-spread")
    near = spread.filter(F.col("n_sites") <= min_sites + margin).select("h1", "h2")
    rows = near.count()
    if not rows:
        return spread
    near = F.broadcast(near) if rows <= BROADCAST_LINES else near
    exact = placed.join(near, ["h1", "h2"], "left_semi").filter("site is not null").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_sites"))
    return spread.filter(F.col("n_sites") > min_sites + margin).unionByName(exact.filter(F.col("n_sites") >= min_sites))


def remove(docs: DataFrame, min_sites: int = 10, text_col: str = "text", site_col: str = "source", **options) -> DataFrame:
    """docs with boilerplate lines taken out of text, and n_lines, n_removed (long) added.

    Every row stays, in its columns; a document of nothing but boilerplate keeps an empty text; a null text stays null
    with 0 lines. The other lines keep their order and their blanks. Lines of equally many sites are treated alike;
    repeated rows are cleaned each, and count once a site. An empty table gives no rows. Columns n_lines and n_removed
    that docs has already are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    spread = materialize(spread_lines(docs, min_sites, text_col, site_col, **options), "lines-boilerplate")
    if spread.count() > BROADCAST_LINES:
        return _remove_by_join(docs, spread, text_col)
    known = {(r.h1 & (1 << 64) - 1, r.h2 & (1 << 64) - 1) for r in spread.select("h1", "h2").collect()}  # bounded by the count above
    share = docs.sparkSession.sparkContext.broadcast((frozenset(h for h, _ in known), frozenset(known)))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        first, both = share.value
        for batch in batches:
            texts, counts, removed = [], [], []
            for text in batch.column(at).to_pylist():
                lines = [] if text is None else text.split("\n")
                kept = []
                for line in lines:
                    raw = line.strip(BLANKS).encode("utf-8", "surrogatepass")
                    h = xxh64_intdigest(raw, 42)
                    if not raw or h not in first or (h, xxh64_intdigest(raw, h)) not in both:
                        kept.append(line)
                texts.append(None if text is None else "\n".join(kept))
                counts.append(len(lines))
                removed.append(len(lines) - len(kept))
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], [*batch.schema.names, "n_lines", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, n_lines long, n_removed long")


def _remove_by_join(docs: DataFrame, spread: DataFrame, text_col: str) -> DataFrame:
    """The same for any number of boilerplate lines: only places and hashes are shuffled, then put back by text."""
    texts = docs.select(F.col(text_col).alias("t")).filter("t is not null").distinct()
    keyed = texts.select(F.xxhash64("t").alias("_lines_k1"), F.xxhash64("t", "t").alias("_lines_k2"), F.posexplode(F.split("t", "\n")).alias("at", "line"))
    keyed = keyed.withColumn("line", F.trim("line", F.lit(BLANKS))).filter("line <> ''").select("_lines_k1", "_lines_k2", "at", *_key(F.col("line")))
    out = keyed.join(spread.select("h1", "h2"), ["h1", "h2"]).groupBy("_lines_k1", "_lines_k2").agg(F.collect_set("at").alias("_lines_out"))
    named = docs.withColumns({"_lines_k1": F.xxhash64(text_col), "_lines_k2": F.xxhash64(text_col, text_col)}).join(out, ["_lines_k1", "_lines_k2"], "left")
    lines, gone = F.split(text_col, "\n"), F.coalesce("_lines_out", F.array().cast("array<int>"))
    kept = F.filter(lines, lambda line, i: ~F.array_contains(gone, i))
    named = named.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    named = named.withColumn("n_removed", F.size(gone).cast("long")).withColumn(text_col, F.when(F.size(gone) == 0, F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    return named.select(*docs.columns, "n_lines", "n_removed")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents
), b AS (
  SELECT trim(line, chr(32) || chr(9) || chr(13)) AS k FROM l
  WHERE trim(line, chr(32) || chr(9) || chr(13)) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IS NOT NULL) AS n_removed, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE k IS NULL) AS text
  FROM l LEFT JOIN b ON trim(line, chr(32) || chr(9) || chr(13)) = k GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id)
"""
