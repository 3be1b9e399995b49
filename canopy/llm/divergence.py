"""Source divergence audit: how far apart the sources of a language are in their use of words, and in which words.

Terms whose counts are the same in every source are one sparse vector of counts with a multiplicity. The smoothed
shares and the distances of all pairs of sources are taken once a distinct vector and multiplied by how many terms have
it; only the report of single terms goes back to the terms themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, byte_classes, byte_words, materialize

LETTERS = byte_classes("abcdefghijklmnopqrstuvwxyz")
#: Distinct terms that a task holds before it gives its counts out.
HELD = 200_000
#: Entries of vectors that one task compares at a time, cells of a dense block, sources on a side of a block of pairs.
ENTRIES, CELLS, SIDE = 20_000, 1_000_000, 1024


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, df) of documents' terms, summed within tasks: a group may have several rows for a term.

    A term is a longest run of ASCII letters and characters beyond ASCII, A-Z lower-cased; df counts documents. Nulls
    in any column are read as ''.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def given(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = list(n)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
            columns += [pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, raw in zip(langs, sources, batch.column(2).cast(pa.binary()), strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                seen: set = set()
                for words in byte_words(raw.as_py(), LETTERS):
                    n.update(words)
                    seen.update(words)
                df.update(seen)
                size += len(n)
                if size > HELD:
                    yield from given(held)
                    held, size = {}, 0
        yield from given(held)

    return plain.mapInArrow(run, "lang string, source string, term string, n long, df long")


def _share(count, total, terms, smooth: int, scale: int):
    """1 + floor(scale * (count + smooth) / (total + smooth * terms)), exact for any counts; null if there are no terms."""
    whole = f"cast({scale} as decimal(20,0)) * ({count} + {smooth}) div ({total} + {smooth} * {terms})"
    return F.when(F.col(terms) > 0, F.lit(1) + F.expr(whole))


def _pairs(groups: DataFrame, entries: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each pair of sources by number, a < b: the sum over all kept terms of how far their shares differ.

    Sources are dealt into blocks of SIDE, pairs of blocks into tasks, and vectors into buckets of about ENTRIES. A
    task adds, for each pair, what its vectors differ from the pair's distance for a term that neither source has;
    bucket 0 adds that distance for all terms, so pairs are whole without a vector.
    """
    ahead = F.max("number").over(Window.partitionBy("lang"))
    block, last = F.floor(F.col("number") / SIDE).cast("int"), F.floor(ahead / SIDE).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    told = groups.select("lang", "number", "none", "terms", block.alias("block"), last.alias("last")).join(langs.select("lang", "buckets"), "lang")
    sides = told.select("lang", "number", "none", "terms", "buckets", F.explode(others).alias("x")).select("lang", "number", "none", "terms", "buckets", "x.i", "x.j")
    sides = sides.select("lang", "number", "none", "terms", "i", "j", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    placed = entries.join(told.select("lang", "number", "block", "last", "buckets"), ["lang", "number"])
    placed = placed.select("lang", "vector_id", "multiple", "number", "share", F.pmod(F.xxhash64("vector_id"), "buckets").cast("int").alias("bucket"), F.explode(others).alias("x"))
    placed = placed.select("lang", "x.i", "x.j", "bucket", "vector_id", "multiple", "number", "share")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key = [left.column(c)[0].as_py() for c in ("lang", "i", "j", "bucket", "terms")]
        lang, i, j, bucket, terms = key
        numbers, none = (left.column(c).to_numpy() for c in ("number", "none"))
        order = np.argsort(numbers)
        numbers, none = numbers[order], none[order]
        rows = np.flatnonzero(numbers // SIDE == i)
        sums = np.zeros((len(rows), len(numbers)), np.int64)
        apart = np.abs(none[rows, None] - none[None, :])
        if bucket == 0:
            sums += terms * apart
        vectors, at = np.unique(right.column("vector_id").to_numpy(), return_inverse=True)
        multiple = np.zeros(len(vectors), np.int64)
        multiple[at] = right.column("multiple").to_numpy()
        sums -= multiple.sum() * apart
        place, share = np.searchsorted(numbers, right.column("number").to_numpy()), right.column("share").to_numpy()
        by = np.argsort(at, kind="stable")
        at, place, share = at[by], place[by], share[by]
        step = max(1, CELLS // len(numbers))
        for first in range(0, len(vectors), step):
            some = multiple[first : first + step]
            lo, hi = np.searchsorted(at, (first, first + len(some)))
            dense = np.repeat(none[:, None], len(some), axis=1)
            dense[place[lo:hi], at[lo:hi] - first] = share[lo:hi]
            for k, row in enumerate(rows):
                sums[k] += np.abs(dense - dense[row]) @ some
        a, b = np.nonzero((numbers[rows, None] < numbers[None, :]) & ((numbers // SIDE == j)[None, :]))
        return pa.table([pa.array([lang] * len(a), pa.string()), numbers[rows][a], numbers[b], sums[a, b]], ["lang", "a", "b", "value"])

    by = ["lang", "i", "j", "bucket"]
    sides, placed = (x.toDF(*x.columns) for x in (sides, placed))  # columns of their own, for both come from groups
    parts = sides.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(run, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, smooth: int = 5, scale: int = 1_000_000_000, most: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources (part pair) and the words a source overuses (part term).

    A language keeps the terms of at least least_docs of its documents. A group's share of a term is
    1 + floor(scale * (count + smooth) / (all counts + smooth * kept terms)). Part pair has each other source of the
    language, its value being the sum of the shares' differences; part term has the first `most` terms by how far the
    group's share is above the language's. Ranks are from 1, by falling value, then by item.

    Nulls in any column are read as '', so they are a language or source of their own; groups without terms are in pairs
    by their shares of 0 occurrences; a language without kept terms has pairs of value 0 and no terms; repeated rows
    count each; equal values go by item; an empty table gives no rows; other columns aren't read.
    """
    plain = lambda c, to: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to)
    groups = docs.select(plain(lang_col, "lang"), plain(source_col, "source")).distinct()
    groups = materialize(groups.withColumn("number", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")), "audit-groups")
    # One shuffle: what is dealt by language and term needs no other for its sources, nor for the language.
    counts = term_counts(docs, lang_col, source_col, text_col).repartition("lang", "term")
    per = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = per.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = materialize(terms.filter(F.col("df") >= least_docs).drop("df"), "audit-terms")
    vectors = terms.groupBy("lang", "vector").agg(F.count("*").alias("multiple"), F.first("n").alias("in_lang"))
    vectors = materialize(vectors.withColumn("vector_id", F.monotonically_increasing_id()), "audit-vectors")
    flat = vectors.select("lang", "vector_id", "multiple", "in_lang", F.explode("vector").alias("x")).select("lang", "vector_id", "multiple", "in_lang", "x.source", "x.n")
    totals = flat.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("multiple")).alias("total"))
    kept = vectors.groupBy("lang").agg(F.sum("multiple").alias("terms"), F.sum(F.size("vector")).alias("entries"), F.sum(F.col("in_lang") * F.col("multiple")).alias("lang_total"))
    langs = groups.select("lang").distinct().join(kept, "lang", "left").na.fill(0, ["terms", "entries", "lang_total"])
    langs = materialize(langs.withColumn("buckets", (F.floor(F.col("entries") / ENTRIES) + 1).cast("int")), "audit-langs")
    known = groups.join(langs.drop("buckets", "entries"), "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    known = materialize(known.withColumn("none", F.coalesce(_share("0", "total", "terms", smooth, scale), F.lit(0))), "audit-known")

    shares = flat.join(known.select("lang", "source", "number", "total", "terms", "lang_total"), ["lang", "source"])
    shares = shares.withColumn("share", _share("n", "total", "terms", smooth, scale))
    value = _pairs(known, shares.select("lang", "vector_id", "multiple", "number", "share"), langs)
    value = materialize(value, "audit-pairs")
    ends = value.select("lang", F.col("a").alias("number"), F.col("b").alias("other"), "value")
    ends = ends.unionByName(value.select("lang", F.col("b").alias("number"), F.col("a").alias("other"), "value"))
    named = lambda number, to: groups.select("lang", F.col("number").alias(number), F.col("source").alias(to))
    pairs = ends.join(named("number", "source"), ["lang", "number"]).join(named("other", "item"), ["lang", "other"])

    first = lambda item: Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)
    over = shares.withColumn("value", F.col("share") - _share("in_lang", "lang_total", "terms", smooth, scale)).filter("value > 0")
    # Of vectors with different values, only the first `most` can have a term in the report; ties all stay.
    best = over.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).filter(F.col("r") <= most)
    best = best.select("vector_id", "source", "value")
    some = vectors.select("lang", "vector", "vector_id").join(best.select("vector_id").distinct(), "vector_id", "left_semi")
    words = terms.select("lang", "vector", F.col("term").alias("item")).join(some, ["lang", "vector"]).select("lang", "vector_id", "item")
    words = words.join(best, "vector_id").withColumn("rank", F.row_number().over(first("item"))).filter(F.col("rank") <= most)
    pairs = pairs.withColumn("rank", F.row_number().over(first("item")))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(words, "term"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS in_lang FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, CAST(sum(in_lang) AS HUGEINT) AS nl FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (coalesce(t.n, 0) + 5 * v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (in_lang + 5) // (nl + 5 * v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM part)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
