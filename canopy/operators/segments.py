"""Segments, cohesion and chunks: everything of one source is one row of arrays, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words of a chunk by level.
BUDGETS = {"brief": 2000, "full": 1400, "expert": 1200}


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with column segs: the array of cleaned lines that aren't blank."""
    return docs.withColumn("segs", T.clean_lines(F.coalesce(text_col, F.lit(""))))


def segments(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, seq, text, start, duration) of untimed text, a row for each line; seq is dense from 0."""
    rows = lines(docs, text_col).select(key, F.posexplode_outer("segs").alias("seq", "text"), F.lit(0.0).alias("start"), F.lit(0.0).alias("duration"))
    # An outer explode, for a filter that Spark infers for an inner one would make the array a second time.
    return rows.filter("text is not null")


def scored(docs: DataFrame, text_col: str = "text", window: int = 3) -> DataFrame:
    """docs with segs, sets (the vocabulary of each), scores (structs (i, score) of gaps) and limit (their threshold).

    A gap has a score if a full window lies on both sides: the Jaccard similarity of the two vocabularies. Each array is
    a column of its own, so that no lambda evaluates another array again for each element.
    """
    rows = lines(docs, text_col).withColumn("sets", F.transform("segs", T.tokens))
    # The window on a gap's right is that on the left of the gap a window later, so each is made once.
    spans = F.when(F.size("sets") < 2 * window, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("sets") - window))
    rows = rows.withColumn("spans", F.transform(spans, lambda i: F.array_distinct(F.flatten(F.slice("sets", i + 1, window)))))
    gaps = F.slice("spans", 1, F.greatest(F.size("spans") - window, F.lit(0)))
    counted = F.transform(gaps, lambda left, i: F.struct(
        (i + window).alias("i"), F.size(F.array_intersect(left, F.get("spans", i + window))).alias("both"), (F.size(left) + F.size(F.get("spans", i + window))).alias("sizes")))
    rows = rows.withColumn("counted", F.transform(counted, lambda g: F.struct(g["i"].alias("i"), g["both"].alias("both"), (g["sizes"] - g["both"]).alias("all"))))
    score = lambda g: F.when(g["all"] == 0, F.lit(1.0)).otherwise(g["both"] / g["all"])
    rows = rows.withColumn("scores", F.transform("counted", lambda g: F.struct(g["i"].alias("i"), score(g).alias("score"))))
    rows = rows.withColumn("sorted", F.array_sort(F.transform("scores", lambda s: s["score"])))
    return rows.withColumn("limit", threshold(F.col("sorted"))).drop("spans", "counted", "sorted")


def threshold(values: Column, fraction: float = 0.25, cap: float = 0.5) -> Column:
    """The discrete quantile of sorted scores, capped; 0 without scores."""
    at = F.ceil(F.size(values) * F.lit(fraction)).cast("int")
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.least(F.get(values, at - 1), F.lit(cap)))


def adaptive_words(total: Column, base: Column, calls: int = 25, fraction: float = 0.4) -> Column:
    return F.when((total <= 0) | (F.lit(calls) <= 0), base).otherwise(F.greatest(base, F.ceil(total / calls / fraction)))


def batch_size(n: Column, target: int = 9) -> Column:
    return F.when(n <= target, F.lit(1)).otherwise(F.ceil(n / target)).cast("int")


def chunk_runs(counts: Column, boundary_after: Column, most: Column, fraction: float = 0.4) -> Column:
    """The chunks of segments as (first, n, words): cut after one if the chunk has `most` words, or enough and the next gap is a boundary."""
    least = F.floor(most * fraction)
    run = lambda first, n, words: F.array(F.struct(first.cast("int").alias("first"), n.cast("int").alias("n"), words.cast("int").alias("words")))

    def step(state: Column, i: Column) -> Column:
        total = state["words"] + F.get(counts, i)
        cut = (total >= most) | ((total >= least) & F.get(boundary_after, i))
        return F.struct(
            F.when(cut, F.lit(0)).otherwise(total).cast("long").alias("words"), F.when(cut, i + 1).otherwise(state["first"]).alias("first"),
            F.when(cut, F.concat(state["runs"], run(state["first"], i + 1 - state["first"], total))).otherwise(state["runs"]).alias("runs"),
        )

    def rest(state: Column) -> Column:
        n = F.size(counts) - state["first"]
        return F.when(n > 0, F.concat(state["runs"], run(state["first"], n, state["words"]))).otherwise(state["runs"])

    zero = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("first"), F.array().cast("array<struct<first:int,n:int,words:int>>").alias("runs"))
    each = F.when(F.size(counts) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(counts) - 1))
    return F.aggregate(each, zero, step, rest)


def topic_chunks(docs: DataFrame, most: int | None = None, level: str = "full", key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, chunk, first_seq, n_segments, n_words, text) of each document, cut at topic boundaries."""
    # Clean lines have single blanks alone between their words.
    counts = F.transform("segs", lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1)
    rows = scored(docs, text_col).select(key, "segs", "scores", "limit", counts.alias("counts"))
    total = F.aggregate("counts", F.lit(0), lambda a, c: a + c)
    budget = F.lit(most) if most else adaptive_words(total, F.lit(BUDGETS[level]))
    # Scores are those of gaps 3 to n - 3, in order; a gap without one is no boundary unless the limit is 1.
    n = F.size("scores")
    first = F.when(n > 0, F.get("scores", F.lit(0))["i"]).otherwise(0)
    after = F.transform("segs", lambda _, i: F.coalesce(F.when((i + 1 >= first) & (i + 1 < first + n), F.get("scores", i + 1 - first)["score"]), F.lit(1.0)) <= F.col("limit"))
    rows = rows.withColumns({"most": budget.cast("long"), "after": after})
    rows = rows.withColumn("runs", chunk_runs(F.col("counts"), F.col("after"), F.col("most")))
    # Texts are cut out before chunks are rows of their own, which so don't carry the other segments.
    told = F.transform("runs", lambda r: F.struct(
        r["first"].alias("first_seq"), r["n"].alias("n_segments"), r["words"].alias("n_words"), F.array_join(F.slice("segs", r["first"] + 1, r["n"]), " ").alias("text")))
    return rows.select(key, F.posexplode_outer(told).alias("chunk", "r")).filter("chunk is not null").select(key, "chunk", "r.*")


def even_chunks(segs: Column, target: int) -> Column:
    """Arrays of segments: about target runs of equal length, a short rest joined to the last."""
    n = F.size(segs)
    per = F.greatest(F.lit(1), F.floor(n / F.greatest(F.lit(1), F.least(F.lit(target), n))).cast("int"))
    count = F.ceil(n / per).cast("int")
    rest = n % per
    folded = (count > 1) & (rest > 0) & (rest < F.greatest(F.lit(1), F.floor(per / 2)))
    count = F.when(folded, count - 1).otherwise(count)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(segs, k * per + 1, F.when(k == count - 1, n).otherwise(per)))
    return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(runs)
