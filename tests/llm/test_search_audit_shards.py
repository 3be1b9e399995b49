"""Lexical search, source audit and sharding: against brute force, against their SQL, and on odd rows."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import divergence, lexical, queries, sharding
from canopy.llm.common import byte_classes, byte_words

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, score double, shard string, size string, tie string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1.5, "y", "z", "t") for r in rows], SCHEMA)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_source_divergence", "op13_sharding"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    mine, theirs = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert set(mine.columns) == set(theirs.columns) and len(mine)
    told = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert told(mine) == told(theirs)


def test_words_of_long_texts_come_whole():
    raw = ("Ab-ç9 é " * 5000).encode()
    letters = byte_classes("abcdefghijklmnopqrstuvwxyz")
    pieces = list(byte_words(raw, letters, piece=1000))
    assert len(pieces) > 10 and [w for p in pieces for w in p] == ["ab".encode(), "ç".encode(), "é".encode()] * 5000
    assert list(byte_words(b"", letters)) == []


# -- 11 lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(rows, items, k):
    """The contract read literally: (item, rank, doc, score)."""
    counts = [(d, Counter(TERM.findall(lower(t)))) for d, t in rows]
    counts = [(d, c) for d, c in counts if c]
    n, words = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        found = []
        for d, c in counts:
            m = 100 - 90 + 90 * c.total() * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lower(text))) if c[t])
            found += [(d, s)] if s > 0 else []
        found.sort(key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
        out += [(item, r, d, s) for r, (d, s) in enumerate(found[:k], 1)]
    return out


@pytest.mark.parametrize("sizes", [(16_384, 4_000_000, 500_000), (64, 300, 20)])
def test_search_is_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("WINDOW", "POSTINGS", "BLOCK_TERMS"), sizes, strict=True):
        monkeypatch.setattr(lexical, name, size)
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma9", "ñandú", "Ünder", "x", "42"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for i in range(400)]
    rows += [(7, "alpha alpha beta"), (7, "alpha alpha beta"), (None, "alpha"), (None, None), (900, ""), (901, "?! ..."), (902, "alpha " * 3000), (903, "ALPHA-ñandú")]
    items = [(1, "alpha beta ALPHA"), (2, None), (3, "nowhere"), (4, " ".join(vocabulary)), (4, " ".join(vocabulary)), (4, "w1"), (None, "ñandú x"), (5, "...")]
    table = spark.createDataFrame([(i, t, "r", 1) for i, t in items], "item_id int, text string, rank string, doc_id int")
    got = lexical.rank(docs(spark, [(d, t, "en", "s") for d, t in rows]), table, k=10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, ranked(rows, items, 10)))


def test_search_of_nothing(spark):
    some, items = docs(spark, [(1, "a b", "en", "s")]), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical.rank(some.limit(0), items).count() == 0 and lexical.rank(some, items.limit(0)).count() == 0
    assert lexical.rank(docs(spark, [(1, None, "en", "s")]), items).count() == 0
    text_ids = some.withColumn("doc_id", F.lit("one"))
    assert [tuple(r)[:3] for r in lexical.rank(text_ids, items).collect()] == [(1, 1, "one")]


# -- 12 source divergence


def audited(rows, least, most):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = term.findall(lower(text))
        groups.add((lang or "", source or ""))
        n[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = {t for t, c in df[lang].items() if c >= least}
        sources, share = sorted(s for x, s in groups if x == lang), {}
        n[lang, None] = sum((n[lang, s] for s in sources), Counter())
        for s in [*sources, None]:
            total = sum(n[lang, s][t] for t in kept)
            share[s] = {t: 1 + 10**9 * (n[lang, s][t] + 5) // (total + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(share[s][t] - share[o][t]) for t in kept)) for o in sources if o != s]
            words = [(t, share[s][t] - share[None][t]) for t in kept if n[lang, s][t] and share[s][t] > share[None][t]]
            for part, found, limit in (("pair", pairs, None), ("term", words, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(found[:limit], 1)]
    return out


@pytest.mark.parametrize("sizes", [(200_000, 20_000, 1_000_000, 1024), (20, 10, 30, 2)])
def test_audit_is_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("HELD", "ENTRIES", "CELLS", "SIDE"), sizes, strict=True):
        monkeypatch.setattr(divergence, name, size)
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyzß"] + ["Only", "ALONE"]
    text = lambda: " ".join(rng.choices(words[:20], k=rng.randint(0, 12)))
    rows = [(text(), rng.choice(["en", "de"]), f"s{rng.randint(0, 6)}") for _ in range(400)]
    rows += [(None, "en", "silent"), ("1 2 3", "fr", "a"), ("bx", "fr", "b"), ("ax", None, None), (None, None, "s"), ("Only", "en", "s1"), ("ax " * 2000, "en", "s2")] + [("ax same", "en", "s3")] * 9
    got = divergence.audit(docs(spark, [(i, t, x, s) for i, (t, x, s) in enumerate(rows)]), least_docs=8, most=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(audited(rows, 8, 3))
    assert divergence.audit(docs(spark, [(1, "a", "en", "s")]).limit(0)).count() == 0


def test_shares_of_huge_counts_are_exact(spark):
    df = spark.createDataFrame([(3 * 10**12, 10**13, 10**6)], "n long, total long, terms long")
    assert df.select(divergence._share("n", "total", "terms", 5, 10**9)).first()[0] == 1 + 10**9 * (3 * 10**12 + 5) // (10**13 + 5 * 10**6)


# -- 13 sharding


def jumped(key, shards):
    """The published loop, a key at a time."""
    at = to = 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


def test_jump_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**64, 20_000, np.uint64)
    before, after = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert [jumped(int(k), 40) for k in keys[:500]] == before[:500].tolist()
    moves = before != after
    assert set(after[moves]) == {40} and abs(moves.mean() - 1 / 41) < 0.005
    assert np.bincount(before, minlength=40).min() > 400 and not sharding.jump(keys, 1).any()
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_places_are_whole_and_gapless(spark):
    rows = [(i, f"text {i} é", "en", "s") for i in range(500)] + [(7, "hot", "en", "s")] * 300 + [(None, None, None, None), (None, "", "en", "s"), (501, "x" * 100_000, "en", "s")]
    table = sharding.place(docs(spark, rows), shards=5).toPandas()
    assert len(table) == len(rows) and table.groupby(table.doc_id.fillna(-1)).shard.nunique().max() == 1
    for _, shard in table.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    assert ((table.shard == table.grown_shard) | (table.grown_shard == 5)).all()
    want = Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    assert Counter(zip(table["size"], table.text_crc32, strict=True)) == want
    assert sharding.place(docs(spark, rows[:1]).limit(0), shards=5).count() == 0


def test_shards_are_written_and_moved(spark, tmp_path):
    some = docs(spark, [(i, f"t{i}", "en", "s") for i in range(300)])
    sharding.write(some, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    told = {r.doc_id: r.shard for r in sharding.assign(some, 6).collect()}
    assert {r.doc_id: r.shard for r in back.select("doc_id", "shard").collect()} == told
    gone = sharding.moved(some, 6, 7).collect()
    assert gone and all(r.shard == 6 and told[r.doc_id] == r.from_shard for r in gone)
