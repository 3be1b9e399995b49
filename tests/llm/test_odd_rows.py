"""Nulls, repeats, ties, clashing names and empty tables, where the operators' own tests don't have them."""

import random

import pytest

from canopy.llm import langid, ngram, packing, simhash, similar, toxicity

from .test_operators import docs, tokenizer  # noqa: F401  a fixture


def table(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


def test_packing_of_repeats_ties_and_null_ids(spark, tokenizer):  # noqa: F811
    rows = [(None, "alpha beta"), (None, "alpha beta"), (1, "alpha"), (1, "alpha"), (2, "alpha"), (2, "beta gamma delta"), (3, None), (3, ""), *[(4, "tie of one length")] * 40]
    df = table(spark, [(*r, 9, "x") for r in rows], "doc_id long, text string, piece int, sequence_id string")
    got = packing.pack(df.repartition(4), tokenizer, capacity=16).toPandas()
    assert len(got) == len(rows) and (got.piece == 0).all()  # each row is packed, whatever its id
    assert got.doc_id.isna().sum() == 2 and (got.doc_id == 4).sum() == 40 and got[got.doc_id == 3].length.tolist() == [1, 1]
    for _, mine in got.sort_values("offset").groupby("sequence_id"):
        assert (mine.offset == mine.length.cumsum() - mine.length).all() and mine.length.sum() <= 16
    assert packing.pack(table(spark, []), tokenizer).count() == 0


def test_language_of_repeats_and_clashing_columns(spark):
    rows = [(i, "kato miru kamika toru " * 5 if i % 2 else "schung eitber ungsch " * 5, "aa" if i % 2 else "bb") for i in range(40)]
    rows += [(50, "no label here", None), (None, "kato miru", "aa"), (51, None, "bb")]
    model = langid.fit_on(table(spark, rows, "doc_id long, text string, lang string"))
    odd = [(1, "kato miru", "q", 0.5, True), (1, "kato miru", "q", 0.5, True), (None, "schung eitber", None, None, None), (2, None, "q", 0.0, None), (2, "ungsch", "q", 0.0, None)]
    got = langid.predict(table(spark, odd, "doc_id long, text string, lang_pred string, score double, rejected boolean"), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "bb"), (1, "aa"), (1, "aa"), (2, "bb"), (2, "und")]
    assert langid.predict(table(spark, []), model).count() == 0


def test_toxicity_learned_from_tables(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choices(["ra", "to", "len", "mi", "sud"], k=rng.randint(1, 4))) for _ in range(300)]
    text = lambda toxic: " ".join(rng.choices(plain, k=40) + ([rng.choice(["grubble", "snarkfoo", "vexxa"])] if toxic else []) + rng.choices(plain, k=3))
    toxic = [i % 3 == 0 for i in range(700)]
    texts = [text(t) for t in toxic]
    known = [(i, int(t), 9) for i, t in enumerate(toxic[:500])] + [(None, 1, 9), (0, 1, 9), (3, None, 9), (10_000, 1, 9)]  # repeats, nulls, a label without a document
    model = toxicity.fit_on(docs(spark, texts[:500] + [None, ""]), table(spark, known, "doc_id long, toxic int, text int"))
    held = docs(spark, [*texts[500:], None, ""]).withColumnRenamed("h", "predicted").withColumnRenamed("key", "worst")
    got = {r.doc_id: r.predicted for r in toxicity.score(held, model).collect()}
    assert len(got) == 202 and sum(got[i] == int(t) for i, t in enumerate(toxic[500:])) >= 190 and got[200] == got[201] == 0
    twice = table(spark, [(None, texts[500]), (None, texts[500]), (1, None)])
    assert toxicity.score(twice, model).count() == 3 and toxicity.keep_ordinary(twice, model).schema == twice.schema


def test_toxicity_of_empty_tables(spark):
    none = toxicity.fit_on(table(spark, []), table(spark, [], "doc_id long, toxic int"))
    assert toxicity.score(table(spark, []), none).count() == 0 and toxicity.keep_ordinary(table(spark, []), none).count() == 0
    got = toxicity.score(docs(spark, ["a b", None]), none).collect()
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in got)  # nothing learned: nothing is rejected


@pytest.mark.parametrize("order", [1, 3])
def test_numbers_of_odd_rows(spark, order):
    rows = [(1, "a b a"), (1, "a b a"), (None, "b"), (2, None), (3, " \n"), (4, "A\tB")]
    words = ngram.vocabulary(table(spark, rows))
    numbered = ngram.number(table(spark, [(*r, b"x") for r in rows], "doc_id long, text string, words binary"), words)
    got = sorted((r.doc_id or 0, bytes(r.words)) for r in numbered.collect())
    assert len(got) == 6 and got[1][1] == got[2][1] and len(set(map(len, (w for i, w in got if i in (2, 3))))) == 1  # an end alone
    model = ngram.grow(numbered, words, order=order, least=1)
    scored = ngram.score_numbers(numbered, model).collect()
    assert len(scored) == 6 and all(r.score < 0 for r in scored)
    assert ngram.number(table(spark, []), words).count() == 0


def test_near_copies_of_nothing_and_clashing_names(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0 and similar.similar_groups(table(spark, [])).count() == 0
    rows = [(2, "one two three four five six", 1, 1), (1, "one two three four five six", 1, 1), (None, "one two three four five six", 1, 1), (3, None, 1, 1)]
    df = table(spark, rows, "doc_id long, text string, group_id int, component_id int")
    assert {(r.doc_id, r.group_id) for r in similar.similar_groups(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {(1, 1), (2, 1), (None, 1), (3, 3)}
