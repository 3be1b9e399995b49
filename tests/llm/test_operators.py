"""Each operator against brute force and on odd rows: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canopy.llm import ann, decontamination, graph, html, langid, linededup, ngram, packing, pii, simhash, similar, toxicity

LONG = "word " * 40_000


def docs(spark, texts, **more):
    """doc_id, text, lang, source and columns whose names the operators use inside."""
    rows = [(i, t, "en", f"s{i % 20}", 7, "x", 1, 1.5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, key string, h long, score double")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


# -- 1 html


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad banner">Buy now</div><article><header><h1>Head &amp; line</h1></header><p>First  para
graph&nbsp;of <b>text</b>.<br>More<p>Second &eacute; one.<aside>Side</aside><form><input>Sign up</form><div id="comments"><p>Nice!</p></div></article>
<footer>&copy; me</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(PAGE) == "Head & line\nFirst para graph of text . More\nSecond é one.".replace("text .", "text.")
    assert html.main_text("<div><p>" + "a long paragraph of words " * 9 + "</p><p>short</p></div><div class=menu>x</div>").endswith("short")
    for empty in (None, "", "<html></html>", "<script>x"):
        assert html.main_text(empty) == ""
    assert html.main_text("<p>" * 3000 + "deep") == "deep"


def test_html_region_holds_every_dense_line():
    paragraph = lambda k: f"<p>{'words of a long paragraph ' * 8}{k}</p>"
    page = "<body><div>" + "".join(map(paragraph, range(17))) + "</div><div>" + "".join(map(paragraph, range(17, 20))) + "</div></body>"
    assert len(html.main_text(page).split("\n")) == 20


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t")], "page_id long, url string, html string, text string")
    out = html.extract(pages).collect()
    assert len(out) == 3 and out[2].text == "" and out[2].n_chars == 0 and out[0].n_chars == len(out[0].text)
    assert html.extract(pages.limit(0)).count() == 0


# -- 2 language


def test_language(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "eit", "ber"], "cc": ["eau", "oux", "tion", "ment"]}
    make = lambda g: " ".join("".join(rng.choices(syllables[g], k=3)) for _ in range(30))
    rows = [(i, make(g), g) for i, g in enumerate([*syllables] * 30)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_on(train)
    test = spark.createDataFrame([(i, make(g), g) for i, g in enumerate([*syllables] * 10)] + [(90, None, None), (91, "", None), (92, "12 ?!", None), (93, LONG, None), (None, make("aa"), "aa")], train.schema)
    got = {r.doc_id: r for r in langid.predict(test, model).collect()}
    assert all(got[i].lang_pred == g for i, g in enumerate([*syllables] * 10)) and got[None].lang_pred == "aa"
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.fit_on(train.limit(0))
    assert {r.lang_pred for r in langid.predict(test, nothing).collect()} == {"und"}


# -- 3 personal data


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "b@", "@", ".", "c.d", "1", "42", "255", "300", " ", "+1", "-", "(", ")", "4111111111111111", "%"], k=rng.randint(1, 14)))
        assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text)) == brute_spans(text), text


def test_pii_mentions_of_a_whole_token():
    text = "to " + ",".join(f"user{i}@host.org" for i in range(9)) + ",odd@localhost and " + "x" * 70 + "@localhost"
    got = pii.mentions(text, pii.base_spans(text))
    assert [m[3] for m in got] == [0] * 9 + [None] * 2
    assert [text[m[0] : m[1]] for m in got[9:]] == ["odd@localhost", "x" * 70 + "@localhost"]


def test_pii_finds_keys_that_no_rule_knows(spark):
    rng = random.Random(9)
    runs = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(60)]
    fillers = [f"word{i}" for i in range(200)]
    named = [f"{rng.choice(fillers)} token = {run} {rng.choice(fillers)}" for run in runs]
    others = ["x token = Zk9_pLq-77aTTv01/xx y", "x token = hunter2!pass y", "a sum of " + "0123456789abcdef" * 3 + " here", "the build-2024-aaaa-bbbb-cccc x"]
    out = {r.doc_id: r for r in pii.extract(docs(spark, named + others)).collect()}
    # Half the runs are seeds; all the rest are found by their words alone, and so are a key and a password of other shapes.
    assert all(out[i].n_secret == 1 for i in range(60)) and 18 <= sum(out[i].n_unseen for i in range(60)) <= 42
    assert out[60].spans == "secret:10:29" and out[60].n_unseen == 1 and out[61].spans.startswith("secret:10:") and out[61].n_unseen == 1
    assert out[62].spans == out[63].spans == ""  # a checksum and a name that no words tell of
    # Without the seeds' texts there are no patterns, and nothing is found.
    assert all(r.n_more == 0 for r in pii.extract(docs(spark, others)).collect())
    # Where other identifiers stand in the same words, these words prove nothing.
    mixed = [f"token = user{i}@host{i}.org" for i in range(60)]
    assert all(r.n_secret == 0 for r in pii.extract(docs(spark, [x.split(" ", 1)[1].rsplit(" ", 1)[0] for x in named] + mixed)).collect())


def test_pii_bootstrap_finds_what_the_patterns_show(spark):
    known = [f"mail address user{i}@host{i}.org please" for i in range(8)]
    texts = [*known, "mail address odd@localhost please", None, "", LONG, known[0], "see room@noon about"]
    out = {r.doc_id: r for r in pii.extract(docs(spark, texts)).collect()}
    assert out[8].spans == "email:13:26" and out[8].n_email == 0 and out[8].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[13].spans == "" and out[9].spans == out[10].spans == ""
    assert all(out[i].spans == brute_spans(texts[i]) and out[i].n_email == 1 for i in range(8)) and len(out) == len(texts)
    assert pii.extract(docs(spark, []).limit(0)).count() == 0


# -- 4 lines


def test_boilerplate_lines(spark, monkeypatch):
    texts = [f"own {i}\n All rights \nkeep {i % 3}\n" for i in range(20)] + [None, "", "All rights", "twice\ntwice"]
    df = docs(spark, texts)
    want = [f"own {i}\nkeep {i % 3}\n" for i in range(20)] + [None, "", "", "twice\ntwice"]
    for bound in (linededup.BROADCAST_LINES, -1):
        monkeypatch.setattr(linededup, "BROADCAST_LINES", bound)
        out = linededup.remove(df, min_sites=10).orderBy("doc_id").collect()
        assert [r.text for r in out] == want and [r.n_removed for r in out] == [1] * 20 + [0, 0, 1, 0]
        assert out[0].key == "x" and out[20].n_lines == 0
    assert linededup.remove(df.withColumn("source", F.lit(None).cast("string")), 10).filter("n_removed > 0").count() == 0
    assert linededup.remove(df.limit(0), 10).count() == 0


# -- 5 packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_tokenizer(tokenizer):
    from tokenizers import Tokenizer

    encode, whole = packing.WordEncoder(tokenizer), Tokenizer.from_file(tokenizer)
    for text in ("", " a  b\n\nc", "a\x01b \x01 c", "don't I'VE <|endoftext|>x", "́abc ́x é z\x85q\x1cw", "a\tb \x00", "ΑΣ İI ß"):
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing(spark, tokenizer):
    from zlib import crc32

    from tokenizers import Tokenizer

    rng, whole = random.Random(5), Tokenizer.from_file(tokenizer)
    texts = ["alpha beta " * rng.randint(0, 200) for _ in range(120)] + [None, "", LONG]
    rows = packing.pack(docs(spark, texts).repartition(5), tokenizer, capacity=256).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = rows[rows.doc_id == i].sort_values("piece")
        assert mine.piece.tolist() == list(range(-(-len(ids) // 256))) and mine.length.sum() == len(ids)
        assert all(crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True))
    for _, mine in rows.sort_values("offset").groupby("sequence_id"):
        assert (mine.offset == mine.length.cumsum() - mine.length).all() and mine.length.sum() <= 256
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / 256 + 1
    assert packing.pack(docs(spark, texts).limit(0), tokenizer).count() == 0


# -- 6 benchmark


def test_containment_equals_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(words, k=rng.choice([3, 5, 8, 20, 40]))) for _ in range(12)] + [None, ""]
    texts = []
    for k in range(40):
        w = rng.choices(words, k=30)
        if k % 2:
            part = rng.choice(items[:12]).upper().split()
            cut = rng.choice([0, 0, 1, 3])
            w[10:10] = part[: len(part) - cut]
        texts.append("\n".join([" ".join(w[:15]), " ".join(w[15:])]))
    texts += [None, "", LONG, items[0], items[0]]
    split = lambda t: (t or "").lower().split()
    size = lambda t: min(5, len(split(t)))
    shingles = lambda w, k: set(zip(*(w[i:] for i in range(k)), strict=False))
    held = {(d, k): shingles(split(x), k) for d, x in enumerate(texts) for k in range(1, 6)}
    sought = {i: shingles(split(t), size(t)) for i, t in enumerate(items) if size(t)}
    want = {(d, i) for i, s in sought.items() for d in range(len(texts)) if len(s & held[d, size(items[i])]) / len(s) >= 0.8}
    assert any(0 < size(items[i]) < 5 and len(split(texts[d])) > 5 for d, i in want)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("item", F.lit(1))
    got = decontamination.contained(docs(spark, texts, item=3, gram="x"), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want
    kept = decontamination.clean(docs(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.contained(docs(spark, texts), bench.limit(0)).count() == 0


# -- 7 toxicity


def test_toxicity(spark):
    rng = random.Random(7)
    plain = ["".join(rng.choices(["ra", "to", "len", "mi", "sud"], k=rng.randint(1, 4))) for _ in range(400)]
    bad = ["grubble", "snarkfoo", "vexxa"]
    make = lambda toxic: " ".join(w for w in rng.choices(plain, k=40)) + (" " + rng.choice(bad) + " " + rng.choice(plain) if toxic else "")
    labels = [i % 4 == 0 for i in range(600)]
    texts = [make(t) for t in labels]
    model = toxicity.fit(texts[:400], [int(t) for t in labels[:400]])
    assert all(w in model["dictionaries"][0] for w in (b"grubble", b"snarkfoo", b"vexxa"))
    odd = [None, "", LONG]
    out = {r.doc_id: r for r in toxicity.score(docs(spark, texts[400:] + odd), model).collect()}
    assert sum(out[i].predicted == int(t) for i, t in enumerate(labels[400:])) >= 195
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == (r.predicted == 1) for r in out.values()) and out[200].predicted == 0
    assert toxicity.keep_ordinary(docs(spark, texts[400:] + odd), model).count() == sum(1 - r.predicted for r in out.values())
    assert toxicity.fit([], [])["weights"][0] < 0


# -- 8 neighbours


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[300:340] = x[300]  # a group of equal vectors
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(700, None, 1), (720, [0.0] * 8, 1), (740, [float("nan")] * 8, 1), (760, [1.0] * 7 + [None], 1), (780, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    report = {}
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20, target=1.0, report=report).toPandas()
    exact = x.astype(float) @ x.astype(float).T
    hits = 0
    for q in range(0, 600, 20):
        order = [i for i in np.lexsort((np.arange(600), -exact[q])) if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine.vec_id)
        assert np.allclose(mine.score, exact[q][mine.vec_id.to_numpy()], rtol=1e-12, atol=1e-12)
        hits += len(set(order) & set(mine.vec_id))
    assert set(got.query_id) == set(range(0, 600, 20)) and hits >= 0.99 * 600 and report["recall"] == 1.0
    few = ann.search(df.filter("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4 and ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


# -- 9 language model


def test_elias_fano():
    rng = np.random.default_rng(9)
    for values in ([], [0], [5], [0, 0, 0, 7, 7, 10**6], np.sort(rng.integers(0, 10**9, 3000)), np.sort(rng.integers(0, 50, 3000))):
        coded = ngram.EliasFano(ngram.EliasFano.encode(np.array(values, np.int64)))
        assert coded.get(np.arange(len(values))).tolist() == list(values)


def test_language_model(spark):
    rng = random.Random(9)
    words = [f"w{min(i, j)}" for i in range(12) for j in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(150)] + [None, "", "  \n ", texts_repeat := "w1 w2 w1 w2 w3", texts_repeat]
    model = ngram.train(docs(spark, texts), order=3)
    got = {r.doc_id: r for r in ngram.score(docs(spark, [*texts, "W1 unseen w2"]), model).collect()}
    seqs = [ngram.tokens(t) for t in texts]
    grams = [Counter(tuple(s[i : i + n]) for s in seqs for i in range(len(s) - n + 1)) for n in (1, 2, 3)]
    kept = [grams[0], {g: c for g, c in grams[1].items() if c >= 2}]
    kept.append({g: c for g, c in grams[2].items() if c >= 2 and g[:2] in kept[1]})
    total, types = sum(grams[0].values()), len(grams[0])

    def p(n, g):
        if n == 1:
            return (grams[0][g] + 0.5) / (total + 0.5 * (types + 1))
        context = g[:-1]
        if context not in kept[n - 2] or n > 2 and len(context) < n - 1:
            return p(n - 1, g[1:])
        mass = sum(c - 0.75 for h, c in kept[n - 1].items() if h[:-1] == context)
        return max(0, kept[n - 1].get(g, 0) - 0.75) / grams[n - 2][context] + (1 - mass / grams[n - 2][context]) * p(n - 1, g[1:])

    for i, text in enumerate([*texts, "W1 unseen w2"]):
        s = ngram.tokens(text)
        base = sum(math.log10(p(1, (w,))) for w in s)
        whole = sum(math.log10(p(min(3, j + 1), tuple(s[max(0, j - 2) : j + 1]))) for j in range(len(s)))
        assert got[i].n_tokens == len(s) and got[i].n_known == sum((w,) in grams[0] for w in s)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(whole, rel=2e-3)
    nothing = ngram.train(docs(spark, []).limit(0))
    assert ngram.score(docs(spark, ["a b", None]), nothing).filter("n_known = 0").count() == 2


# -- 10 near copies


@pytest.mark.parametrize("block", [8192, 4])
def test_links_span_all_pairs(spark, block):
    rng = random.Random(10)
    fps = set()
    for _ in range(40):
        b = rng.getrandbits(64)
        for _ in range(6):
            fps.add(b)
            for _ in range(rng.randint(1, 4)):
                b ^= 1 << rng.randrange(64)
    values = np.array(sorted(fps), np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(v), 0, int(v)) for v in values], "node long, part int, fp long")
    roots = {r.node: r.root for r in graph.connected_components(simhash.links(df, 3, block)).collect()}
    near = [(int(a), int(b)) for i, a in enumerate(values) for b in values[:i] if ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() <= 3]
    assert near and all(roots[a] == roots[b] for a, b in near)
    parent = {int(v): int(v) for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[find(a)] = find(b)
    assert len({find(int(v)) for v in values}) == len(values) - len(roots) + len(set(roots.values()))


def test_near_duplicates_on_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text), (3, text), (3, text), (7, text.upper()), (1, None), (2, ""), (4, " \n"), (9, "two words"), (None, text), (11, LONG)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (7, 3), (1, 1), (2, 1), (4, 1), (9, 9), (None, 3), (11, 11)}
    kept = [r.doc_id for r in simhash.keep_one(df).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3, 9, 11] and kept.count(None) == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_near_copies_of_four_fifths_are_found(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=300)
        copy = list(words)
        for at in rng.sample(range(300), 4):
            copy[at] = rng.choice(vocabulary)
        texts += [" ".join(words), " ".join(copy)]
    kept = simhash.keep_one(docs(spark, texts))
    assert {r.doc_id % 2 for r in kept.collect()} == {0} or kept.count() <= 63
    assert kept.filter("doc_id % 2 = 0").count() == 60


def test_blocks_put_in_or_taken_out_at_four_fifths(spark):
    rng = random.Random(12)
    make = lambda k: [f"v{rng.randrange(5000)}" for _ in range(k)]
    texts, want = [], set()
    for i in range(120):
        words = make(300)
        copy, kind, at = list(words), i % 4, rng.randrange(60, 240)
        if kind == 0:
            copy[at - 22 : at + 23] = []  # 45 of 300 words out
        elif kind == 1:
            copy[at:at] = make(62)
        elif kind == 2:
            copy += make(68)
        else:
            for k in rng.sample(range(300), 7):  # below 0.8
                copy[k] = "x"
        pair = [similar.shingles(" ".join(w), 5) for w in (words, copy)]
        share = len(pair[0] & pair[1]) / len(pair[0] | pair[1])
        assert 0.8 <= share < 0.86 if kind < 3 else 0.75 < share < 0.8 or share >= 0.8, share
        if share >= 0.8:
            want.add(2 * i + 1)
        texts += [" ".join(words), " ".join(copy)]
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()}
    assert len(want) >= 90 and kept == set(range(240)) - want


def test_groups_equal_brute_force(spark):
    rng = random.Random(13)
    texts = [None, "", " ", "a b", "A  b", "b a"]
    for _ in range(60):
        words = [f"v{rng.randrange(300)}" for _ in range(rng.choice([3, 5, 9, 40, 120]))]
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(words))
            at = rng.randrange(len(words))
            words = words[:at] + words[at + rng.randint(0, len(words) // 9) :] if rng.random() < 0.6 else [*words, "more"]
    sets = [similar.shingles(t, 5) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.group_id for r in similar.similar_groups(docs(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) < len(got)
    assert similar.similar_groups(docs(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_all_copies_of_one_original_go(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(300)]
    texts = []
    for i in range(250):  # 0.85 to the original, below 0.8 to each other
        copy = list(words)
        for k in range(5):
            copy[60 * k + rng.randrange(5, 55)] = f"u{i}x{k}"
        texts.append(" ".join(copy))
    far = [" ".join([*words[:200], *(f"w{i}x{k}" for k in range(100))]) for i in range(40)]  # share a passage, no copies
    original = " ".join(words)
    for small in (similar.SMALL, 2):
        monkeypatch.setattr(similar, "SMALL", small)
        rows = [*texts, original, *far]
        rng.shuffle(rows)
        groups = {r.doc_id: r.group_id for r in similar.similar_groups(docs(spark, rows)).collect()}
        assert len({groups[i] for i, t in enumerate(rows) if t not in far}) == 1 and len(set(groups.values())) == 41


def test_hot_shingles_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(similar, "FEW_PAIRS", 0)  # so that leaders are taken in all rounds
    shared = [f"s{i}" for i in range(60)]
    texts = [" ".join([*shared[: rng.choice([20, 60])], *(f"w{i}x{k}" for k in range(rng.choice([2, 4, 10, 30])))]) for i in range(160)]
    texts += [" ".join([*shared, *(f"z{k}" for k in range(40)), *(f"y{i}x{k}" for k in range(rng.choice([4, 12])))]) for i in range(40)]
    sets = [similar.shingles(t, 5) for t in texts]
    edges = [(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if 5 * len(x & y) >= 4 * len(x | y)]
    want = {i: i for i in range(len(texts))}
    for _ in texts:
        before = dict(want)
        for i, j in edges:
            want[i] = want[j] = min(want[i], want[j])
        if want == before:
            break
    met = []
    told = similar._all_apart
    monkeypatch.setattr(similar, "_all_apart", lambda *a: met.append(1) or told(*a))
    for block in (25, similar.BLOCK):
        got = {r.doc_id: r.group_id for r in similar.similar_groups(docs(spark, texts), block=block).collect()}
        assert got == want and 1 < len(set(want.values())) < len(texts) and len(met) == 1


def test_a_shingle_of_all_texts_is_not_held():
    import tracemalloc

    rows, size, block = 50_000, 500, 2_000

    def batches():
        for at in range(0, rows, size):
            node = np.arange(at, at + size)
            place = np.full(size, 100, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, 7)), pa.array(node), pa.array(place), pa.array(node)], ["h", "node", "place", "root"])
        yield pa.RecordBatch.from_arrays([pa.array([7, 8, 8]), pa.array([rows, 1, 2]), pa.array([100, 100, 100]), pa.array([rows, 1, 2])], ["h", "node", "place", "root"])

    def run(limit):
        passed, pairs = 0, []
        for out in similar._meet(4, 5, False, limit)(batches()):
            passed += out.column("b").null_count
            b = np.asarray(out.column("b").fill_null(-1))
            pairs.append(np.stack([np.asarray(out.column("a")), b], axis=1)[b >= 0])
        return passed, len(np.concatenate(pairs)), tracemalloc.get_traced_memory()[1]

    run(block)  # what is imported on the way isn't counted
    tracemalloc.start()
    passed, pairs, peak = run(block)
    tracemalloc.reset_peak()
    _, led, held = run(rows + 2)  # as one group: each other row is paired with the leader
    tracemalloc.stop()
    assert passed == rows + 1 and pairs == 1 and led == rows + 1 and peak < 500_000 < held, (passed, pairs, led, peak, held)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (201, None)]
    roots = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(51)}) == 1 and len({roots[100 + i] for i in range(30)}) == 1 and roots[200] == 200 and 201 not in roots


def test_near_copies_are_linked_by_fingerprints_first(spark, monkeypatch):
    rng = random.Random(21)
    words = [[f"v{rng.randrange(5000)}" for _ in range(400)] for _ in range(12)]
    texts = [" ".join(w) for w in words] + [" ".join([*w, "more"]) for w in words] + ["", None]
    pairs = {(r.a, r.b) for r in simhash.near_pairs(docs(spark, texts).selectExpr("cast(doc_id as long) node", "text t")).collect()}
    bits = [simhash.simhash(t)[0] for t in texts]
    assert all(bin(bits[a] ^ bits[b]).count("1") <= 3 for a, b in pairs) and len(pairs & {(i, i + 12) for i in range(12)}) >= 6
    seen = []
    told = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda some, *a: seen.append({(r.a, r.b) for r in some.collect()}) or told(some, *a))
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()}
    assert kept == {*range(12), 24} and len(seen[0]) >= 6  # the fingerprints' pairs, before those of the shingles
    assert not seen[0] & set().union(*seen[1:])  # what they joined isn't compared again


def test_rows_that_no_other_can_be_like_are_not_passed_on():
    sizes = [1000, 1010, 500, 100, *range(2000, 2020)]
    rows = [pa.array(np.full(len(sizes), 7)), pa.array(np.arange(len(sizes))), pa.array(np.array(sizes, np.int64)), pa.array(np.arange(len(sizes)))]
    again = set()
    for out in similar._meet(4, 5, False, 1 << 16)(iter([pa.RecordBatch.from_arrays(rows, ["h", "node", "place", "root"])])):
        again |= {r["a"] for r in out.to_pylist() if r["b"] is None}
    assert again == set(range(4, 24))  # 1000 is the leader; 1010, 500 and 100 shingles are like no other number there
