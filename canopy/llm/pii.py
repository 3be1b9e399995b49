"""Personal data by bootstrapped contextual extraction.

Base rules find e-mail addresses, IP addresses, card and phone numbers: the seeds. The words around seeds are lexical
patterns; the same words stand around other tokens. Spark scores the graph of patterns and instances round by round: a
pattern is as good as the share of its distinct instances that are known to be of the kind, an instance as good as its
best pattern on the left and its best on the right together. Instances of high score are added to the seeds' spans.

A fifth kind, secret, has no base rule. Its seeds are a share of the long runs of hexadecimal digits, told by their
hashes; all the others are unknown tokens like any, and have to be found by the words around them, as keys of other
shapes have to be. Seeds, too, are added only where those words prove a pattern. So keys and tokens are found where
texts name them, and a checksum without such words is left alone. n_unseen counts additions that were no seeds.

What speaks against a pattern follows from the kind. A base kind's rule is complete on its own form, so any instance it
rejected counts against it; of secrets only some are known, so only what can't be one counts: a seed of another kind,
or a token without the looks of a key. What an instance may look like follows from its pattern: by a strong one, any
token with a digit or an @ is taken; by weaker ones, only tokens with the looks of the kind. A pattern grows strong by
what it finds, round by round. An instance is one token: what is written with blanks in it is found by base rules only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed order of the kinds: those of base rules, and what only the bootstrap finds.
KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = (*KINDS, "secret")
SECRET = 4
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits unless it begins with the run, so the look-behinds only save time.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^ \t-\r]+")
_DIGIT = re.compile(r"[0-9]")
#: Up to so many additions, counted first, are broadcast.
BROADCAST_SPANS = 300_000
#: A seed of a secret: hexadecimal digits, some of them letters and some not.
_HEX = re.compile(r"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")
_LONG_KEY = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=.-]{16,}")
#: Token edges that don't belong to an identifier.
_EDGE = ".,;:!?\"'()[]<>{}"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), leftmost and non-overlapping in each kind, in the order of the kinds and then of starts."""
    if not _ANY.search(text):
        return []
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def looks(token: str) -> list[int]:
    """The kinds that a token could be of."""
    digits = len(_DIGIT.findall(token))
    out = []
    if "@" in token and len(token) >= 5 or re.search(r"\w[\[({](?:at|AT)[\])}]\w", token):
        out.append(0)
    if re.fullmatch(r"[0-9]{1,3}(?:[.:\[\]()]+[0-9]{1,3}){3}", token) or token.count(":") >= 4 and re.fullmatch(r"[0-9A-Fa-f:]+", token):
        out.append(1)
    if 12 <= digits <= 19 and digits >= 0.75 * len(token):
        out.append(2)
    if 7 <= digits <= 15 and digits >= 0.6 * len(token) and not re.search(r"[A-Za-z@]", token):
        out.append(3)
    if _LONG_KEY.fullmatch(token):
        out.append(SECRET)
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, surface, seed kind or None, kinds it looks like, two words before, word before, word after) of seeds and candidates."""
    spans = sorted((s, e, k) for k, s, e in base)
    out, taken, tokens = [], 0, list(_TOKEN.finditer(text))

    def word(i: int) -> str:
        return (tokens[i][0].lower().strip(_EDGE) or tokens[i][0]) if 0 <= i < len(tokens) else ""

    for i, m in enumerate(tokens):
        while taken < len(spans) and spans[taken][1] <= m.start():
            taken += 1
        start, end, whole = m.start(), m.end(), m[0]
        inside, j = [], taken
        while j < len(spans) and spans[j][0] < end:
            inside += [spans[j]] if spans[j][1] > start else []
            j += 1
        if not inside and not _ANY.search(whole):
            continue
        before = word(i - 2) + " " + word(i - 1) if i > 1 else "", word(i - 1)
        secrets = list(_HEX.finditer(whole)) if len(whole) >= 32 else []
        for x in secrets:
            out.append((start + x.start(), start + x.end(), x[0].lower(), SECRET, [SECRET], *before, word(i + 1)))
        for s, e, k in inside:
            if s >= start:  # told at the token it begins in
                last = next((j for j in range(i, len(tokens)) if tokens[j].end() >= e), i)
                out.append((s, e, text[s:e].lower(), k, [k], *before, word(last + 1)))
        at = start
        for s, e, _ in [] if secrets else [*inside, (end, end, None)]:  # what no base span covers
            piece = text[at:s] if at < s else ""
            core, left = piece.strip(_EDGE), at + len(piece) - len(piece.lstrip(_EDGE))
            if len(core) >= 5 and _ANY.search(core):
                out.append((left, left + len(core), core.lower(), None, looks(core), *before, word(i + 1)))
            at = max(at, e)
    return out


SPANS = "array<struct<k:int,s:bigint,e:bigint>>"


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, base spans, mentions) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
        mention = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("surface", pa.string()), ("seed", pa.int32()), ("kinds", pa.list_(pa.int32())), ("two", pa.string()), ("before", pa.string()), ("after", pa.string())]))
        names = [f.name for f in mention.value_type]
        for batch in batches:
            base, around = [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                found = base_spans(text)
                base.append([{"k": k, "s": s, "e": e} for k, s, e in found])
                around.append([dict(zip(names, m, strict=True)) for m in mentions(text, found)] if _ANY.search(text) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, span), pa.array(around, mention)], [id_col, "key", "base", "mentions"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(id_col, F.struct(F.xxhash64(text_col).alias("a"), F.xxhash64(text_col, text_col).alias("b")).alias("key"), text_col)
    around = "array<struct<s:bigint,e:bigint,surface:string,seed:int,kinds:array<int>,two:string,before:string,after:string>>"
    return keyed.mapInArrow(run, f"`{id_col}` {kind}, key struct<a:bigint,b:bigint>, base {SPANS}, mentions {around}")


def bootstrap(seen: DataFrame, rounds: int = 3, confident: float = 0.8, strong: float = 0.95, least_seeds: int = 3, one_seed_in: int = 2) -> DataFrame:
    """(surface, kind, score, unseen) of the instances that high-confidence patterns find; unseen says that it was no seed.

    seen: (surface, seed, kinds, two, before, after). A pattern is the word before, the two words before, the word after,
    or the words before and after; it needs least_seeds distinct seeds of the kind. An instance's score is that of its
    best pattern on the left and its best with the word after alone, taken as independent; it has to
    reach confident. By a pattern of strong confidence an instance of any looks is found. Of the long hexadecimal runs
    one in one_seed_in is a seed of a secret, by the hash of its text, so the same ones whatever the table's order.
    """
    texts = [F.concat(F.lit(k), *c) for k, c in (("L ", ["before"]), ("T ", ["two"]), ("R ", ["after"]), ("B ", ["before", F.lit(" "), "after"]))]
    kept_back = (F.col("seed") == SECRET) & (F.pmod(F.xxhash64("surface"), F.lit(one_seed_in)) != 0)
    seen = seen.withColumn("seed", F.when(kept_back, F.lit(None)).otherwise(F.col("seed")))
    each = seen.select("surface", "seed", "kinds", F.explode(F.array(*texts)).alias("pattern")).filter("pattern not in ('L ', 'T ', 'R ', 'B  ')")
    edges = each.groupBy("pattern", "surface").agg(F.max("seed").alias("seed"), F.first("kinds").alias("kinds"))
    open_ = F.col("seed").isNull() | (F.col("seed") == SECRET)
    useful = edges.groupBy("pattern").agg(F.sum(F.col("seed").isNotNull().cast("int")).alias("seeds"), F.sum(open_.cast("int")).alias("open"))
    useful = useful.filter((F.col("seeds") >= least_seeds) & (F.col("open") > 0)).select("pattern")
    edges = materialize(edges.join(useful, "pattern", "left_semi"), "pii-edges")
    seeds = edges.filter("seed is not null").select("surface", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    found = seeds.limit(0).withColumn("unseen", F.lit(False))
    if edges.isEmpty():
        return found
    scores = seeds
    no_secret = F.coalesce(F.col("seed") != SECRET, ~F.array_contains("kinds", SECRET))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(no_secret).alias("against"))
    for _ in range(rounds):
        known = edges.select("pattern", "surface").join(scores, "surface")
        patterns = known.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.sum((F.col("score") == 1.0).cast("int")).alias("seeds"))
        patterns = patterns.filter(F.col("seeds") >= least_seeds).join(sizes, "pattern")
        weighed = F.when(F.col("kind") == SECRET, F.col("mass") + F.col("against")).otherwise(F.col("n"))
        patterns = patterns.select("pattern", "kind", (F.col("mass") / (weighed + 1)).alias("confidence")).filter(F.col("confidence") >= confident / 2)
        told = edges.filter(open_).join(patterns, "pattern").filter("seed is null or seed = kind")
        told = told.filter(F.array_contains("kinds", F.col("kind")) | (F.col("confidence") >= strong))
        right = F.col("pattern").startswith("R ")
        sides = told.groupBy("surface", "kind").agg(*(F.coalesce(F.max(F.when(x, F.col("confidence"))), F.lit(0.0)).alias(n) for x, n in ((~right, "a"), (right, "b"))))
        found = sides.select("surface", "kind", (1 - (1 - F.col("a")) * (1 - F.col("b"))).alias("score")).filter(F.col("score") >= confident)
        # One kind each: the surest, then the first as listed. What is found counts a little less than a seed.
        best = F.min_by("kind", F.struct(-F.col("score"), "kind"))
        found = materialize(found.groupBy("surface").agg(best.alias("kind"), F.max("score").alias("score")), "pii-found")
        fresh = found.join(seeds.select("surface"), "surface", "left_anti").select("surface", "kind", F.least("score", F.lit(0.99)).alias("score"))
        scores = materialize(seeds.unionByName(fresh), "pii-scores")
    known = seeds.select("surface", F.lit(False).alias("unseen"))
    return found.join(known, "surface", "left").withColumn("unseen", F.coalesce("unseen", F.lit(True)))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_more, n_unseen, n_spans) for each row, from its whole text.

    The four counts and the digest are of the base rules' spans; spans also has the n_more that the bootstrap adds, of
    the kinds as listed and secret after them; n_unseen of these were no seeds; n_spans counts all. An addition never lies within a base span. A null
    text counts as empty and has no spans; repeated rows are reported each, and their mentions count as one instance;
    long texts are read wholly; null ids stay; an empty table gives no rows; other columns aren't read.
    """
    rows = materialize(scan(docs, id_col, text_col), "pii-scan")
    flat = rows.select("key", F.explode("mentions").alias("m")).select("key", "m.*")
    found = materialize(bootstrap(flat.select("surface", "seed", "kinds", "two", "before", "after"), **options), "pii-instances")
    count = found.count()
    found = F.broadcast(found) if count <= BROADCAST_SPANS else found
    more = flat.filter(f"seed is null or seed = {SECRET}").join(found.select("surface", "kind", "unseen"), "surface").select("key", F.struct(F.col("kind").alias("k"), "s", "e", F.col("unseen").alias("u")).alias("x"))
    more = materialize(more.groupBy("key").agg(F.collect_set("x").alias("more")), "pii-more")
    # Few texts have additions; so equal texts, however many, needn't meet in one task. Beyond the bound Spark splits them.
    spans = more.agg(F.coalesce(F.sum(F.size("more")), F.lit(0))).first()[0]
    more = F.broadcast(more) if spans <= BROADCAST_SPANS else more
    none = F.array().cast(SPANS)
    unseen = F.coalesce(F.size(F.filter("more", lambda x: x["u"])), F.lit(0)).cast("long")
    plain = F.transform("more", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    told = rows.join(more, "key", "left").withColumn("n_unseen", unseen).withColumn("more", F.coalesce(plain, none)).withColumn("every", F.array_sort(F.concat("base", "more")))
    names = F.array(*[F.lit(k) for k in MORE_KINDS])
    told_of = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")

    def of_kind(spans: str, i: int):
        return F.size(F.filter(spans, lambda x: x["k"] == i)).cast("long").alias(f"n_{MORE_KINDS[i]}")

    counts = [of_kind("base", i) for i in range(len(KINDS))]
    sizes = [of_kind("more", SECRET), F.size("more").cast("long").alias("n_more"), F.col("n_unseen"), F.size("every").cast("long").alias("n_spans")]
    return told.select(id_col, *counts, F.sha2(told_of(F.col("base")), 256).alias("base_sha256"), told_of(F.col("every")).alias("spans"), *sizes)
