"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed character 2- and 3-grams. Each language has several centroids, from
spherical k-means over a bounded sample of its documents; a text gets the language of the centroid of the largest
cosine. A text farther from every centroid than the sample's own texts ever are is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed n-grams.
DIM = 1 << 14
#: Bounds of the sample the centroids are fitted on: documents and characters a language, and languages.
SAMPLE_ROWS, SAMPLE_CHARS, LANGUAGES = 500, 3_000_000, 500
_LETTER = re.compile(r"[^\W\d_]")
#: Characters counted at a time, so that memory doesn't grow with a text.
CHUNK = 1 << 20


def _classes() -> np.ndarray:
    """Code points to symbols: letters stay, everything else below U+0250 is one blank."""
    table = np.arange(0x250, dtype=np.uint64)
    for c in range(0x250):
        if not chr(c).isalpha():
            table[c] = 32
    return table


_TABLE = _classes()


def grams(text: str) -> np.ndarray:
    """How often each bucket occurs in a text."""
    counts = np.zeros(DIM, np.int64)
    for at in range(0, max(1, len(text)), CHUNK):
        piece = " " + text[max(0, at - 2) : at + CHUNK].lower() + " "
        raw = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = raw < 0x250
        a = _TABLE[np.where(low, raw, 0)]
        a[~low] = raw[~low]
        blank = a == 32
        keep = ~(blank[1:] & blank[:-1])  # runs of blanks count once
        a = np.concatenate((a[:1], a[1:][keep]))
        two = a[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ a[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] * np.uint64(0x165667B19E3779F9) ^ a[2:] * np.uint64(0x27D4EB2F165667C5)
        for h in (two, three):
            counts += np.bincount(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64), minlength=DIM)
    return counts


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = grams(text)
    at = np.flatnonzero(counts)
    v = np.log1p(counts[at]) * idf[at]
    return at, v / (np.sqrt(v @ v) or 1.0)


def fit(texts: list[str], langs: list[str], clusters: int = 4, seed: int = 7) -> dict:
    """Centroids, inverse document frequencies and rejection bounds from labelled texts."""
    seen = np.zeros(DIM)
    for t in texts:
        seen += grams(t) > 0
    idf = np.log((1 + len(texts)) / (1 + seen)) + 0.1
    centroids, names, bounds = [], [], []
    for lang in sorted(set(langs)):
        rows = np.zeros((langs.count(lang), DIM), np.float32)
        for row, t in zip(rows, (t for t, g in zip(texts, langs, strict=True) if g == lang), strict=True):
            at, v = _vector(t, idf)
            row[at] = v
        k = min(clusters, len(rows))
        rng = np.random.default_rng(seed)
        centre = rows[rng.choice(len(rows), k, replace=False)].copy()
        for _ in range(12):
            best = (rows @ centre.T).argmax(1)
            for c in range(k):
                if (best == c).any():
                    centre[c] = rows[best == c].mean(0)
                    centre[c] /= np.linalg.norm(centre[c]) or 1.0
        nearest = (rows @ centre.T).max(1)
        centroids.append(centre)
        names += [lang] * k
        bounds += [float(np.quantile(nearest, 0.002)) * 0.7] * k
    return {"idf": idf, "centroids": np.concatenate(centroids) if centroids else np.zeros((0, DIM), np.float32), "langs": names, "bounds": bounds}


def fit_on(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> dict:
    """Fit on a bounded sample of the rows that have a language: those of the smallest id hash, about `rows` a language.

    Rows without a language, an id or a letter teach nothing; rows of one id are taken together or not at all. Of an empty table
    nothing is learned: every text is `und` then.
    """
    named = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in docs.filter(F.col(lang_col).isNotNull()).groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES).collect()}
    if not sizes:
        return fit([], [], **options)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1_000_000, int(1_100_000 * rows / n) + 1))])
    picked = named.filter(F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1_000_000)) < share[F.col(lang_col)])
    texts, langs, took = [], [], {}
    order = F.xxhash64(id_col, F.lit("sample"))
    for row in picked.orderBy(order, id_col, F.xxhash64(text_col)).select(F.col(text_col).alias("t"), F.col(lang_col).alias("g")).toLocalIterator():
        n, c = took.get(row.g, (0, 0))
        if n < rows and c + len(row.t) <= chars:
            took[row.g] = n + 1, c + len(row.t)
            texts.append(row.t)
            langs.append(row.g)
    return fit(texts, langs, **options)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for each row, from its whole text.

    A null text or one without a letter is `und` with score 0, as is every text if nothing was learned. score is the
    cosine with the nearest centroid. rejected marks texts beyond every centroid's bound; lang_pred still names the
    nearest. Ties go to the first language by name. Repeated rows are predicted each, long texts wholly; an empty table
    gives no rows; other columns aren't read.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on DIM, clusters and LANGUAGES only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        table, langs = np.ascontiguousarray(m["centroids"].T), m["langs"]
        bounds = np.array(m["bounds"])
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py()
                if not langs or not text or not _LETTER.search(text):
                    out.append(("und", 0.0, False))
                    continue
                at, v = _vector(text, m["idf"])
                cosines = v @ table[at]
                best = int(cosines.argmax())
                out.append((langs[best], float(min(1.0, max(0.0, cosines[best]))), bool((cosines < bounds).all())))
            lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [id_col, "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
