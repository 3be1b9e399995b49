"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text. Each window of a document's words is
compressed with the ordinary one, and with the toxic one before it; how many bytes the toxic one saves is the window's
distance, and a calibrated logistic curve over a document's distances is its score.

Only labels of whole documents are known, and most of a toxic document's words are as common elsewhere. So the toxic
dictionary is trained on what recurs in toxic documents and hardly stands in ordinary ones: of each, its words that few
ordinary documents have and several toxic ones, in several contexts (copies of one document are one context). A
dictionary trained on the whole toxic text would hold mostly ordinary words: what it and the ordinary one happen to
hold of those drowns the difference. Which pieces of words go into a dictionary, and where, is the trainer's choice.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_process

#: Bounds of the sample that the dictionaries and the curve are fitted on: rows a class, and characters a class.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 8_000_000
#: Words of a window, bytes of the toxic and of the ordinary dictionary.
WINDOW, TOXIC, ORDINARY = 14, 4096, 16_384
#: Windows of ordinary text that its dictionary is trained on.
ORDINARY_WINDOWS = 50_000
#: Distances of which the curve counts the windows that reach them.
STEPS = (2, 3, 4, 6, 9)


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The words of a text, lower-cased, size at a time; each window begins half a window after the one before."""
    words, step = text.lower().encode("utf-8", "surrogatepass").split(), (size + 1) // 2
    return [b" %b " % b" ".join(words[i : i + size]) for i in range(0, max(1, len(words) - size + step), step)] if words else []


class Distance:
    """Bytes that the toxic dictionary saves on a window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as zs

        rules = zs.ZstdCompressionParameters(
            compression_level=9, strategy=zs.STRATEGY_LAZY2, window_log=16, hash_log=16, chain_log=16, search_log=6, min_match=5, target_length=32,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )

        def compressor(content: bytes):
            dictionary = zs.ZstdCompressionDict(content or b" ", dict_type=zs.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=rules)
            return zs.ZstdCompressor(dict_data=dictionary, compression_params=rules).compress

        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic + ordinary)

    def __call__(self, parts: list[bytes]) -> list[int]:
        ordinary, toxic = self.ordinary, self.toxic
        return [len(ordinary(x)) - len(toxic(x)) for x in parts]


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on samples; of too few to train on, the samples themselves."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples, d=6, k=16, level=19).as_bytes()
    except (zs.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def train_dictionaries(toxic: list[str], ordinary: list[str], rare: float = 0.002, least: int = 3) -> tuple[bytes, bytes]:
    """The dictionaries of distinct toxic and distinct ordinary texts, which come in a fixed order.

    rare: the share of ordinary documents that may hold a word of the toxic samples. least: how many toxic documents,
    and how many words before it, such a word needs; one in fifty documents, if that is more.
    """
    plain = Counter(w for t in ordinary for w in set(windows(t, 1)))
    floor, least = rare * len(ordinary), max(least, len(toxic) // 50)
    held, seen, before = [], Counter(), defaultdict(set)
    for text in toxic:
        words = windows(text, 1)
        mine = {w: None for w in words if plain[w] <= floor}
        seen.update(list(mine))
        for last, word in zip([b"", *words], words, strict=False):
            if word in mine and len(before[word]) < least:
                before[word].add(last)
        held.append(mine)
    samples = [b" ".join(w.strip() for w in mine if seen[w] >= least and len(before[w]) >= least) for mine in held]
    every = [x for t in ordinary for x in windows(t)]
    some = sorted(every, key=zlib.crc32)[:ORDINARY_WINDOWS]
    # With blanks, for the trainer leaves out samples of under 8 bytes and the last ones of each.
    return _trained([b" %b         " % x for x in samples if x], TOXIC), _trained(some, ORDINARY)


def features(saved: list[int]) -> list[float]:
    """What the curve sees of a document's distances."""
    above = sum(s for s in saved if s > 1)
    return [1.0, *(np.log1p(sum(s >= k for s in saved)) for k in STEPS), max(saved, default=0) / 8, np.log1p(above) / 2, above / (1 + len(saved))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int], folds: int = 4) -> dict:
    """A model from labelled texts. The curve and its threshold are calibrated on texts that their dictionaries haven't seen."""
    texts, labels = [t or "" for t in texts], np.array(labels, float)
    first = {t: i for i, t in reversed(list(enumerate(texts)))}  # copies count once and stay in one fold
    fold = {t: zlib.crc32(t.encode("utf-8", "surrogatepass")) % folds for t in first}

    def split(out: int | None) -> tuple[list[str], list[str]]:
        return tuple(sorted({t for t, v in zip(texts, labels, strict=True) if v == y and fold[t] != out}) for y in (1, 0))

    if len(set(labels)) == 2:
        rows, target = [], []
        for part in range(folds):
            distance = Distance(*train_dictionaries(*split(part)))
            for t, i in first.items():
                if fold[t] == part:
                    rows.append(features(distance(windows(t))))
                    target.append(labels[i])
        x, y = np.array(rows), np.array(target)
        w = _logistic(x, y)
        logits = x @ w
        cuts = np.unique(np.quantile(logits, np.linspace(0.3, 1, 400)))
        f1 = [2 * ((logits >= c) & (y == 1)).sum() / max(1, (logits >= c).sum() + y.sum()) for c in cuts]
        best = int(np.argmax(f1))
        lower = logits[logits < cuts[best]].max(initial=cuts[best] - 1)
        w[0] -= (cuts[best] + lower) / 2
    else:  # nothing to tell apart
        w = np.zeros(len(features([])))
        w[0] = 3.0 if len(labels) and labels.mean() == 1 else -3.0
    return {"dictionaries": train_dictionaries(*split(None)), "weights": w.tolist()}


def fit_on(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Fit on a bounded sample of the labelled rows: of each class those of the smallest id hash, up to rows and chars.

    Labels that are null or neither 0 nor 1, without an id, or without a document teach nothing; a repeated label counts
    once, an id with both labels in both classes, null texts as empty. Where too few fragments recur in toxic texts for
    zstandard to train on, they are the dictionary as they are. Of an empty table nothing is learned, and nothing is
    rejected then.
    """
    named = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    marks = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).filter("k is not null and y in (0, 1)")
    texts, values = [], []
    for y in (0, 1):
        picked = marks.filter(F.col("y") == y).select("k").distinct().join(named.select("k").distinct(), "k", "left_semi")
        picked = picked.orderBy(F.xxhash64("k"), "k").limit(rows)
        took = 0
        for row in named.join(picked, "k").orderBy(F.xxhash64("k"), "k").toLocalIterator():
            if took + len(row["t"]) > chars:
                continue
            took += len(row["t"])
            texts.append(row["t"])
            values.append(y)
    return fit(texts, values)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, n_windows, worst) for each row: the whole text, every window of it.

    worst is the largest distance of a window. Null and empty texts have no window and get the score of that. Repeated
    rows are scored each; other columns aren't read; an empty table gives no rows.
    """
    key = zlib.crc32(repr(model).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = per_process("toxicity", key, lambda: Distance(*model["dictionaries"]))
        weights = np.array(model["weights"])
        for batch in batches:
            scores, counts, worst = [], [], []
            for text in batch.column(1):
                saved = distance(windows(text.as_py() or ""))
                scores.append(1 / (1 + np.exp(-np.clip(np.dot(features(saved), weights), -30, 30))))
                counts.append(len(saved))
                worst.append(max(saved, default=0))
            scores = np.array(scores, float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(counts, pa.int64()), pa.array(worst, pa.int32())],
                [id_col, "score", "predicted", "n_windows", "worst"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, n_windows long, worst int")


def keep_ordinary(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic; all columns as they are, scored where they are read.

    Null and empty texts have no window and are judged by that, like all texts of no distance: they stay, unless the
    model saw toxic labels only. Repeated rows are judged each; long texts wholly; an empty table gives no rows.
    """
    key, at = zlib.crc32(repr(model).encode()), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = per_process("toxicity", key, lambda: Distance(*model["dictionaries"]))
        weights = np.array(model["weights"])
        for batch in batches:
            keep = []
            for text in batch.column(at):
                keep.append(float(np.dot(features(distance(windows(text.as_py() or ""))), weights)) < 0)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
