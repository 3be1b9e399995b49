"""N-gram language model in an Elias-Fano trie.

Level 1 is the vocabulary: sorted 64-bit word hashes with exact counts; a word's number is its rank. Each further level
holds the n-grams kept, ordered by context and word: Elias-Fano coded monotone pointers give the range of a context's
successors, and within it the word is found by binary search. A node is a word number and a quantised discounted
probability; beside the pointer of a context stands its quantised weight for the shorter context. All levels are flat
files, memory-mapped, in shards by key range.

Texts are cut into words once, and written as word numbers; all later passes read those. What a task counts goes on as
blocks of sorted keys, one for each range of the level, so a shuffle moves few large rows; each range is merged,
pruned and written by one task. Ranges are cut at quantiles of a sample of keys, and a context may span several, so a
context that a third of all tokens have does no harm. The driver sees one row a shard.

Smoothing is interpolated absolute discounting down to the add-half unigram: p(w|c) = max(n(cw) - D, 0) / n(c) + g(c) p(w|shorter c),
where g(c) is what the kept n-grams leave, so that each context's probabilities sum to 1.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_path, materialize, new_path, per_process, tidy_shuffles

#: The end of a text; no word can be a line feed.
END = b"\n"
#: Tokens cut out at a time, tokens counted or looked up at a time, keys in a block that is sent.
BLOCK, CHUNK, SENT = 1 << 17, 1 << 20, 1 << 16
#: Tokens for each range of a level, and tokens looked at to cut the ranges.
RANGE, SAMPLE = 4_000_000, 1_000_000
STEP = 2048.0


def quantise(x: np.ndarray) -> np.ndarray:
    """Positive numbers up to 1 as 16-bit steps of their logarithm."""
    with np.errstate(divide="ignore"):
        return np.clip(np.round(-np.log2(x) * STEP), 0, 65535).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return np.exp2(-code.astype(np.float64) / STEP) * (code != 65535)


def _select_table() -> np.ndarray:
    table = np.zeros((256, 8), np.uint8)
    for byte in range(256):
        ones = [i for i in range(8) if byte >> i & 1]
        table[byte, : len(ones)] = ones
    return table


_SELECT = _select_table()


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary; any element is read without decoding others."""

    def __init__(self, arrays: dict):
        self.bits, self.low, self.high, self.ones = int(arrays["bits"][0]), arrays["low"], arrays["high"], arrays["ones"]

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        values = np.asarray(values, np.uint64)
        n, top = max(1, len(values)), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(len(values))
        unary = np.zeros((int(high[-1]) if len(high) else 0) // 64 * 64 + 64, np.uint8)
        unary[high] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        each = (values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).reshape(-1) if bits else np.zeros(0, np.uint8)
        low = np.packbits(np.concatenate((each, np.zeros(-len(each) % 64 + 64, np.uint8))), bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        return {"bits": np.array([bits]), "low": low, "high": high, "ones": ones}

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        left = i - self.ones[word]
        octets = np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        byte = (upto <= left[:, None]).sum(1)
        rows = np.arange(len(i))
        left = left - np.where(byte > 0, upto[rows, np.maximum(byte - 1, 0)], 0)
        place = word * 64 + byte * 8 + _SELECT[octets[rows, byte], left]
        value = (place - i) << self.bits
        if self.bits:
            at = i * self.bits
            w, shift = at >> 6, (at & 63).astype(np.uint64)
            first = self.low[w] >> shift
            rest = np.where(shift > 0, self.low[w + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            value = value | ((first | rest) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return value


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One flat file, written under another name and then renamed, so that a task that runs twice does no harm."""
    head, at, body = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = (a.dtype.str, len(a), at)
        body.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        at += len(body[-1])
    raw = json.dumps(head).encode()
    raw += b" " * (-len(raw) % 8)
    raw = struct.pack("<Q", len(raw)) + raw
    local = local_path(path)
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with open(f"{local}.{uuid.uuid4().hex}", "wb") as f:
        f.write(raw)
        f.writelines(body)
    os.replace(f.name, local)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    raw = np.memmap(local_path(path), np.uint8, "r")
    size = struct.unpack("<Q", raw[:8].tobytes())[0]
    head = json.loads(raw[8 : 8 + size].tobytes())
    return {k: raw[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in head.items()}


class Numbers:
    """Whole numbers below 2^32 as low 16 bits and as few high bits as they need."""

    def __init__(self, arrays: dict, name: str):
        self.low, self.high = arrays[f"{name}.low"], arrays[f"{name}.high"]

    @staticmethod
    def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        high = values >> 16
        return {f"{name}.low": values.astype(np.uint16), f"{name}.high": high.astype(np.uint8 if high.max(initial=0) < 256 else np.uint16)}

    def __getitem__(self, i) -> np.ndarray:
        return self.high[i].astype(np.int64) << 16 | self.low[i]


class Counts:
    """Counts as bytes; those over 254 apart."""

    def __init__(self, arrays: dict):
        self.n, self.at, self.more = arrays["n"], arrays["n.at"], arrays["n.more"]

    @staticmethod
    def encode(n: np.ndarray) -> dict[str, np.ndarray]:
        at = np.flatnonzero(n > 254)
        return {"n": np.minimum(n, 255).astype(np.uint8), "n.at": at, "n.more": n[at]}

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        out = self.n[i].astype(np.int64)
        large = np.flatnonzero(out == 255)
        out[large] = self.more[np.searchsorted(self.at, i[large])]
        return out


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


class Level:
    """The shards of a level: their first keys, the rank of their first node, and their files, mapped when needed.

    Above level 1 a key is (context, word), and spans has the weights of the contexts that shards begin with.
    """

    def __init__(self, about: dict):
        self.shards, self.open = about["shards"], {}
        first = [s["first"] for s in self.shards]
        self.context = np.array([f[0] for f in first], np.int64 if about["spans"] is not None else np.uint64)
        self.word = np.array([f[1] for f in first], np.int64)
        self.start = np.array([s["start"] for s in self.shards], np.int64)
        spans = about["spans"] or []
        self.span, self.span_g = np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.uint16)

    def file(self, k: int, more: str = "") -> dict:
        if (k, more) not in self.open:
            arrays = load(self.shards[k]["path"] + more)
            if "ptr.bits" in arrays:
                arrays["ptr"] = EliasFano({n[4:]: a for n, a in arrays.items() if n.startswith("ptr.")})
                arrays["words"] = Numbers(arrays, "words")
            if "n.at" in arrays:
                arrays["n"] = Counts(arrays)
            self.open[k, more] = arrays
        return self.open[k, more]

    @staticmethod
    def _slices(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The shards of sorted keys, each with its stretch."""
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])).tolist()
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                yield int(shard[i]), slice(i, j)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each of sorted hashes, -1 if it isn't there; of level 1."""
        out = np.full(len(hashes), -1, np.int64)
        for k, part in self._slices(np.searchsorted(self.context, hashes, side="right") - 1):
            if k >= 0:
                keys = self.file(k)["keys"]
                at = np.minimum(np.searchsorted(keys, hashes[part]), len(keys) - 1)
                out[part] = np.where(keys[at] == hashes[part], self.start[k] + at, -1)
        return out

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rank (-1 if it isn't there) and probability of each of sorted (context, word), and the weight of its context."""
        out, p, g = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.full(len(context), 65535, np.uint16)
        shard = np.searchsorted(self.context, context, side="right") - 1
        while len(back := np.flatnonzero((shard >= 0) & (self.context[shard] == context) & (self.word[shard] > word))):
            shard[back] -= 1  # a context may span several shards
        lone = np.ones(len(context), bool)  # the context has no successor: its weight is 1
        for k, part in self._slices(shard):
            if k < 0:
                continue
            a, first = self.file(k), int(self.context[k])
            c, w, words = context[part] - first, word[part], a["words"]
            new = np.concatenate(([True], c[1:] != c[:-1]))
            own = c[new]
            inside = own < self.shards[k]["contexts"]
            low = np.zeros((2, len(own)), np.int64)
            ends = np.concatenate((own[inside], own[inside] + 1))
            low[:, inside] = a["ptr"].get(ends).reshape(2, -1)
            weight = np.zeros(len(own), np.uint16)
            weight[inside] = a["g"][own[inside]]
            each = np.cumsum(new) - 1
            g[part], lone[part] = weight[each], ~(low[1] > low[0])[each]
            low, high = low[0][each], low[1][each]
            # Context-relative successor search; what is settled takes no further part.
            todo = np.flatnonzero(low < high)
            at, end, want = low[todo], high[todo], w[todo]
            stop = end
            while len(todo):
                mid = (at + end) >> 1
                less = words[mid] < want
                at, end = np.where(less, mid + 1, at), np.where(less, end, mid)
                done = at >= end
                if done.any():
                    hit = done & (at < stop)
                    hit[hit] = words[at[hit]] == want[hit]
                    rows = todo[hit] + part.start
                    out[rows], p[rows] = self.start[k] + at[hit], restore(a["p"][at[hit]])
                    go = ~done
                    todo, at, end, want, stop = todo[go], at[go], end[go], want[go], stop[go]
        if len(self.span):
            at = np.minimum(np.searchsorted(self.span, context), len(self.span) - 1)
            met = self.span[at] == context
            g[met], lone[met] = self.span_g[at[met]], False
        return out, p, np.where(lone, 1.0, restore(g))

    def counts(self, ranks: np.ndarray, more: str = "") -> np.ndarray:
        """How often the nodes of sorted ranks (none of them -1) occur."""
        out = np.zeros(len(ranks), np.int64)
        for k, part in self._slices(np.searchsorted(self.start, ranks, side="right") - 1):
            out[part] = self.file(k, more)["n"][ranks[part] - self.start[k]]
        return out


def _pairs(context: np.ndarray, word: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (context, word), sorted, and where each row's is (if back) or how often each is there."""
    bits = max(1, int(word.max(initial=0)).bit_length())
    known = None
    if int(context.max(initial=0)).bit_length() + bits > 63:  # too long for one number
        known, context = np.unique(context, return_inverse=True)
    keys, more = np.unique(context << bits | word, return_inverse=back, return_counts=not back)
    context, word = keys >> bits, keys & ((1 << bits) - 1)
    return context if known is None else known[context], word, more


class Model:
    def __init__(self, about: dict):
        self.about, self.levels = about, [Level(a) for a in about["levels"]]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for unknown words."""
        keys, back = np.unique(hashes, return_inverse=True)
        return self.levels[0].words(keys)[back]

    def unigrams(self, words: np.ndarray) -> np.ndarray:
        """The count of each word, 0 for unknown ones."""
        keys, back = np.unique(words, return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        out[keys >= 0] = self.levels[0].counts(keys[keys >= 0])
        return out[back]

    def step(self, level: int, context: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank and probability of each (context rank, word number), and the weight of the context; either may be -1."""
        node, p, g = np.full(len(words), -1, np.int64), np.zeros(len(words)), np.ones(len(words))
        there = np.flatnonzero(context >= 0)
        if len(there):
            c, w, back = _pairs(context[there], words[there] + 1, True)  # an unknown word is 0 here
            found = self.levels[level].find(c, w - 1)
            node[there], p[there], g[there] = (x[back] for x in found)
        return node, p, g


def _before(ranks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The rank at the token before, -1 at the first token of a text."""
    out = np.empty_like(ranks)
    out[:1], out[1:] = -1, ranks[:-1]
    out[first] = -1
    return out


def _hashed(texts: Iterator) -> Iterator[tuple[list[int], np.ndarray]]:
    """The lengths of texts and the hashes of all their tokens, about CHUNK tokens at a time; few tokens are objects at once."""
    from xxhash import xxh64_intdigest

    lengths, parts, some, held = [], [], [], 0
    for text in texts:
        words = tokens(text)
        lengths.append(len(words))
        some += words
        if len(some) >= BLOCK:
            parts.append(np.fromiter(map(xxh64_intdigest, some), np.uint64, len(some)))
            held, some = held + len(some), []
            if held >= CHUNK:
                yield lengths, np.concatenate(parts)
                lengths, parts, held = [], [], 0
    if some:
        parts.append(np.fromiter(map(xxh64_intdigest, some), np.uint64, len(some)))
    if parts:
        yield lengths, np.concatenate(parts)


def _width(about: dict) -> int:
    """Bytes of a word number."""
    return -(-int(about["types"]).bit_length() // 8) or 1


def _numbered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, lengths and word numbers of rows (id, words), about CHUNK tokens at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(1)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // width
        every = np.frombuffer(column.buffers()[2], np.uint8)
        cuts = (np.flatnonzero(np.diff((ends[1:] - ends[0]) // CHUNK)) + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, len(column)], strict=True):
            octets = every[width * ends[i] : width * ends[j]].reshape(-1, width).astype(np.int64)
            yield batch.column(0)[i:j], np.diff(ends[i : j + 1]), sum(octets[:, k] << 8 * k for k in range(width)) - 1


def _firsts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate(([0], lengths[:-1])))


def _model(about: dict) -> Model:
    """The model in this worker."""
    return per_process("ngram", about["id"], lambda: Model(about))


SENT_ROWS = "part int, context binary, word binary, n binary"


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes: those that are zero throughout cost nothing once they are compressed."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _plain(raw, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _sent(part: int, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), SENT):
        c = context[at : at + SENT].astype(np.uint64)
        rows = [[_planes(x)] for x in (np.diff(c, prepend=np.uint64(0)), word[at : at + SENT].astype(np.uint32), n[at : at + SENT].astype(np.uint32))]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array(r, pa.binary()) for r in rows)], ["part", "context", "word", "n"])


def _merged(batches: Iterator[pa.RecordBatch], kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of one part as sorted distinct keys and their sums."""
    columns: list[list] = [[], [], []]
    for batch in batches:
        columns[0] += [np.cumsum(_plain(x.as_buffer(), np.uint64), dtype=np.uint64).astype(kind) for x in batch.column(1)]
        for k in (1, 2):
            columns[k] += [_plain(x.as_buffer(), np.uint32) for x in batch.column(k + 1)]
    if not columns[0]:
        return (np.zeros(0, kind),) * 3
    context, word, n = (np.concatenate(c) for c in columns)
    word, n = word.astype(np.int64), n.astype(np.int64)
    if kind == np.uint64:  # level 1: the hash is all of the key
        order = np.argsort(context)
    else:
        bits = max(1, int(word.max(initial=0)).bit_length())
        short = int(context.max(initial=0) - context.min(initial=0)).bit_length() + bits <= 63
        order = np.argsort((context - context.min(initial=0)) << bits | word) if short else np.lexsort((word, context))
    context, word, n = context[order], word[order], n[order]
    new = np.concatenate(([True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])))
    return context[new], word[new], np.add.reduceat(n, np.flatnonzero(new))


def _shards(sent: DataFrame, parts: int, write) -> list[dict]:
    """Merge and write each part of the blocks; one small row a shard comes back, in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = write(batches)
        if about:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(about)])], ["about"])

    dealt = sent.repartitionById(parts, F.col("part"))
    with tidy_shuffles(sent.sparkSession):
        shards = sorted((json.loads(r.about) for r in dealt.mapInArrow(run, "about string").collect()), key=lambda s: s["first"])
    start = 0
    for s in shards:
        s["start"] = start
        start += s["n"]
    return shards


def vocabulary(texts: DataFrame, text_col: str = "text", parts: int | None = None) -> dict:
    """A model of level 1 alone: all words of all texts, which it counts; null texts count as empty."""
    folder = new_path(texts.sparkSession, "ngram")
    if local_path(folder) is None:
        raise ValueError("the shared folder must be a mounted path, for the levels are memory-mapped")
    texts = texts.select(text_col)
    parts = parts or max(1, texts.rdd.getNumPartitions() // 2)
    cuts = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes in _hashed(t.as_py() for b in batches for t in b.column(0)):
            keys, n = np.unique(hashes, return_counts=True)
            ends = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
            for k in range(parts):
                i, j = ends[k], ends[k + 1]
                yield from _sent(k, keys[i:j], np.zeros(j - i), n[i:j])

    def write(batches: Iterator[pa.RecordBatch]) -> dict | None:
        keys, _, n = _merged(batches, np.uint64)
        if not len(keys):
            return None
        save(path := f"{folder}/1/{int(keys[0]):016x}", {"keys": keys, "n": n})
        return {"path": path, "first": [int(keys[0]), 0], "n": len(keys), "tokens": int(n.sum())}

    shards = _shards(texts.mapInArrow(count, SENT_ROWS), parts, write)
    types = sum(s["n"] for s in shards)
    if types >= (1 << 32) - 1:
        raise ValueError("word numbers have 32 bits")
    return {"id": uuid.uuid4().hex, "folder": folder, "order": 1, "types": types, "tokens": sum(s["tokens"] for s in shards), "levels": [{"shards": shards, "spans": None}]}


def number(docs: DataFrame, about: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words) of each row: the word numbers of its whole text and its end, from 1, each as few bytes; 0 is an unknown word.

    A null or empty text is its end alone; repeated rows and rows with a null id are numbered each; an empty table gives
    no rows; other columns aren't read.
    """
    width = _width(about)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids = _model(about), []

        def texts() -> Iterator:
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids.append(i)
                    yield t.as_py()

        for lengths, hashes in _hashed(texts()):
            ends = pa.array(width * np.cumsum([0, *lengths]), pa.int32())
            words = (model.numbers(hashes) + 1).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
            column = pa.Array.from_buffers(pa.binary(), len(lengths), [None, ends.buffers()[1], pa.py_buffer(words.tobytes())])
            rows, ids[: len(lengths)] = ids[: len(lengths)], []
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(rows[at : at + 1000], pa.int64()), column[at : at + 1000]], [id_col, "words"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"`{id_col}` long, words binary")


def _level_keys(model: Model, lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context rank, word) of the next level at each token that has a context."""
    first, rank = _firsts(lengths), words
    for level in range(1, len(model.levels)):
        rank = model.step(level, _before(rank, first), words)[0]
    before = _before(rank, first)
    there = np.flatnonzero((before >= 0) & (words >= 0))
    return before[there], words[there]


def _grow(numbered: DataFrame, about: dict, order: int, least: int, discount: float) -> dict:
    """The next level of a model, from all rows (id, words) of its texts."""
    level, folder, width = len(about["levels"]) + 1, about["folder"], _width(about)
    parts = max(1, -(-about["tokens"] // RANGE))
    share = min(1.0, SAMPLE / max(1, about["tokens"]))
    cut_context = cut_word = np.zeros(0, np.int64)
    if parts > 1:  # quantiles of some keys; they deal out the work and change no result
        sample = numbered.sample(share, 5).limit(SAMPLE).toArrow().combine_chunks().to_batches()
        keys = [_level_keys(Model(about), *x[1:]) for x in _numbered(iter(sample), width)]
        c, w, n = _pairs(*(np.concatenate([k[i] for k in keys] or [np.zeros(0, np.int64)]) for i in range(2)), False)
        if len(c):
            at = np.unique(np.searchsorted(np.cumsum(np.sqrt(n)), np.sqrt(n).sum() * np.arange(1, parts) / parts))
            cut_context, cut_word = c[np.minimum(at, len(c) - 1)], w[np.minimum(at, len(c) - 1)]
    parts = len(cut_context) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(about)
        for _, lengths, words in _numbered(batches, width):
            c, w, n = _pairs(*_level_keys(model, lengths, words), False)
            low, high = np.searchsorted(c, cut_context), np.searchsorted(c, cut_context, side="right")
            ends = [0, *(int(i + np.searchsorted(w[i:j], x)) if i < j else int(i) for i, j, x in zip(low, high, cut_word, strict=True)), len(c)]
            for k in range(parts):
                i, j = ends[k], ends[k + 1]
                yield from _sent(k, c[i:j], w[i:j], n[i:j])

    def write(batches: Iterator[pa.RecordBatch]) -> dict | None:
        context, word, n = _merged(batches, np.int64)
        keep = n >= least
        context, word, n = context[keep], word[keep], n[keep]
        if not len(context):
            return None
        new = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        own, first = context[new], int(context[0])
        times = Model(about).levels[-1].counts(own, "" if level == 2 else ".n")
        mass, sizes = np.add.reduceat(n - discount, new), np.diff(np.append(new, len(context)))
        pointers = np.zeros(int(own[-1]) - first + 2, np.int64)
        pointers[own - first + 1] = sizes
        g = np.full(len(pointers) - 1, 65535, np.uint16)
        g[own - first] = quantise(np.maximum(1 - mass / times, 0))
        arrays = {f"ptr.{k}": a for k, a in EliasFano.encode(np.cumsum(pointers)).items()}
        arrays |= Numbers.encode(word, "words") | {"p": quantise((n - discount) / np.repeat(times, sizes)), "g": g}
        save(path := f"{folder}/{level}/{first:016x}-{int(word[0]):08x}", arrays)
        if level < order:
            save(f"{path}.n", Counts.encode(n))  # for the next level; the finished model doesn't read it
        ends = [[int(own[k]), float(mass[k]), int(times[k])] for k in (0, -1)]
        return {"path": path, "first": [first, int(word[0])], "n": len(context), "contexts": len(g), "ends": ends}

    shards = _shards(numbered.mapInArrow(count, SENT_ROWS), parts, write)
    masses: dict[int, list] = {}
    for s in shards:
        (c, mass, times), (d, other, more) = s.pop("ends")
        masses.setdefault(c, [0.0, times])[0] += mass
        if d != c:
            masses.setdefault(d, [0.0, more])[0] += other
    spans = [[c, int(quantise(np.array([max(0.0, 1 - mass / times)]))[0])] for c, (mass, times) in sorted(masses.items())]
    return about | {"id": uuid.uuid4().hex, "order": level, "levels": [*about["levels"], {"shards": shards, "spans": spans}]}


def grow(numbered: DataFrame, about: dict, order: int = 3, least: int = 2, discount: float = 0.75) -> dict:
    """Count, prune, smooth and write the levels above the vocabulary, from all rows of number(); every row counts.

    least: n-grams of two words and more that occur less often are left out; 1 keeps all. Repeated rows and rows with a
    null id count each; without rows the levels are empty, and texts are scored by the vocabulary alone.
    """
    while about["order"] < order:
        about = _grow(numbered, about, order, least, discount)
    return about


def train(texts: DataFrame, order: int = 3, least: int = 2, discount: float = 0.75, text_col: str = "text") -> dict:
    """Count, prune, smooth and write a model; what it returns says where its files are.

    All rows count, null texts as empty; an empty table gives a model of no text. N-grams of two words and more are
    kept if they occur `least` times or more; the probability of the others goes to the shorter context.
    """
    about = vocabulary(texts, text_col)
    numbered = materialize(number(texts.select(F.lit(None).cast("long").alias("id"), text_col), about, "id", text_col), "ngram-numbers")
    return grow(numbered, about, order, least, discount)


def score_numbers(numbered: DataFrame, about: dict, id_col: str = "doc_id") -> DataFrame:
    """score() of rows that number() has numbered by this model's vocabulary."""

    width = _width(about)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(about)
        for ids, lengths, words in _numbered(batches, width):
            first = _firsts(lengths)
            p = base = (model.unigrams(words) + 0.5) / (about["tokens"] + 0.5 * (about["types"] + 1))
            rank = words
            for level in range(1, about["order"]):
                rank, seen, weight = model.step(level, _before(rank, first), words)
                p = seen + weight * p
            sums = [np.add.reduceat(x, first) for x in ((words >= 0).astype(np.int64), np.log10(base), np.log10(p))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int64()), *map(pa.array, sums)], [id_col, "n_tokens", "n_known", "base_score", "score"])

    return numbered.select(id_col, "words").mapInArrow(run, f"`{id_col}` long, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, about: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each row: log10 probabilities of its whole text and its end.

    base_score is the sum of the add-half unigrams; a null or empty text is its end alone; a model of no text gives
    every token the same probability. Repeated rows are scored each; null ids stay; an empty table gives no rows; other
    columns aren't read.
    """
    return score_numbers(number(docs, about, id_col, text_col), about, id_col)
