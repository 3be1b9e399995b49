"""Best-fit packing of token pieces into sequences by hierarchical residual packing.

Each task tokenizes its documents, cuts pieces, and packs them best-fit decreasing into bins. Bins that are nearly full
are final. The others go on as items of the size they have reached: fewer tasks each pack what several tasks
left, again and again, until one task has seen the rest or a round joins nothing. A bin carries its pieces
(never more than its capacity of tokens, so a row has a bound), and a task never holds many more than `window` pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, per_process

PIECES = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
BINS = f"used int, final boolean, pieces {PIECES}"


#: Bytes between which the tokenizer always cuts: an ASCII letter, then ASCII punctuation but for the apostrophe.
_LETTER, _MARK = (np.isin(np.arange(256), list(kind)) for kind in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))
#: A run that the tokenizer takes as one word.
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Runs of more bytes are encoded, but not remembered. Texts are encoded about so many bytes at a time.
LONG, BATCH = 64, 2_000_000


def _spaced(texts: list[bytes]) -> list[bytes]:
    """The texts with a blank between each letter and a mark after it; so words are the same whatever stands behind them."""
    if any(b"<|" in t for t in texts):  # the tokenizer's special tokens hold such a place
        return [t if b"<|" in t else _spaced([t])[0] for t in texts]
    raw = b"".join(texts)
    a = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_LETTER[a[:-1]] & _MARK[a[1:]]) + 1
    out, keep = np.full(len(a) + len(at), 32, np.uint8), np.ones(len(a) + len(at), bool)
    keep[at + np.arange(len(at))] = False
    out[keep] = a
    raw = out.tobytes()
    ends = np.cumsum([0, *map(len, texts)])
    ends = (ends + np.searchsorted(at, ends)).tolist()  # a blank between two texts falls to the later one
    return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]


class WordEncoder:
    """Token ids of a UTF-8 text, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer never joins characters across white space, nor a letter with a mark after it, so each run is encoded
    once and remembered; other white space stays inside a run and is left to the tokenizer. Many runs are encoded at a
    time: words of letters between blanks, told apart by the number of the word that each token belongs to, others
    around a control character, whose one id cuts the result; a run that holds it is encoded by itself. `most` bounds
    the runs that are remembered, and LONG their bytes.
    """

    MARK = "\x01"

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.most = Tokenizer.from_file(path), {}, most
        (self.cut,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids

    def encode(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of distinct runs."""
        out: dict[str, bytes] = {}
        words, marked, alone = [], [], []
        for run in runs:
            (words if _WORD.fullmatch(run) else alone if self.MARK in run else marked).append(run)
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        for at in range(0, len(groups), 16):
            part = groups[at : at + 16]
            for group, got in zip(part, self.tokenizer.encode_batch([" ".join(g) for g in part], add_special_tokens=False), strict=True):
                number = np.array(got.word_ids)
                starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
                if len(starts) != len(group):
                    marked += group
                else:
                    self._cut(out, group, np.array(got.ids, "<u4"), starts, np.append(starts[1:], len(number)))
        for i in range(0, len(marked), 500):
            group = marked[i : i + 500]
            ids = np.array(self.tokenizer.encode(f" {self.MARK} ".join(group), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.cut)
            self._cut(out, group, ids, np.concatenate(([0], cuts + 1)), np.append(cuts, len(ids)))
        for run in alone:
            out[run] = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    @staticmethod
    def _cut(out: dict, runs: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        out.update(zip(runs, map(raw.__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist())), strict=True))

    def __call__(self, texts: list[bytes | str]) -> list[bytes]:
        """The ids of each text; texts come in batches, so that new runs are encoded many at a time."""
        texts = [t.encode() if isinstance(t, str) else t for t in texts]
        split = [t.replace(b"\n", b" ").split(b" ") for t in _spaced(texts)]
        found, holes, fresh = [], [], {}
        for words in split:
            ids, mine = list(map(self.known.get, words)), []
            for _ in range(ids.count(None)):
                mine.append(ids.index(None, mine[-1] + 1 if mine else 0))
                fresh[words[mine[-1]]] = None
            found.append(ids)
            holes.append(mine)
        coded = self.encode([w.decode() for w in fresh])
        fresh = {w: coded[w.decode()] for w in fresh}
        for words, ids, mine in zip(split, found, holes, strict=True):
            for i in mine:
                ids[i] = fresh[words[i]]
        if len(self.known) > self.most:  # what is still met stays
            self.known = {w: self.known[w] for words in split for w in words if w in self.known}
        self.known.update((w, c) for w, c in fresh.items() if len(w) <= LONG)
        return list(map(b"".join, found))


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing: the bin of each item, and the room taken in each bin.

    The residuals in use are the bits of one whole number, so the tightest bin that fits is found in one step.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, used, mask = [0] * len(sizes), [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            room, bin_ = capacity, len(used)
            used.append(0)
        place[i] = bin_
        used[bin_] += size
        left = room - size
        if left:
            open_bins[left].append(bin_)
            mask |= 1 << left
    return place, used


def _pack(items: list[tuple[int, list]], capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    place, used = best_fit([size for size, _ in items], capacity)
    bins: list[list] = [[] for _ in used]
    for i, b in enumerate(place):
        bins[b] += items[i][1]
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
    for at in range(0, len(used), 2000):
        part = slice(at, at + 2000)
        flat = [p for b in bins[part] for p in b]
        columns = [pa.array(c, t.type) for c, t in zip(zip(*flat, strict=True), kind.value_type, strict=True)]
        offsets = np.concatenate(([0], np.cumsum([len(b) for b in bins[part]])))
        values = pa.StructArray.from_arrays(columns, [f.name for f in kind.value_type])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[part], pa.int32()), pa.array([u >= capacity - slack for u in used[part]]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
            ["used", "final", "pieces"],
        )


def tokenize_and_pack(docs: DataFrame, tokenizer: str, capacity: int, slack: int, window: int, remember: int, id_col: str, text_col: str) -> DataFrame:
    """The bins of each task: (used, final, pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        encode, items, end = per_process("words", tokenizer, lambda: WordEncoder(tokenizer, remember)), [], b"\0\0\0\0"
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BATCH)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                for doc, coded in zip(ids[i:j], encode([t or b"" for t in texts[i:j].to_pylist()]), strict=True):
                    coded += end
                    for k, start in enumerate(range(0, len(coded), 4 * capacity)):
                        piece = coded[start : start + 4 * capacity]
                        items.append((len(piece) // 4, [(doc, k, start // 4, len(piece) // 4, crc32(piece))]))
                if len(items) >= window:
                    yield from _pack(items, capacity, slack)
                    items = []
        yield from _pack(items, capacity, slack)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, BINS)


def _repack(capacity: int, slack: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, held = [], 0
        for batch in batches:
            lists = batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = (np.flatnonzero(np.diff(np.cumsum(lengths) // window)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                used, flat = batch.column(0)[i:j].to_pylist(), lists[i:j].flatten()
                rows = list(zip(*(flat.field(k).to_pylist() for k in range(5)), strict=True))
                ends = np.cumsum(lengths[i:j]).tolist()
                items += [(u, rows[a:b]) for u, a, b in zip(used, [0, *ends], ends, strict=False)]
                held += len(rows)
                if held >= window:
                    yield from _pack(items, capacity, slack)
                    items, held = [], 0
        yield from _pack(items, capacity, slack)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, slack: int = 2, fan_in: int = 8, window: int = 100_000, remember: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    A document is its token ids and then id 0; only one longer than capacity is cut, into pieces of capacity. slack: a
    bin that lacks at most so many tokens is final. fan_in: how many tasks' leftovers one task of the next round packs.
    window: how many pieces a task holds at a time; what it left over then is joined in the next rounds.
    remember: how many runs a worker remembers, some 250 bytes each; fewer cost time, not results.
    A null or empty text is the single id 0; a row with a null id is packed like any other; repeated rows are packed
    each; an empty table gives no rows; other columns aren't read. Sequences have arbitrary, distinct numbers.
    """
    bins = materialize(tokenize_and_pack(docs, tokenizer, capacity, slack, window, remember, id_col, text_col), "pack-0")
    done = [bins.filter("final")]
    rest = bins.filter("not final")
    tasks = max(1, bins.rdd.getNumPartitions())
    left, last, level = rest.count(), None, 0
    while left and (last is None or (tasks > 1 and left < last)):
        # As long as a task would get more than its window, more tasks share the round.
        pieces = rest.agg(F.sum(F.size("pieces"))).first()[0]
        tasks = max(-(-tasks // fan_in), -(-pieces // window))
        level += 1
        dealt = rest.repartition(tasks, F.xxhash64(F.element_at("pieces", 1), F.lit(level))) if tasks > 1 else rest.coalesce(1)
        packed = materialize(dealt.mapInArrow(_repack(capacity, slack, window), BINS), f"pack-{level}")
        done.append(packed.filter("final"))
        rest, last = packed.filter("not final"), left
        left = rest.count()
    final = done[0]
    for more in [*done[1:], rest]:
        final = final.union(more)
    placed = final.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            length = np.asarray(flat.field(3))
            ends = np.cumsum(length)
            before = ends - length
            first = np.cumsum(counts) - counts
            offset = before - np.repeat(before[first], counts)
            yield pa.RecordBatch.from_arrays(
                [*(flat.field(k) for k in range(5)), pa.array(np.repeat(np.asarray(batch.column(0)), counts)), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return placed.mapInArrow(spread, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
