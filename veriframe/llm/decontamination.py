"""Benchmark decontamination by edit distance over words.

An item of m words may be met with m * ``EDITS`` edits, rounded down. The CGK embedding maps edit
distance to Hamming distance: a walk over the words copies the word under it at every step and moves
on or stays, as a random bit of step and word says, so two sequences that differ by an edit fall
into step again. Windows as long as an item (items of over ``BLOCK`` words are cut into equal
blocks, of which one has its share of the edits at most) are embedded ``repeats`` times, each with
walks of its own, and ``BITS`` steps of each are sampled. Windows and items that agree in the
samples of one repetition are candidates. A window that equals a block always agrees.

An edit breaks two pairs of adjacent words at most, so a window can hold a block only if it holds
one of the block's rarest pairs (one more than twice its edits); windows are embedded only where
such a pair stands at its place. A candidate that lacks more words of the item than edits are
allowed is dropped, the rest is verified by the exact edit distance of the whole item to the best
stretch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import LOWER, byte_texts, chunks, joined, materialise, mix64, small_batches, word_hashes

EDITS = 0.25  # of an item's words, rounded down
TARGET_RECALL = 0.999
BLOCK = 32  # words of a window at most
BITS = 2  # steps sampled in a repetition
AGREE = 0.36  # share of equal steps, at least, of blocks that are all the edits apart (measured, up to ``BLOCK`` words)
WINDOWS_AT_ONCE = 1 << 14
ITEMS_AT_ONCE = 20_000  # items that are broadcast together, unless their bytes are more than
ITEM_BYTES_AT_ONCE = 4 << 20  # an item of more bytes is broadcast alone
LOOKED_UP_AT_ONCE = 1 << 18  # places and candidates, so that a very common word or block takes bounded memory
LONG = 2048  # words of an item whose bit masks are built when a text needs them
MASKS_MB = 64
SCHEMA = "doc_id long, item_id long, distance int, item_words int, first_byte long, last_byte long"

_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalnum()]] = 32


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words without punctuation, their starts and ends, the texts' offsets among words and bytes."""
    buf, off = joined(texts, pad=1)
    low = _FOLD[buf]
    low[off[1:] - 1] = 32
    h, starts, ends = word_hashes(low)
    return h, starts, ends, np.searchsorted(starts, off), off


def repeats(target: float) -> int:
    """Repetitions with which a pair of blocks that are all the edits apart agrees once with the probability ``target``."""
    return math.ceil(math.log(1 - target) / math.log(1 - AGREE**BITS))


def pairs(h: np.ndarray, at: np.ndarray, single: bool = False) -> np.ndarray:
    """A hash of the word at each place and the one that follows, or of the one word."""
    return h[at] if single else mix64(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1])


class Walks:
    """Random walks over windows of ``size`` words, and the steps sampled of each."""

    def __init__(self, size: int, n: int):
        rng = np.random.default_rng(size)
        steps = 2 * size
        self.size, self.n = size, n
        self.move = rng.integers(0, 1 << 63, (steps, n), np.uint64) << np.uint64(1) | np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, n, np.uint64)
        picked = np.argsort(rng.random((n, steps)), axis=1)[:, : min(BITS, steps)]
        self.sampled = [np.flatnonzero((picked == j).any(1)) for j in range(steps)]

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """The samples of each repetition (rows) and window (columns) as one hash; 0 in ``windows`` is past the end."""
        padded = np.concatenate((windows, np.zeros((len(windows), 1), np.uint64)), axis=1)
        at = np.zeros((self.n, len(windows)), np.int64)
        column = np.arange(len(windows))
        out = np.repeat(self.salt[:, None], len(windows), axis=1)
        last = max(j for j, r in enumerate(self.sampled) if len(r))
        for j in range(last + 1):
            x = padded[column, at]
            r = self.sampled[j]
            if len(r):
                out[r] = mix64(out[r] ^ x[r])
            at = np.minimum(at + (x * self.move[j][:, None] >> np.uint64(63)).astype(np.int64), self.size)
        return out


class Masks(dict):
    """The places of each word in a long pattern as bits; few are kept, since each is as long as the pattern."""

    def __init__(self, pattern: list[int]):
        super().__init__()
        self.size, self.places = len(pattern), {}
        for i, w in enumerate(pattern):
            self.places.setdefault(w, []).append(i)

    def get(self, w: int, default: int = 0) -> int:
        if w not in self.places:
            return default
        if w not in self:
            if len(self) * self.size > MASKS_MB << 23:
                self.clear()
            bits = np.zeros(self.size, np.uint8)
            bits[self.places[w]] = 1
            self[w] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        return self[w]


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance of the pattern to any stretch of the text, and the end of the first such stretch (bit-parallel)."""
    m = len(pattern)
    peq: dict[int, int] = Masks(pattern) if m > LONG else {}
    if m <= LONG:
        for i, w in enumerate(pattern):
            peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # the stretch may begin anywhere
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j
            if not best:
                break
    return best, end


class Table:
    """Sorted keys, with a table of bits that answers for most absent ones."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64((1 << max(16, int(8 * len(keys)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(keys & self.mask).astype(np.int64)] = True

    def find(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of ``k`` that are in the table, and the first and last rows of each."""
        at = np.flatnonzero(self.bits[(k & self.mask).astype(np.int64)])
        first, last = np.searchsorted(self.keys, k[at]), np.searchsorted(self.keys, k[at], "right")
        there = last > first
        return at[there], first[there], last[there]


class Items:
    def __init__(self, rows: list[tuple[int, str]], target_recall: float = TARGET_RECALL):
        h, starts, ends, wo, _ = words_of([t.encode() for _, t in rows])
        worded = np.flatnonzero(np.diff(wo))
        self.ids = np.array([i for i, _ in rows], np.int64)[worded]
        self.words, self.base = h, wo[worded]
        self.size = wo[worded + 1] - self.base
        self.edits = (EDITS * self.size).astype(np.int64)
        vocabulary, self.word, count = np.unique(h, return_inverse=True, return_counts=True)
        self.vocabulary = Table(vocabulary)
        # Blocks: item, place in the item, size.
        n = -(-self.size // BLOCK)
        self.item = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(self.item)) - np.repeat(np.cumsum(n) - n, n)
        self.place = j * self.size[self.item] // n[self.item]
        size = (j + 1) * self.size[self.item] // n[self.item] - self.place
        edits = self.edits[self.item] // n[self.item]
        self.walks: dict[int, Walks] = {}
        keys, block = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        anchors: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for m in np.unique(size).tolist():
            of = np.flatnonzero(size == m)
            walks = self.walks[m] = Walks(m, repeats(target_recall))
            at = (self.base[self.item[of]] + self.place[of])[:, None] + np.arange(m)
            for lo in range(0, len(of), WINDOWS_AT_ONCE):
                part = slice(lo, lo + WINDOWS_AT_ONCE)
                keys.append(walks.keys(h[at[part]]).ravel())
                block.append(np.tile(of[part], walks.n))
            if m == 1:
                anchors[1].append(np.stack((pairs(h, at[:, 0], True), np.zeros(len(of), np.uint64), np.ones(len(of), np.uint64))))
                continue
            # Pairs of rare words first, long words before short ones.
            seen, length = count[self.word[at]], (ends - starts)[at]
            order = np.lexsort((-(length[:, :-1] + length[:, 1:]), seen[:, :-1] * seen[:, 1:]), axis=1)
            b, p = np.nonzero(np.argsort(order, axis=1) <= 2 * edits[of][:, None])
            anchors[0].append(np.stack((pairs(h, at[b, p]), p.astype(np.uint64), np.full(len(b), m, np.uint64))))
        k, of = np.concatenate(keys), np.concatenate(block)
        order = np.argsort(k, kind="stable")
        self.table, self.block = Table(k[order]), of[order]
        self.anchors = []  # whether of single words, keys, places in the block, sizes of blocks
        for single, found in enumerate(anchors):
            if found:
                key, place, size = np.unique(np.concatenate(found, axis=1), axis=1)
                self.anchors.append((bool(single), Table(key), place.astype(np.int64), size.astype(np.int64)))

    def windows(self, h: np.ndarray, wo: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(size, first words) of the windows that hold an anchor at its place, some at a time."""
        for single, table, place, sizes in self.anchors:
            at = np.arange(len(h)) if single else np.flatnonzero(doc[1:] == doc[:-1])
            hit, first, last = table.find(pairs(h, at, single))
            at = at[hit]
            total = np.concatenate(([0], np.cumsum(last - first)))
            for lo in range(0, int(total[-1]), LOOKED_UP_AT_ONCE):
                each = np.arange(lo, min(lo + LOOKED_UP_AT_ONCE, int(total[-1])))
                x = np.searchsorted(total, each, "right") - 1
                entry = first[x] + each - total[x]
                start, size = np.maximum(wo[doc[at[x]]], at[x] - place[entry]), sizes[entry]
                for m in np.unique(size).tolist():
                    found = np.unique(start[size == m])
                    for k in range(0, len(found), WINDOWS_AT_ONCE):
                        yield m, found[k : k + WINDOWS_AT_ONCE]

    def candidates(self, h: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word, last word) of all stretches that may hold an item, in this order."""
        doc = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
        row = np.int64(len(h) + 1)
        places: np.ndarray | None = None
        found = [np.zeros((3, 0), np.int64)]
        for m, start in self.windows(h, wo, doc):
            at = start[:, None] + np.arange(m)
            window = np.where(at < wo[doc[start] + 1][:, None], h[np.minimum(at, len(h) - 1)], np.uint64(0))
            hit, first, last = self.table.find(self.walks[m].keys(window).ravel())
            total = np.concatenate(([0], np.cumsum(last - first)))
            for lo in range(0, int(total[-1]), LOOKED_UP_AT_ONCE):
                each = np.arange(lo, min(lo + LOOKED_UP_AT_ONCE, int(total[-1])))
                x = np.searchsorted(total, each, "right") - 1
                b = self.block[first[x] + each - total[x]]
                s, i = start[hit[x] % len(start)], self.item[b]
                # Places count from the text's start; a slot has the starts that k edits may confuse.
                slot = (s - self.place[b] - wo[doc[s]]) // (self.edits[i] + 1)
                c = np.unique(np.stack((doc[s], i, slot)), axis=1)
                if places is None:
                    there, word, _ = self.vocabulary.find(h)
                    places = np.sort(word * row + there)
                found.append(c[:, self.enough(c, wo, places, row)])
        d, i, slot = np.unique(np.concatenate(found, axis=1), axis=1)
        return d, i, *self.stretch(d, i, slot, wo)

    def stretch(self, d: np.ndarray, i: np.ndarray, slot: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.edits[i]
        start = wo[d] + slot * (k + 1)
        return np.maximum(wo[d], start - k), np.minimum(wo[d + 1], start + self.size[i] + 2 * k)

    def enough(self, c: np.ndarray, wo: np.ndarray, places: np.ndarray, row: np.int64) -> np.ndarray:
        """The candidates whose stretch lacks at most k of the item's words, each of which takes an edit."""
        d, i, slot = c
        lo, hi = self.stretch(d, i, slot, wo)
        left, missing = np.arange(len(d)), np.zeros(len(d), np.int64)
        kept, done, step = [], 0, 8
        while len(left):
            x = i[left]
            cols = done + np.arange(step)
            inside = cols < self.size[x][:, None]
            w = self.word[np.minimum(self.base[x][:, None] + cols, len(self.word) - 1)] * row
            q = np.searchsorted(places, w + lo[left][:, None])
            there = (q < len(places)) & (places[np.minimum(q, len(places) - 1)] < w + hi[left][:, None])
            missing[left] += (inside & ~there).sum(1)
            done += step
            left = left[missing[left] <= self.edits[x]]
            over = self.size[i[left]] <= done
            kept.append(left[over])
            left = left[~over]
            step = max(8, min(done, LOOKED_UP_AT_ONCE // max(1, len(left))))
        return np.sort(np.concatenate(kept)) if kept else left

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first byte, last byte) of the best match of each text and item."""
        h, starts, ends, wo, off = words_of(texts)
        if not len(h) or not len(self.ids):
            return []
        stretches: list[list[int]] = []
        for doc, item, lo, hi in zip(*(x.tolist() for x in self.candidates(h, wo)), strict=True):
            if stretches and stretches[-1][:2] == [doc, item] and lo <= stretches[-1][3]:
                stretches[-1][3] = hi
            else:
                stretches.append([doc, item, lo, hi])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, item, lo, hi in stretches:
            had = best.get((doc, item))
            if had and not had[0]:
                continue
            m = int(self.size[item])
            d, end = best_match(self.words[self.base[item] : self.base[item] + m].tolist(), h[lo:hi].tolist())
            if d <= self.edits[item] and (had is None or (d, lo + end) < had):
                best[doc, item] = (d, lo + end)
        return [(doc, item, d, int(starts[max(int(wo[doc]), end - int(self.size[item]))] - off[doc]), int(ends[end - 1] - off[doc])) for (doc, item), (d, end) in best.items()]


def _batches(items: DataFrame, id_col: str, text_col: str, target_recall: float) -> Iterator[tuple[Items, bool]]:
    """The items, some at a time, and whether these are all."""
    rows: list[tuple[int, str]] = []
    held, before = 0, False
    given = items.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).dropDuplicates()
    for r in given.toLocalIterator():
        size = len(r[1].encode())
        if rows and (len(rows) == ITEMS_AT_ONCE or held + size > ITEM_BYTES_AT_ONCE):
            yield Items(sorted(rows), target_recall), False
            rows, held, before = [], 0, True
        rows.append((r[0], r[1]))
        held += size
    if rows:
        yield Items(sorted(rows), target_recall), not before


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row for each document and item that it holds: the edit distance in words, the item's words, and the bytes of the stretch.

    A document holds an item if a stretch of its words is within ``EDITS`` of the item's words. Of
    those that are all the edits apart, at least about ``target_recall`` are found, of exact copies all.
    Case and ASCII punctuation don't count. Items of any length are broadcast ``ITEMS_AT_ONCE`` or
    ``ITEM_BYTES_AT_ONCE`` at a time, one pass over the documents each. Null and wordless texts and items hold and give nothing; copies
    of a document give rows of their own; equal items with different ids are both found.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for part, only in _batches(items, item_id, item_text, target_recall):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in chunks(batches):
                rows = index.search(byte_texts(b))
                if rows:
                    doc, item, d, first, last = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(index.ids[list(item)]), pa.array(d, pa.int32()), pa.array(index.size[list(item)].astype(np.int32)), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["doc_id", "item_id", "distance", "item_words", "first_byte", "last_byte"])

        found = given.mapInArrow(run, SCHEMA)
        if not only:  # one batch is broadcast at a time
            found = materialise(found)
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", target_recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    spark = docs.sparkSession
    small_batches(spark)
    for part, only in _batches(items, item_id, item_text, target_recall):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, text_col):
                hit = {r[0] for r in shared.value.search(byte_texts(b, text_col))}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not only:
            docs = materialise(docs)
            shared.unpersist()
    return docs
