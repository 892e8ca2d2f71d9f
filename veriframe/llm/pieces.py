"""SentencePiece encoding and decoding by vectorised merge rounds.

All words of a batch that were not met before lie in one flat array of symbols. A round looks
up the rank of every adjacent pair, takes the smallest rank of each segment, merges all its
leftmost occurrences at once and compacts the array; segments without a pair leave. A segment
is a stretch that no piece can cross: it ends where two characters are adjacent in no piece.
A round costs as much as the array is long, so segments of over ``LONG`` symbols (unbroken text,
runs of spaces) leave it for a queue of pairs, whose work grows with n log n; ids are the same.
Words repeat, so a bounded table keeps the ids and the decoded bytes of the words met.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import Recent, byte_texts, chunks, small_batches

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
NONE = np.int32(1 << 30)
WORDS_KEPT = 50_000  # in each of two generations
LONG = 64  # symbols
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a serialised protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        v = s = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v

    while i < len(b):
        key = number()
        kind = key & 7
        if kind == 0:
            value: object = number()
        elif kind == 2:
            n = number()
            value, i = b[i : i + n], i + n
        elif kind == 5:
            value, i = struct.unpack("<f", b[i : i + 4])[0], i + 4
        else:
            value, i = b[i : i + 8], i + 8
        yield key >> 3, value


class Pieces:
    """The tables of one BPE model file with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        for f, v in _fields(model):
            if f == 1:
                x = dict(_fields(v))
                self.pieces.append((x[1].decode(), x.get(2, 0.0), x.get(3, NORMAL)))
        normal = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.byte_id = np.zeros(256, np.int32)
        self.out: list[bytes] = []
        for i, (p, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
                self.out.append(bytes([int(p[3:5], 16)]))
            else:
                self.out.append(b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode())
        self.bos, self.eos = (next(i for i, (p, *_) in enumerate(self.pieces) if p == x) for x in ("<s>", "</s>"))
        self.char_id = np.full(0x110000, -1, np.int32)
        scores = sorted({s for p, s, k in self.pieces if k == NORMAL}, reverse=True)
        at = {s: r for r, s in enumerate(scores)}
        rank = {i: at[self.pieces[i][1]] for i in normal.values()}
        pairs: dict[tuple[int, int], int] = {}
        adjacent: set[tuple[str, str]] = set()
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
            for k in range(1, len(p)):
                adjacent.add((p[k - 1], p[k]))
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        n = len(self.pieces)
        # A piece whose merge may open a pair of better rank is merged once a round, leftmost first.
        self.single = np.zeros(n, bool)
        for (a, b), i in pairs.items():
            for x in (a, b):
                if rank[i] <= rank[x]:
                    self.single[x] = True
            if not self.pieces[i][0].strip(SPACE):
                self.single[i] = True
        self.rank = np.full(n, NONE, np.int32)
        for i, r in rank.items():
            self.rank[i] = r
        self.pairs, self.ranks = {a << 16 | b: i for (a, b), i in pairs.items()}, self.rank.tolist()
        self.pair_keys, self.pair_ids = self._table({a * 65536 + b: i for (a, b), i in pairs.items()})
        known = {ord(c) for pair in adjacent for c in pair}
        self.adj_keys, _ = self._table({ord(a) * 0x110000 + ord(b): 1 for a, b in adjacent if ord(a) in known})
        self.words = Recent(WORDS_KEPT)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _table(self, d: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """An open-addressing table with eight times as many slots as keys."""
        bits = max(8, int(len(d) * 8 - 1).bit_length())
        keys, values = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, -1, np.int32)
        slots = self._slot(np.fromiter(d, np.int64, len(d)), bits)
        for s, (k, v) in zip(slots.tolist(), d.items(), strict=True):
            while keys[s] != -1:
                s += 1
            keys[s], values[s] = k, v
        return keys, values

    def _find(self, keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The value of each wanted key, -1 where there is none."""
        bits = int(len(keys) - 64).bit_length() - 1
        slot = self._slot(wanted, bits)
        got = keys[slot]
        out = np.where(got == wanted, values[slot], np.int32(-1))
        rest = np.flatnonzero((got != wanted) & (got != -1))
        while len(rest):
            slot[rest] += 1
            got = keys[slot[rest]]
            hit = got == wanted[rest]
            out[rest[hit]] = values[slot[rest[hit]]]
            rest = rest[~hit & (got != -1)]
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((a < 0) | (b < 0), np.int32(-1), self._find(self.pair_keys, self.pair_ids, a.astype(np.int64) * 65536 + b))

    def _queued(self, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places and ids that stay of one long segment's symbols: always the pair of the least rank, the leftmost of equal ones."""
        n, pairs, rank = len(given), self.pairs, self.ranks
        sym, after, before = array("i", given.tolist()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        to = self._pairs(given[:-1], given[1:])
        first = np.flatnonzero(to >= 0)
        # Rank and place as one number. The pairs at hand are sorted once, those that arise wait in a heap.
        ready = np.sort(self.rank[to[first]].astype(np.int64) << 40 | first)[::-1]
        ready = array("q", ready.tobytes())
        arisen: list[int] = []
        while ready or arisen:
            key = heapq.heappop(arisen) if not ready or (arisen and arisen[0] < ready[-1]) else ready.pop()
            left = key & (1 << 40) - 1
            right = after[left]
            if sym[left] < 0 or right >= n or sym[right] < 0:
                continue
            new = pairs.get(sym[left] << 16 | sym[right])
            if new is None or rank[new] != key >> 40:  # one of the two has changed since
                continue
            sym[left], sym[right] = new, -2
            right = after[left] = after[right]
            if right < n:
                before[right] = left
                x = pairs.get(new << 16 | sym[right]) if sym[right] >= 0 else None
                if x is not None:
                    heapq.heappush(arisen, rank[x] << 40 | left)
            right = before[left]
            if right >= 0 and sym[right] >= 0:
                x = pairs.get(sym[right] << 16 | new)
                if x is not None:
                    heapq.heappush(arisen, rank[x] << 40 | right)
        out = np.frombuffer(sym, np.int32)
        stay = np.flatnonzero(out != -2)
        return stay, out[stay]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order and the n+1 offsets of the words among them."""
        cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=starts[1:])
        sym, pos = self.char_id[cp], np.arange(len(cp))
        cut = np.zeros(len(cp), bool)
        cut[starts[:-1]] = True
        if len(cp) > 1:
            cut[1:] |= self._find(self.adj_keys, np.zeros(len(self.adj_keys), np.int32), cp[:-1] * 0x110000 + cp[1:]) < 0
        seg = np.cumsum(cut) - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        edges = np.flatnonzero(np.append(cut, True))
        over = np.flatnonzero(np.diff(edges) > LONG)
        if len(over):
            short = np.ones(len(sym), bool)
            for a, b in zip(edges[over].tolist(), edges[over + 1].tolist(), strict=True):
                at, ids = self._queued(sym[a:b])
                done.append((a + at, ids))
                short[a:b] = False
            sym, pos, seg = sym[short], pos[short], seg[short]
        while len(sym):
            n = len(sym)
            same = np.zeros(n, bool)
            same[:-1] = seg[1:] == seg[:-1]
            at = np.flatnonzero(same)
            to = np.full(n, -1, np.int32)
            to[at] = self._pairs(sym[at], sym[at + 1])
            rank = np.where(to >= 0, self.rank[to], NONE)
            first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, n)))
            live = best < NONE
            if not live.all():
                done.append((pos[~live], sym[~live]))
                if not live.any():
                    break
            hit = np.flatnonzero((rank == best) & live)
            # Overlapping occurrences of one pair: every second one of a run, from its left end.
            begin = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
            offset = np.arange(len(hit)) - np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))
            hit = hit[offset % 2 == 0]
            lead = np.concatenate(([True], seg[hit[1:]] != seg[hit[:-1]]))
            hit = hit[lead | ~self.single[to[hit]]]
            sym[hit] = to[hit]
            live[hit + 1] = False
            sym, pos, seg = sym[live], pos[live], seg[live]
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(words) + 1, np.int64)
        pos, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(pos, kind="stable")
        pos, sym = pos[order], sym[order]
        width = np.ones(len(sym), np.int64)
        odd = np.flatnonzero(sym < 0)
        raw = [chr(c).encode() for c in cp[pos[odd]].tolist()]
        width[odd] = [len(b) for b in raw]
        ends = np.cumsum(width)
        ids = np.repeat(sym, width)
        for e, b in zip((ends[odd] - width[odd]).tolist(), raw, strict=True):
            ids[e : e + len(b)] = self.byte_id[list(b)]
        count = np.concatenate(([0], ends))
        return ids.astype("<u4"), count[np.searchsorted(pos, starts)]

    def learn(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes, int]]:
        ids, off = self.encode_words([w.decode().replace(" ", SPACE) for w in words])
        raw, out = ids.tobytes(), self.out
        flat = [out[i] for i in ids.tolist()]
        o = off.tolist()
        return {w: (raw[4 * a : 4 * b], b"".join(flat[a:b]), b - a) for w, a, b in zip(words, o, o[1:], strict=False)}

    def encode(self, texts: list[bytes]) -> list[tuple[int, bytes, bytes]]:
        """Of each text: the number of ids with begin and end, the ids as little-endian bytes, the decoded bytes."""
        split = []
        new: set[bytes] = set()
        for t in texts:
            if b"\xe2\x96\x81" in t:
                t = t.replace(b"\xe2\x96\x81", b" ")
            w = re.findall(rb" +[^ ]*", b" " + t) if t else []
            split.append(w)
            new.update(w)
        table = self.words
        known = {w: table[w] for w in new}
        fresh = [w for w, x in known.items() if x is None]
        if fresh:
            for w, x in self.learn(fresh).items():
                known[w] = x
                if len(w) <= 64:
                    table.keep(w, x)
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        rows = []
        for w in split:
            got = [known[x] for x in w]
            ids = b"".join([x[0] for x in got])
            text = b"".join([x[1] for x in got])
            rows.append((2 + len(ids) // 4, begin + ids + end, text[1:] if text[:1] == b" " else text))
        return rows


_MODELS: dict[str, Pieces] = {}


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids (unsigned 32-bit little-endian binary with begin and end) and the decoded text.

    ``model_path`` is read on the driver and its bytes travel with the task (half a megabyte), so
    executors need no local file. Null and empty texts give begin and end only; repeated rows give
    repeated results; a text of any length is encoded whole; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _MODELS.get(model_path)
        if pieces is None:
            pieces = _MODELS[model_path] = Pieces(model.value)
        for b in chunks(batches, limit=1 << 20):
            rows = pieces.encode(byte_texts(b))
            n, ids, text = zip(*rows, strict=True)
            decoded = pa.array(text, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), decoded], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
