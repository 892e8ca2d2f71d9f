"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library's trainer, one on ordinary text, one on
toxic text. A toxic document is ordinary text for the most part, so the toxic dictionary's
samples are weighted against ordinary text: the stretches of toxic documents whose byte sequences
stand in significantly more toxic than ordinary documents. Every document is cut into windows of
eight words, which are compressed twice: with the ordinary dictionary, and with the toxic one set
behind it. In the first case a filler that matches nothing stands in the toxic one's place, so
all else costs the same. The bytes saved are the window's evidence: each number of saved bytes
has a weight, the logarithm of how much more often windows of toxic documents save that much. A
document's score grows with the sum of its windows' weights; windows that save nothing weigh a
little against it, so length alone doesn't make a document toxic. Weights and the threshold of
the sum are calibrated by cross-fitting: every labelled document is compressed with dictionaries
of the other folds, and the dictionaries that score are those of all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import LOWER, byte_texts, chunks, mix64, release, small_batches, word_hashes
from veriframe.llm.samples import labelled

SAMPLE = 6000  # documents of each label, at most about
LONGEST = 20_000
WORDS = 8  # of a window
PIECE = 48  # bytes; longer words count as several
ORDINARY, TOXIC = 1 << 17, 1 << 12  # bytes of the dictionaries
ORDINARY_SAMPLES = 40_000  # windows
GRAM = 7  # bytes of a sequence, up to 8
SIGNIFICANT = 4.5  # standard errors between the shares of toxic and ordinary documents that hold a sequence
TIMES = 4  # how many times larger the toxic share has to be
ROUND = 1  # bytes on each side of a stretch
FOLDS = 3
MOST = 12  # saved bytes that are told apart
CLEAN = 6.0  # what an ordinary document found toxic costs, against a toxic one found
FILLER = b"\0"
SCHEMA = "doc_id long, score double, predicted int, windows int, toxic_windows int, saved int"


def _words(text: bytes) -> list[bytes]:
    out = text.lower().split()
    if len(text) > PIECE and max(map(len, out), default=0) > PIECE:
        out = [w[i : i + PIECE] for w in out for i in range(0, len(w), PIECE)]
    return out


def windows(text: bytes) -> list[bytes]:
    """Stretches of ``WORDS`` words, one space between and round them."""
    w = _words(text)
    return [b" %b " % b" ".join(w[i : i + WORDS]) for i in range(0, len(w), WORDS)]


class Model:
    """Both dictionaries, the weight of each number of saved bytes (one spent up to ``MOST`` saved) and the threshold of their sum; pickled as bytes."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.raw = ordinary, toxic
        self.weights, self.threshold, self.slope = np.zeros(MOST + 2), 0.5, 1.0
        self._open()

    def _open(self) -> None:
        ordinary, toxic = self.raw
        self.plain, self.both = _compressor(ordinary + FILLER * len(toxic)), _compressor(ordinary + toxic)

    def __getstate__(self):
        return self.raw, self.weights, self.threshold, self.slope

    def __setstate__(self, state):
        self.raw, self.weights, self.threshold, self.slope = state
        self._open()

    def saved(self, flat: list[bytes]) -> np.ndarray:
        """The bytes that each window saves with the toxic dictionary."""
        return _lengths(self.plain, flat) - _lengths(self.both, flat)

    def judge(self, texts: list[bytes]) -> list[tuple[float, int, int, int, int]]:
        """Of each text: score, predicted, windows, windows that weigh for toxicity, bytes saved."""
        each = [windows(t) for t in texts]
        saved = self.saved([w for ws in each for w in ws])
        weight = self.weights[np.clip(saved, -1, MOST) + 1]
        off = np.concatenate(([0], np.cumsum([len(ws) for ws in each])))
        sums = [np.concatenate(([0], np.cumsum(v)))[off] for v in (weight, weight > 1, saved)]
        total, toxic, saved = (np.diff(v) for v in sums)
        score = 1 / (1 + np.exp(-self.slope * np.clip(total - self.threshold, -30, 30)))
        return list(zip(score.tolist(), (score >= 0.5).astype(int).tolist(), map(len, each), toxic.tolist(), saved.tolist(), strict=True))


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=18, hash_log=18, chain_log=18, search_log=6, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def _lengths(c: zstandard.ZstdCompressor, flat: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in c.multi_compress_to_buffer(flat)], np.int64) if flat else np.zeros(0, np.int64)


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of the library's trainer; of too few samples, their text as it stands."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 6)), samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or b" ")[-size:].rjust(8, b" ")


def _grams(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(b) - GRAM + 1)
    g = np.zeros(n, np.uint64)
    for k in range(GRAM):
        g |= b[k : n + k] << np.uint64(8 * k)
    return g


def _flat(text: bytes) -> bytes:
    return b" %b " % b" ".join(_words(text))


def typical(ordinary: list[bytes], toxic: list[bytes]) -> np.ndarray:
    """The sequences, sorted, that a significantly larger share of the toxic texts holds than of the ordinary ones."""
    grams, hits = np.unique(np.concatenate([np.unique(_grams(_flat(t))) for t in toxic]), return_counts=True)
    grams, hits = grams[hits > 1], hits[hits > 1]
    others = np.zeros(len(grams) + 1, np.int64)
    for t in ordinary:
        g = np.unique(_grams(_flat(t)))
        at = np.searchsorted(grams, g)
        others[np.where(np.append(grams, 0)[at] == g, at, len(grams))] += 1
    others = others[:-1]
    share = (others + hits) / (len(ordinary) + len(toxic))
    error = np.sqrt(share * (1 - share) * (1 / len(ordinary) + 1 / len(toxic)))
    more = hits / len(toxic) > TIMES * others / len(ordinary)
    return grams[more & (hits / len(toxic) - others / len(ordinary) > SIGNIFICANT * error)]


def stretches(text: bytes, wanted: np.ndarray) -> list[bytes]:
    """The stretches of the text that sorted sequences ``wanted`` cover, with ``ROUND`` bytes on each side."""
    t = _flat(text)
    g = _grams(t)
    if not len(g) or not len(wanted):
        return []
    new = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)] == g)
    edge = np.zeros(len(t) + 1, np.int64)
    np.add.at(edge, new, 1)
    np.add.at(edge, new + GRAM, -1)
    inside = np.diff(np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False])).astype(np.int8))
    return [s for a, z in zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True) if len(s := t[max(0, a - ROUND) : z + ROUND]) >= 8]


def _unlike(rows: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The rows without near copies: those that share one of four minima of the hashes of three words with an earlier one."""
    seen: set[tuple[int, int]] = set()
    out = []
    for y, t in rows:
        h, _, _ = word_hashes(LOWER[np.frombuffer(t, np.uint8)])
        h = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)
        keys = {(k, int(mix64(h + np.uint64(k << 32)).min())) for k in range(4)} if len(h) else set()
        if not keys & seen:
            out.append((y, t))
        seen |= keys
    return out


def rising_odds(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The logarithms of the ratios of the toxic to the ordinary shares, pooled so that none falls and the first two are one."""
    pools: list[list[float]] = []  # ordinary and toxic windows and the entries of each pool
    odds = lambda p: (p[1] + 0.5) / (p[0] + 0.5)
    for o, t, n in [(ordinary[:2].sum(), toxic[:2].sum(), 2), *((o, t, 1) for o, t in zip(ordinary[2:], toxic[2:], strict=True))]:
        pools.append([float(o), float(t), n])
        while len(pools) > 1 and odds(pools[-1]) <= odds(pools[-2]):
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    base = math.log((toxic.sum() + 1.0) / (ordinary.sum() + 1.0))
    return np.concatenate([np.full(int(p[2]), math.log(odds(p)) - base) for p in pools])


def dictionaries(rows: list[tuple[int, bytes]], rng: np.random.Generator) -> Model:
    """Both dictionaries of (label, text) rows, not yet calibrated."""
    ordinary, toxic = [t for y, t in rows if y == 0], [t for y, t in rows if y]
    flat = [w for t in ordinary for w in windows(t) if len(w) >= 8]
    flat = [flat[i] for i in np.sort(rng.permutation(len(flat))[:ORDINARY_SAMPLES]).tolist()]
    wanted = typical(ordinary, toxic)
    return Model(_trained(flat, ORDINARY, 64), _trained([s for t in toxic for s in stretches(t, wanted)], TOXIC, 16))


def fit(rows: list[tuple[int, bytes]], seed: int = 3) -> Model | None:
    """The model of (label, text) rows; None with fewer than ``FOLDS`` different texts of either label."""
    rows = _unlike(sorted(set(rows)))  # a copy tells nothing new
    rng = np.random.default_rng(seed)
    by_label = [[r for r in rows if (r[0] != 0) == label] for label in (False, True)]
    if min(map(len, by_label)) < FOLDS:
        return None
    folds: list[list[tuple[int, bytes]]] = [[] for _ in range(FOLDS)]
    for group in by_label:
        for k, i in enumerate(rng.permutation(len(group)).tolist()):
            folds[k % FOLDS].append(group[i])
    # Calibration: the weights of saved bytes, then the threshold of their sum, of documents that the dictionaries haven't seen.
    saved: list[np.ndarray] = []
    for f, fold in enumerate(folds):
        part = dictionaries([r for g in range(FOLDS) if g != f for r in folds[g]], rng)
        saved += [np.clip(part.saved(windows(t)), -1, MOST) + 1 for _, t in fold]
    y = np.array([y for fold in folds for y, _ in fold])
    counts = [np.bincount(np.concatenate([s for s, z in zip(saved, y, strict=True) if z == label]), minlength=MOST + 2) for label in (0, 1)]
    model = dictionaries(rows, rng)
    model.weights = rising_odds(*counts)
    total = np.array([model.weights[s].sum() for s in saved])
    cuts = np.arange(0.25, 8.1, 0.25)
    gain = np.array([(total[y == 1] > c).mean() - CLEAN * (total[y == 0] > c).mean() for c in cuts])
    model.threshold = float(cuts[np.flatnonzero(gain >= gain.max() - 0.01)].mean())
    return model


def score(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: id, score in 0..1, predicted, the windows, those that weigh for toxicity and the bytes saved.

    ``train`` is a condition on the label rows' ``doc_id``; the sample has about ``SAMPLE`` rows of
    each label of at most ``LONGEST`` characters. Null texts count as empty and score as text
    without a window; without both labels every score is 0. Repeated rows repeat.
    With ``keep``, returns instead the rows of ``docs``, all columns, that are not predicted toxic.
    """
    small_batches(docs.sparkSession)
    rows, _ = labelled(docs, labels, train, label_col, SAMPLE, LONGEST, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))
    del rows
    release()  # what the fit used

    def judge(texts: list[bytes]) -> list[tuple[float, int, int, int, int]]:
        m = model.value
        return m.judge(texts) if m is not None else [(0.0, 0, len(windows(t)), 0, 0) for t in texts]

    if keep:

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, text_col):
                yield b.filter(pa.array([r[1] == 0 for r in judge(byte_texts(b, text_col))], pa.bool_()))

        return docs.mapInArrow(kept, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s, p, n, hits, saved = zip(*judge(byte_texts(b)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(p, pa.int32()), pa.array(n, pa.int32()), pa.array(hits, pa.int32()), pa.array(saved, pa.int32())], names=["doc_id", "score", "predicted", "windows", "toxic_windows", "saved"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
