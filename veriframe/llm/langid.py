"""Language identification by mixture inference.

Each language has smoothed probabilities of hashed letter n-grams, learnt from a bounded sample.
A document's n-grams come from a mixture of languages. Expectation-maximisation finds the
proportions; languages are added to the set one by one while the gain in log likelihood exceeds
a penalty that grows with the logarithm of the number of n-grams. How well the mixture explains
the n-grams, on a scale from n-grams never met (0) to the middle one of the learnt documents (1),
tells text of a known language from junk and from text of languages that were not learnt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import byte_texts, chunks, joined, small_batches

BITS = 16
SAMPLE = 500  # documents of each language, at most about
LONGEST = 20_000  # characters of a document of the sample
PENALTY = 3.0
ROUNDS = 12
SLACK = 0.55  # by how much the fit of few n-grams may fall short by chance, times the root of their number
SCHEMA = "doc_id long, lang_pred string, score double, fit double, languages array<string>, proportions array<double>"

# Bytes that are letters or part of a letter keep their lower case; all others become a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 4-byte grams of all texts, and the n+1 offsets of the texts among them."""
    buf, _ = joined([b" " + t + b" " for t in texts])
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in texts], out=off[1:])
    b = _FOLD[buf]
    if len(b) < 4:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    x = b.astype(np.uint32)
    g = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    keep = (b[:-3] != 32) | (b[1:-2] != 32)
    keep &= (b[1:-2] != 32) | (b[2:-1] != 32)
    bounds = off[1:-1]
    for k in (1, 2, 3):
        keep[bounds[bounds - k < len(keep)] - k] = False
    h = (g * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    at = np.concatenate(([0], np.cumsum(keep)))
    return h[keep].astype(np.int64), at[np.minimum(off, len(keep))]


def fit(rows: list[tuple[str, bytes]]) -> tuple[list[str], np.ndarray]:
    """Languages and the probabilities of n-grams, one column a language."""
    langs = sorted({lang for lang, _ in rows})
    counts = np.zeros((1 << BITS, len(langs)))
    for k, lang in enumerate(langs):
        h, _ = ngrams([t for x, t in rows if x == lang])
        counts[:, k] = np.bincount(h, minlength=1 << BITS)
    base = (counts.sum(1) + 0.1) / (counts.sum() + 0.1 * (1 << BITS))
    prob = (counts + 200.0 * base[:, None]) / (counts.sum(0) + 200.0)
    return langs, prob.astype(np.float32)


def infer(c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Of n-gram counts c with probabilities p: proportions (zero outside the selected set), the confidence in the first
    language, and the mean logarithm of an n-gram's probability."""
    n, k = c.sum(), p.shape[1]
    single = c @ np.log(p)
    best = int(single.argmax())
    chosen, w, ll = [best], np.array([1.0]), single[best]
    need = PENALTY * np.log(n + 1.0)
    while len(chosen) < k:
        mix = p[:, chosen] @ w
        gain = (c / mix) @ p / n
        gain[chosen] = 0
        extra = int(gain.argmax())
        if gain[extra] <= 1.0:
            break
        q = p[:, [*chosen, extra]]
        v = np.append(w * 0.8, 0.2)
        for _ in range(ROUNDS):
            r = q * v
            v = c @ (r / r.sum(1, keepdims=True)) / n
        now = c @ np.log(q @ v)
        if now - ll <= need:
            break
        chosen, w, ll = [*chosen, extra], v, now
    out = np.zeros(k)
    out[chosen] = w
    order = np.exp((single - single.max()) / max(1.0, n / 200.0))
    top = int(out.argmax())
    sure = order[top] / order.sum() if len(chosen) == 1 else 1.0
    return out, float(min(1.0, max(0.0, out[top] * sure))), float(ll / n)


def counted(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts; text without one counts as one n-gram."""
    return np.unique(part if len(part) else np.zeros(1, np.int64), return_counts=True)


def ends_of_fit(rows: list[tuple[str, bytes]], prob: np.ndarray) -> tuple[float, float]:
    """The mean logarithms that count as a fit of 0 and 1: that of n-grams that were never met, and that of half
    the learnt documents, each third of them explained by the others."""
    unmet = float(np.log(prob.max(1).min()))
    means = []
    for k in range(3):
        rest = [r for i, r in enumerate(rows) if i % 3 != k]
        if not rest:
            continue
        _, p = fit(rest)
        for _, t in rows[k::3]:
            h, _ = ngrams([t])
            u, c = counted(h)
            means.append(infer(c.astype(np.float64), p[u].astype(np.float64))[2])
    return unmet, max(float(np.median(means)) if means else 0.0, unmet + 1.0)


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: float | None = None) -> DataFrame:
    """Per row: id, lang_pred, score, fit, the selected languages and their proportions.

    ``train`` says which rows may be learnt from; rows without a language teach nothing. The
    sample is drawn by a hash of id and text, about ``SAMPLE`` rows of each language of at most
    ``LONGEST`` characters; equal rows count once. Null texts and texts without a letter give
    ``und`` with score 0 and no fit, and so does every text when nothing could be learnt. Repeated
    rows give repeated results. The model has ``2 ** BITS`` probabilities a language.
    With ``keep``, returns instead the rows of ``docs``, all columns, whose language is known with that fit.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    usable = train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= LONGEST)
    counts = {r[0]: r[1] for r in docs.filter(usable).groupBy(F.col(lang_col)).agg(F.count("*")).collect()}
    rows: list[tuple[str, bytes]] = []
    if counts:
        share = F.lit(0.0)
        for lang, n in counts.items():
            share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, SAMPLE / n))).otherwise(share)
        chance = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)), F.lit(1 << 30))
        drawn = docs.filter(usable & (chance < share * (1 << 30))).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), chance.alias("chance")).dropDuplicates()
        rows = [(r[0], r[1].encode()) for r in drawn.orderBy("chance", "lang", "text").limit(4 * SAMPLE * len(counts)).collect()]
    rows.sort()
    langs, prob = fit(rows) if rows else ([], np.zeros((1 << BITS, 0), np.float32))
    low, high = ends_of_fit(rows, prob) if rows else (0.0, 1.0)
    model = spark.sparkContext.broadcast((langs, prob))

    def judge(b: pa.RecordBatch, column: str) -> list[tuple[str, float, float | None, list[str], list[float]]]:
        names, p = model.value
        texts = byte_texts(b, column)
        h, off = ngrams(texts)
        out = []
        for i, t in enumerate(texts):
            if not names or not any(map(str.isalpha, t.decode())):
                out.append(("und", 0.0, None, [], []))
                continue
            u, c = counted(h[off[i] : off[i + 1]])
            w, s, mean = infer(c.astype(np.float64), p[u].astype(np.float64))
            fitted = float((mean - low) / (high - low) + SLACK / np.sqrt(c.sum()))
            order = [k for k in np.argsort(-w, kind="stable").tolist() if w[k] > 0]
            out.append((names[order[0]], s, fitted, [names[k] for k in order], [float(w[k]) for k in order]))
        return out

    if keep is not None:

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, text_col):
                yield b.filter(pa.array([x[2] is not None and x[2] >= keep for x in judge(b, text_col)], pa.bool_()))

        return docs.mapInArrow(kept, docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            lang, score, fitted, chosen, share = zip(*judge(b, "text"), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(fitted, pa.float64()), pa.array(chosen, pa.list_(pa.string())), pa.array(share, pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "fit", "languages", "proportions"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
