"""Quality ranking by the Bradley-Terry model.

Documents of label 1 are preferred to documents of label 0. A linear score of text features is
fitted by logistic loss on the feature differences of such pairs; the threshold is the quantile of
the scores at the share of label 0. All labelled documents are learnt from, whole: they are dealt to
buckets, the rarer label's to several, and all pairs of a bucket count. Each Newton step is one pass
over the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import LOWER, byte_texts, chunks, joined, materialise, small_batches, word_hashes

PAIRS = 30_000  # that ``fit`` draws
MORE, LESS = 64, 16  # documents of the more frequent and of the rarer label in a bucket, about
BINS, FEW = 4096, 10_000
STEPS, PENALTY = 25, 0.002
SCHEMA = "doc_id long, rank_score double, score double, predicted int"


def features(texts: list[bytes]) -> np.ndarray:
    """One row a text; shares are 0 for empty texts."""
    buf, off = joined(texts, pad=1)  # a zero byte after each text
    sep = np.zeros(len(buf), bool)
    sep[off[1:] - 1] = True
    low = LOWER[buf]
    low[sep] = 10
    h, starts, ends = word_hashes(low)
    wo = np.searchsorted(starts, off)  # words of text i: wo[i]:wo[i+1]
    out = np.zeros((len(texts), 15))
    for i in range(len(texts)):
        n = int(off[i + 1] - off[i] - 1)
        a, b = int(wo[i]), int(wo[i + 1])
        if n <= 0:
            continue
        k = np.bincount(buf[off[i] : off[i + 1] - 1], minlength=256)
        m = max(1, b - a)
        upper, lower, digits = k[65:91].sum(), k[97:123].sum(), k[48:58].sum()
        symbols = k[35:39].sum() + k[42] + k[124] + k[94] + k[126] + k[64] + k[60:63].sum()
        w = h[a:b]
        distinct = len(np.unique(w))
        lengths = ends[a:b] - starts[a:b]
        same = int((w[1:] == w[:-1]).sum())
        again = int((w[2:] == w[:-2]).sum()) if m > 2 else 0
        # Pairs of words that were met before: what loops.
        pair = w[1:] * np.uint64(3) + w[:-1]
        loops = 1 - len(np.unique(pair)) / max(1, len(pair))
        out[i] = (
            symbols / m, np.log1p(10 * symbols / m), upper / (upper + lower + 1), k[33] / m, np.log1p(10 * k[33] / m), digits / n, same / m, np.log1p(10 * same / m),
            again / m, loops, 1 - distinct / m, np.log1p(n) / 10, (lengths.mean() if b > a else 0.0) / 10, k[124] / m, (k[46] + k[44]) / m,
        )
    return out


def fit(x: np.ndarray, y: np.ndarray, low_share: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and threshold from features and labels in memory; pairs are drawn."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -5, 5)
    z = np.hstack([z, z * z])
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(d.shape[1])
    for _ in range(25):  # Newton steps of the penalised logistic loss
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (1 - p) / len(d) - 0.002 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 0.002 * np.eye(len(w))
        step = np.linalg.solve(hess, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    weight = np.where(y == 0, low_share / max(1, len(bad)), (1 - low_share) / max(1, len(good)))
    order = np.argsort(s)
    at = int(np.searchsorted(np.cumsum(weight[order]), low_share))
    at = min(max(at, 1), len(s) - 1)
    return mean, scale, w, float((s[order[at - 1]] + s[order[at]]) / 2)


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, h, f): features of each text and a hash of it; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x = features(byte_texts(b))
            off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(off, pa.array(x.ravel()))], names=["doc_id", "h", "f"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, f array<double>")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -5, 5)
    return np.hstack([z, z * z])


def buckets(known: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(good, bad): feature rows of both labels, dealt by a hash; the rarer label's go to several buckets where they are too few."""
    rarer = 0 if counts[0] < counts[1] else 1
    n = max(1, -(-counts[1 - rarer] // MORE))
    copies = min(n, max(1, -(-LESS * n // counts[rarer])))
    dealt = known.withColumn("k", F.explode(F.when(F.col("y") == rarer, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))))
    # Copies of a document go to buckets in a row, so never twice to one.
    dealt = dealt.withColumn("bucket", F.pmod(F.pmod(F.xxhash64("doc_id", "h"), F.lit(n)) + F.col("k") * F.lit(n // copies), F.lit(n)))
    of = lambda y: F.flatten(F.collect_list(F.when(F.col("y") == y, F.col("f"))))
    return dealt.groupBy("bucket").agg(of(1).alias("good"), of(0).alias("bad"))


def fit_all(known: DataFrame, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and threshold from (doc_id, h, y, f) of all learnt documents."""
    spark = known.sparkSession
    width = features([b""]).shape[1]
    r = known.agg(*[F.avg(F.get("f", F.lit(k))) for k in range(width)], *[F.stddev_pop(F.get("f", F.lit(k))) for k in range(width)]).first()
    mean, scale = np.array(r[:width]), np.array(r[width:]) + 1e-6
    dealt = materialise(buckets(known, counts))
    size = 2 * width
    w = np.zeros(size)
    for _ in range(STEPS):  # Newton steps of the penalised logistic loss
        shared = spark.sparkContext.broadcast(w)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w = shared.value
            total = np.zeros(1 + size + size * size)
            for b in batches:
                for good, bad in zip(b.column(0), b.column(1), strict=True):
                    good, bad = (_scaled(x.values.to_numpy().reshape(-1, width), mean, scale) for x in (good, bad))
                    if len(good) and len(bad):
                        d = (good[:, None] - bad[None]).reshape(-1, size)
                        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                        total[0] += len(d)
                        total[1 : 1 + size] += d.T @ (1 - p)
                        total[1 + size :] += ((d * (p * (1 - p))[:, None]).T @ d).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

        sums = np.sum([x.total for x in dealt.select("good", "bad").mapInArrow(step, "total array<double>").collect()], axis=0)
        shared.unpersist()
        pairs = max(1.0, sums[0])
        g = sums[1 : 1 + size] / pairs - PENALTY * w
        hess = sums[1 + size :].reshape(size, size) / pairs + PENALTY * np.eye(size)
        change = np.linalg.solve(hess, g)
        w = w + change
        if np.abs(change).max() < 1e-6:
            break

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_scaled(_rows(b.column(0)), mean, scale) @ w)], names=["s"])

    return mean, scale, w, between(materialise(known.select("f").mapInArrow(scored, "s double")), counts[0])


def between(scores: DataFrame, n: int) -> float:
    """The middle of the n-th least score and the next, exactly: the range is divided until few scores are in it."""

    def nth(rank: int) -> float:  # from 0
        lo, hi = scores.agg(F.min("s"), F.max("s")).first()
        below = 0
        while lo < hi:
            inside = scores.filter(F.col("s").between(lo, hi))
            at = F.least(F.lit(BINS - 1), F.floor((F.col("s") - lo) / ((hi - lo) / BINS)).cast("int"))
            for r in sorted(inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect()):
                if rank < below + r.n:
                    break
                below += r.n
            lo, hi = r.lo, r.hi
            if r.n <= FEW:
                return sorted(x.s for x in scores.filter(F.col("s").between(lo, hi)).collect())[rank - below]
        return float(lo)

    return (nth(n - 1) + nth(n)) / 2


def rank(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, rank_score (the Bradley-Terry score), score in 0..1 and predicted.

    ``train`` is a condition on the label rows' ``doc_id``. Ids labelled twice alike count once, those
    labelled both 0 and 1 teach nothing; equal rows count once. Null texts count as empty and get the
    score of no features; without both labels the score is 0.5 for all. Repeated rows repeat.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = materialise(extract(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))))
    known = labels.filter(train).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y")
    known = materialise(found.join(known.hint("merge"), "doc_id").dropDuplicates(["doc_id", "h"]))
    counts = {0: 0, 1: 0} | {r[0]: r[1] for r in known.groupBy("y").agg(F.count("*")).collect()}
    model = spark.sparkContext.broadcast(fit_all(known, counts) if counts[0] and counts[1] else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows)
            if model.value is not None and b.num_rows:
                mean, scale, w, threshold = model.value
                s = _scaled(_rows(b.column(1)), mean, scale) @ w - threshold
            score = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "rank_score", "score", "predicted"])

    return found.select("doc_id", "f").mapInArrow(run, SCHEMA)
