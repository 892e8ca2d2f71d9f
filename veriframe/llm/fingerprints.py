"""Document fingerprints from improbable features.

Every window of ``WINDOW`` bytes has a collision entropy; how far it lies from that of running
text is its rarity. A window that is the rarest within ``RADIUS`` on both sides is a feature.
Features go, in text order, into Bloom filters of ``FILTER_BITS`` bits, a new filter after every
``PER_FILTER`` features. Two fingerprints are as alike as the best overlaps of the filters of the
shorter one, each normalised by what chance and the smaller filter allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import joined, mix64, small_batches

WINDOW = 32
RADIUS = 16
FILTER_BITS = 2048
HASHES = 5
PER_FILTER = 128
TYPICAL, WEAKEST = 3.4, 1.2  # bits of collision entropy of running text; below, a window says nothing
CHANCE = 0.1  # the share of the possible overlap beyond chance that still counts as chance
SCHEMA = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_pairs = np.arange(WINDOW * (WINDOW - 1) // 2 + 1)
_H = -np.log2((WINDOW + 2.0 * _pairs) / WINDOW**2)
RARITY = np.where(_H < WEAKEST, 0, 1 + np.minimum(250, np.rint(np.abs(_H - TYPICAL) * 48))).astype(np.uint8)


def _equal_pairs(b: np.ndarray) -> np.ndarray:
    """Of each window of the byte array, the number of pairs of equal bytes."""
    n = len(b)
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        e = (b[:-k] == b[k:]).view(np.uint8)
        after[:-k] += e
        before[k:] += e
    first = b[:WINDOW]
    start = int((np.bincount(first) * (np.bincount(first) - 1) // 2).sum())
    step = before[WINDOW:].astype(np.int32) - after[: n - WINDOW]
    return start + np.concatenate(([0], np.cumsum(step)))


def _reach(r: np.ndarray) -> np.ndarray:
    """The maximum of the RADIUS values that begin at each position."""
    m, k = r.copy(), 1
    while k < RADIUS:
        m[:-k] = np.maximum(m[:-k], m[k:])
        k *= 2
    return m


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text its filters, one row of bytes each; none for an empty text."""
    buf, off = joined(texts)
    total = off[-1]
    doc = np.zeros(0, np.int64)
    feature = np.zeros(0, np.uint64)
    if total >= WINDOW:
        r = RARITY[_equal_pairs(buf)]
        inside = np.zeros(len(r) + 1, np.int32)
        lo, hi = off[:-1], np.maximum(off[:-1], off[1:] - WINDOW + 1)
        ok = hi > lo
        np.add.at(inside, lo[ok], 1)
        np.add.at(inside, hi[ok], -1)
        r = np.where(np.cumsum(inside[:-1]) > 0, r, np.uint8(0))
        pad = np.concatenate((np.zeros(RADIUS, np.uint8), r, np.zeros(RADIUS, np.uint8)))
        m = _reach(pad)
        at = np.arange(len(r)) + RADIUS
        pick = np.flatnonzero((r > 0) & (r > m[at - RADIUS]) & (r >= m[at + 1]))
        x = np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[pick].reshape(len(pick), WINDOW).copy().view("<u8")
        h = np.full(len(pick), 0x1234567, np.uint64)
        for k in range(x.shape[1]):
            h = mix64(h ^ x[:, k])
        feature, doc = h, np.searchsorted(off, pick, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    bare = [i for i in np.flatnonzero(count == 0).tolist() if len(texts[i])]
    if bare:  # shorter than a window, or nothing but weak windows: the whole text is the feature
        whole = []
        for i in bare:
            t = np.frombuffer(texts[i] + b"\0" * (-len(texts[i]) % 8), "<u8")
            whole.append(mix64((t * np.arange(1, 2 * len(t) + 1, 2, dtype=np.uint64)).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(len(texts[i])))[0])
        feature, doc = np.concatenate((feature, np.array(whole, np.uint64))), np.concatenate((doc, bare))
        order = np.argsort(doc, kind="stable")
        feature, doc = feature[order], doc[order]
        count = np.bincount(doc, minlength=len(texts))
    filters = -(-count // PER_FILTER)
    base = np.concatenate(([0], np.cumsum(filters)))
    rank = np.arange(len(doc)) - np.concatenate(([0], np.cumsum(count)))[doc]
    slot = base[doc] + rank // PER_FILTER
    bits = np.zeros((int(base[-1]), FILTER_BITS), bool)
    for k in range(HASHES):
        bits[slot, ((feature >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[base[i] : base[i + 1]] for i in range(len(texts))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; two empty fingerprints are alike, an empty one and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    out = 0.0
    for x, n in zip(a, na.tolist(), strict=True):
        both = np.bitwise_count(b & x).sum(1, dtype=np.int64)
        chance, most = n * nb / FILTER_BITS, np.minimum(n, nb)
        share = (both - chance) / np.maximum(most - chance, 1e-9)
        share = np.where(np.minimum(n, nb) * 8 < np.maximum(n, nb), share * np.minimum(n, nb) / np.maximum(n, nb), share)
        best = share.max()
        out += (best - CHANCE) / (1 - CHANCE) * n if best > CHANCE else 0.0
    return float(min(1.0, max(0.0, out / na.sum())))


def text_of(filters: np.ndarray) -> str:
    return "-".join(f.tobytes().hex() for f in filters)


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucket(key, splits: list[float]):
    """The number of splits at or below the key, by a balanced tree of comparisons."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key.cast("double") < F.lit(float(splits[mid])), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(splits)).cast("int")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, the edited text, both fingerprints, and the likeness to the edited text's and to the next row's.

    Rows are taken in order of the id and, among equal ids, of the text; the first follows the last.
    One shuffle sends ranges of ids to tasks, with the first row of each range copied to the range
    before it, so a task reads its rows in order and holds two at a time. Null texts count as
    empty; an empty text has an empty fingerprint; a single row follows itself; rows without an id
    come first; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    splits = sorted(set(rows.select(key.cast("double").alias("k")).stat.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    rows = rows.withColumn("bucket", _bucket(key, splits))
    heads = {r[0]: r[1] for r in rows.select("bucket", key.alias("k")).groupBy("bucket").agg(F.min("k")).collect()}
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    order = sorted(heads)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    # Keys whose hashes spread the ranges evenly over the tasks.
    spread: dict[int, int] = {}
    for r in spark.range(64 * parts).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p")).collect():
        spread.setdefault(r.p, r.i)
    keys = [spread[p] for p in sorted(spread)]
    dealt = F.element_at(F.array(*[F.lit(keys[k % len(keys)]) for k in range(max(order) + 1)]), F.col("bucket") + 1)
    head_of = F.element_at(F.array(*[F.lit(heads.get(b)).cast("long") for b in range(max(order) + 1)]), F.col("bucket") + 1)
    first = key == head_of
    ghost_to = F.element_at(F.array(*[F.lit(before.get(b)).cast("int") for b in range(max(order) + 1)]), F.col("bucket") + 1)
    wrap = F.col("bucket") == F.lit(order[0])
    copies = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("g")), F.when(first, F.struct(ghost_to.alias("b"), F.when(wrap, F.lit(2)).otherwise(F.lit(1)).alias("g"))))
    rows = rows.withColumn("c", F.explode(F.filter(copies, lambda x: x.isNotNull()))).select("doc_id", "text", F.col("c.b").alias("bucket"), F.col("c.g").alias("ghost"))
    rows = rows.repartition(parts, dealt).sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last own row, waiting for the next
        after = False  # a following row of this range was met
        ready: list[tuple] = []  # (id, text, following text)
        size = 0

        def flush() -> pa.RecordBatch:
            own = [t for _, t, _ in ready]
            extra = [edited(t, n) for _, t, n in ready]
            at: dict[str, int] = {}
            for t in [*own, *extra, *(n for _, _, n in ready)]:
                at.setdefault(t, len(at))
            d = digests([t.encode() for t in at])
            a, e, n = ([d[at[t]] for t in x] for x in (own, extra, [x[2] for x in ready]))
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in ready], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array(extra, pa.string()), pa.array([text_of(x) for x in a]), pa.array([text_of(x) for x in e]), pa.array([likeness(x, y) for x, y in zip(a, e, strict=True)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(a, n, strict=True)], pa.float64())],
                names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for i, t, b, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[2] == b and not after:
                    ready.append((held[0], held[1], t))
                    size += len(held[1])
                if g:
                    after = True
                    continue
                held, after = (i, t, b), False
                if size > 600_000 or len(ready) > 4000:
                    yield flush()
                    ready, size = [], 0
        if ready:
            yield flush()

    return rows.mapInArrow(run, SCHEMA)
