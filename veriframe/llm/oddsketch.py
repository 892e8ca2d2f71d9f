"""Near copies by odd sketches of MinHash samples.

A document's 3-word shingles give ``SAMPLES`` minima of independent hashes. Sets of similarity J agree in each
minimum with probability J, so ``BANDS`` bands of ``ROWS`` minima find a pair at the threshold
with probability ``1 - (1 - J ** ROWS) ** BANDS``. The samples are also folded into one bitmap: each (hash, minimum)
flips a bit. Equal samples cancel out in the exclusive or of two bitmaps, so its
population count is at most twice the number of minima that differ, and estimates it precisely where few do.
A candidate of the bands whose count is beyond what a pair at the threshold reaches with probability ``1 - SLIP`` is
dropped; the others are confirmed on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import byte_texts, chunks, materialise, mix64, small_batches
from veriframe.llm.similar import BROADCAST_IDS, SHORT, buckets, components_of, cross_links, labelled_rows, mixed_only, nodes_of, shingle_sets, signature, stars, verified

WORDS = 3
SIMILAR = (17, 20)  # 0.85, exactly
BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
BITS = 1024
SLIP = 1e-9
_X = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A = mix64(np.arange(1001, 1001 + SAMPLES, dtype=np.uint64)) | np.uint64(1)


def most_different(samples: int, similarity: float, slip: float) -> int:
    """The least number of differing samples that a pair of that similarity exceeds with probability ``slip`` at most."""
    q, tail = 1 - similarity, 1.0
    for k in range(samples + 1):
        tail -= math.comb(samples, k) * q**k * (1 - q) ** (samples - k)
        if tail <= slip:
            return k
    return samples


MOST_BITS = 2 * most_different(SAMPLES, SIMILAR[0] / SIMILAR[1], SLIP)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The samples of sets that aren't empty, one row each."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in sets])[:-1])).astype(np.int64)
    out = np.empty((len(sets), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat((flat ^ _X[k]) * _A[k], starts)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One number for each band, that of another band included."""
    each = mix64(samples ^ _X).reshape(len(samples), BANDS, ROWS)
    return mix64((each * _A[:ROWS]).sum(axis=2, dtype=np.uint64) ^ _A[:BANDS])


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bitmaps of ``BITS`` parities of the samples, as 64-bit numbers."""
    place = (mix64(samples ^ _X[::-1]) % np.uint64(BITS)).astype(np.int64) + BITS * np.arange(len(samples))[:, None]
    odd = np.bincount(place.ravel(), minlength=BITS * len(samples)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(samples), BITS), axis=1).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            sets = shingle_sets(byte_texts(b), WORDS)
            full = [i for i, x in enumerate(sets) if len(x)]
            keys: list = [None] * len(sets)
            odd: list = [None] * len(sets)
            if full:
                samples = minima([sets[i] for i in full])
                for i, k, o in zip(full, band_keys(samples).view(np.int64).tolist(), odd_sketch(samples).tolist(), strict=True):
                    keys[i], odd[i] = k, o
            one, two = zip(*(signature(x) for x in sets), strict=True)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, longs), pa.array(odd, longs)], names=["doc_id", "n", "s1", "s2", "bands", "sketch"]
            )

    return docs.mapInArrow(run, "doc_id long, n int, s1 long, s2 long, bands array<long>, sketch array<long>")


def bits_apart(x: Column, y: Column) -> Column:
    """The population count of the exclusive or of two sketches."""
    return sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(1, BITS // 64)), F.bit_count(x[0].bitwiseXOR(y[0])))


def sizes_allow(a: Column, b: Column) -> Column:
    return SIMILAR[1] * F.least(a, b) >= SIMILAR[0] * F.greatest(a, b)


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The candidates that sizes and sketches leave."""
    x, y = (nodes.select(F.col("nid").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"o{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b")
    return both.filter(sizes_allow(F.col("na"), F.col("nb")) & (bits_apart(F.col("oa"), F.col("ob")) <= MOST_BITS)).select("a", "b")


def _match(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    na, nb = a["n"][:, None], b["n"][None, :]
    ok = SIMILAR[1] * np.minimum(na, nb) >= SIMILAR[0] * np.maximum(na, nb)
    for i, row in enumerate(a["sketch"]):
        ok[i] &= np.bitwise_count(b["sketch"] ^ row).sum(axis=1, dtype=np.int64) <= MOST_BITS
    return ok


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, short: int = SHORT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least id that links reach), copy_id (the least id of an equal set) and kept (whether it is that least id).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z) text; a shingle is three words, or all
    of fewer. Documents link when 100 times their common shingles reach 85 times their union, which is
    counted on whole sets. A pair at the threshold is missed with a probability under 1e-6.

    Null, empty and blank texts have no shingle, link with nothing and are kept, as is a row without an id; equal
    texts link. Rows that share an id and not the text are documents of their own; of equal rows each
    has the same result. Very long texts are taken whole; an empty table gives no rows. Other columns, whatever
    their names, are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(_rows(docs))
    nodes = nodes_of(rows, "bands", "sketch")
    held = buckets(nodes.select("nid", F.explode("bands").alias("key")))
    low = held.filter(F.col("size") <= short).select("key", "nid")
    pairs = low.alias("x").join(low.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.nid") < F.col("y.nid"))).select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b"))
    long = held.filter(F.col("size") > short)
    near = verified(docs, nodes, likely(pairs.unionByName(stars(long)).distinct(), nodes), SIMILAR, WORDS, broadcast_ids)
    if long.limit(1).count():
        labels = components_of(near)
        near = near.unionByName(cross_links(docs, nodes, stars(mixed_only(long, labels, "key")), labels, _match, SIMILAR, WORDS, broadcast_ids))
    out = labelled_rows(rows.select("doc_id", "n", "s1", "s2"), nodes, near)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "copy_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
