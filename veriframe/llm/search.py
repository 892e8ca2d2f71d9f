"""Ranked lexical search as a blocked sparse matrix product.

The rows of one matrix are the items, with how often each of their terms occurs; the rows of the
other are those terms, with the impact that each document gives them, in 64-bit integers. The
product holds all scores. It is taken in blocks: a task turns a block of its documents into rows of
postings, merges the rows of an item's terms into one row of scores (Gustavson's order), and keeps
the best few of it. What tasks keep is reduced twice, first in as many parts as tasks ended alike,
then for each item, so no group grows with the documents.

Items are read in blocks of a bounded number of bytes; a block's vocabulary and its rows are all
that is sent to the tasks. The documents are turned into counts of a block's terms once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriframe.llm.common import byte_texts, chunks, materialise, release, small_batches

# Fixed values of the scoring: impacts are in millionths, b is 75 of 100, k1 is 0.8 of 100 lengths.
ONE, PER_COUNT, PER_LENGTH, SHARE = 1_000_000_000, 1000, 8, 75
BLOCK_BYTES = 4 << 20  # of item texts whose vocabulary is sent at once
BLOCK_DOCS = 4096
BLOCK_CELLS = 1 << 21  # of scores that a task holds at once
FAN = 64
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all that isn't ASCII, with A-Z lower-cased."""
    return text.translate(_TERM).split()


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """Blocks of (item_id, text) of about ``block_bytes``; a longer item is a block of its own."""
    block: list[tuple[int | None, bytes]] = []
    size = 0
    for row in items.toLocalIterator():
        text = (row[1] or "").encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text) + 64
    if block:
        yield block


def incidence(block: list[tuple[int | None, bytes]]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary of the items, and their matrix in rows: where each item's terms begin, the terms, and how often they occur."""
    vocabulary: dict[bytes, int] = {}
    ends, cols, counts = [0], [], []
    for _, text in block:
        own: dict[int, int] = {}
        for t in terms(text):
            k = vocabulary.setdefault(t, len(vocabulary))
            own[k] = own.get(k, 0) + 1
        cols.extend(own)
        counts.extend(own.values())
        ends.append(len(cols))
    return vocabulary, np.array(ends, np.int64), np.array(cols, np.int64), np.array(counts, np.int64)


COUNTED = "kind int, doc_id long, n long, terms array<int>, counts array<int>"


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Of each document with a term of the vocabulary its length and the counts of these terms (kind 0); of each task the documents with any term and
    their lengths (kind 1: n, doc_id) and the documents that hold each term of the vocabulary (kind 2)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["kind", "doc_id", "n", "terms", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        df = np.zeros(len(known), np.int64)
        some = length = 0
        for b in chunks(batches):
            texts = byte_texts(b)
            n = np.zeros(len(texts), np.int64)
            flat: list[int] = []
            ends = np.zeros(len(texts) + 1, np.int64)
            for i, t in enumerate(texts):
                words = terms(t)
                n[i] = len(words)
                flat.extend(known[w] for w in words if w in known)
                ends[i + 1] = len(flat)
            some += int((n > 0).sum())
            length += int(n.sum())
            if not flat:
                continue
            key = np.repeat(np.arange(len(texts)), np.diff(ends)) * len(known) + np.array(flat, np.int64)
            cell, count = np.unique(key, return_counts=True)
            row, term = cell // len(known), cell % len(known)
            df += np.bincount(term, minlength=len(known))
            held = np.unique(row)
            off = pa.array(np.concatenate((np.searchsorted(row, held), [len(row)])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(held), np.int32)), b.column(0).take(pa.array(held)), pa.array(n[held]), *lists], names=names)
        at = np.flatnonzero(df)
        for first in range(0, len(at), 1 << 16):
            own = at[first : first + (1 << 16)]
            one = lambda x: pa.ListArray.from_arrays(pa.array(np.array([0, len(x)], np.int32)), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), one(own), one(df[own])], names=names)
        none = pa.nulls(1, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([some], pa.int64()), pa.array([length], pa.int64()), none, none], names=names)

    return docs.mapInArrow(run, COUNTED)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` largest scores above 0, equal ones by ascending id."""
    at = np.flatnonzero(scores > 0)
    if len(at) > top:
        least = np.partition(scores[at], len(at) - top)[len(at) - top]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:top]


def product(counted: DataFrame, matrix: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """(item, part, doc_id, score): of each task the best ``top`` documents of each item of the block."""
    shared = counted.sparkSession.sparkContext.broadcast((*matrix, weights))
    width = len(weights)
    no_id = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cols, times, w = shared.value
        items = len(rows) - 1
        kept_ids = [np.zeros(0, np.int64)] * items
        kept_scores = [np.zeros(0, np.int64)] * items

        def block(ids: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
            order = np.argsort(term, kind="stable")  # the rows of the second matrix: postings by term, documents ascending
            term, row, tf = term[order], row[order], tf[order]
            m = (100 - SHARE) + (SHARE * n * documents) // length
            impact = w[term] * ((ONE * tf) // (PER_COUNT * tf + PER_LENGTH * m[row]))
            start = np.searchsorted(term, np.arange(width + 1))
            some = np.diff(start) > 0
            step = max(1, BLOCK_CELLS // len(ids))
            for first in range(0, items, step):
                last = min(items, first + step)
                scores = np.zeros((last - first, len(ids)), np.int64)
                for i in range(first, last):
                    into = scores[i - first]
                    own = slice(rows[i], rows[i + 1])
                    has = some[cols[own]]
                    for k, c in zip(cols[own][has].tolist(), times[own][has].tolist(), strict=True):
                        lo, hi = start[k], start[k + 1]
                        into[row[lo:hi]] += c * impact[lo:hi]
                    at = _best(into, ids, top)
                    if len(at):
                        all_ids, all_scores = np.concatenate((kept_ids[i], ids[at])), np.concatenate((kept_scores[i], into[at]))
                        at = _best(all_scores, all_ids, top)
                        kept_ids[i], kept_scores[i] = all_ids[at], all_scores[at]

        for b in batches:
            for first in range(0, b.num_rows, BLOCK_DOCS):
                part = b.slice(first, BLOCK_DOCS)
                lists = part.column(2)
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                ids = part.column(0).fill_null(no_id).to_numpy()
                block(ids, part.column(1).to_numpy(), row, lists.flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy().astype(np.int64))
        sizes = np.array([len(x) for x in kept_ids], np.int64)
        if sizes.sum():
            ids = np.concatenate(kept_ids)
            part = np.full(len(ids), TaskContext.get().partitionId() % FAN, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(items), sizes).astype(np.int32)), pa.array(part), pa.array(ids, mask=ids == no_id), pa.array(np.concatenate(kept_scores))], names=["item", "part", "doc_id", "score"]
            )
        release()

    return counted.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, part int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item by score, highest first, equal scores by ascending id; only scores above 0.

    Terms are runs of ASCII letters, digits and characters beyond ASCII of whole texts, A-Z
    lower-cased. N documents have a term, L is the number of all their terms, n of one document's,
    df of the documents that hold a term, tf how often one does. A term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 25 + (75 n N) div L, and its score the
    sum of weight * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included.

    Each row of ``items`` is an item, those that share an id too; each row of ``docs`` is a document,
    so equal rows take ranks of their own. Null and empty texts have no terms: such an item has no
    row, such a document counts nowhere. A null id stays null and stands behind all others of its
    score. Very long texts are counted whole. Empty tables give no rows. Other columns of either
    table, whatever their names, are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    found: list[DataFrame] = []
    for block in item_blocks(items, block_bytes):
        vocabulary, *matrix = incidence(block)
        if not vocabulary:
            continue
        counted = materialise(count_terms(docs, vocabulary))
        some, length = counted.filter("kind = 1").agg(F.coalesce(F.sum("doc_id"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not some:
            break
        holding = np.zeros(len(vocabulary), np.int64)
        df = counted.filter("kind = 2").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("c")).toArrow()
        holding[df["terms"].to_numpy()] = df["c"].to_numpy()
        weights = np.array([weight(some, x) for x in holding.tolist()], np.int64)
        best = product(counted.filter("kind = 0"), tuple(matrix), weights, some, length, top)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (("item", "part"), ("item",)):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
        ids = spark.createDataFrame([Row(item=i, item_id=x[0]) for i, x in enumerate(block)], "item int, item_id long")
        found.append(materialise(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
