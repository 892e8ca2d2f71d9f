"""What the joins of documents by their shingle sets share: sets, nodes, candidate pairs from buckets, exact checks, components.

A node is one set of shingles; rows of equal sets are one node, rows that share an id but not the set
are several. Candidates stand in buckets of one key. Buckets of at most ``SHORT`` nodes give all their
pairs. In a longer bucket each node first meets the smallest one only; once the links found so far are
joined to components, the nodes of buckets that still hold different ones are pooled, and pools are compared in
blocks of whole sets, inside the tasks; only links that join components leave them. So no bucket is squared into
rows, none is cut, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import LOWER, byte_texts, chunks, joined, materialise, mix64, release, word_hashes
from veriframe.llm.components import connected

SHORT = 16
BLOCK, COMPARED_AT_ONCE = 16_384, 128  # entries of a bucket's block, on average, and rows of it that are compared with another at a time
BLOCK_BYTES = 2 << 20  # of the sets of a pool's block
PARTNERS = 256  # nodes that a set is sent once for
BROADCAST_IDS = 1_000_000
LONGEST_SHINGLE = 16
_C = mix64(np.arange(11, 11 + LONGEST_SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Of each text its distinct shingles' hashes, ascending; a text of fewer words has one of all."""
    buf, off = joined(texts, pad=1)
    low = LOWER[buf]
    low[off[1:] - 1] = 10
    h, starts, _ = word_hashes(low)
    wo = np.searchsorted(starts, off)
    n = len(h) - words + 1
    s = np.zeros(0, np.uint64)
    if n > 0:
        s = np.zeros(n, np.uint64)
        for k in range(words):
            s += h[k : k + n] * _C[k]
        s = mix64(s)
    out = []
    for a, b in zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(s[a : b - words + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            x = mix64(((h[a:b] * _C[: b - a]).sum(keepdims=True, dtype=np.uint64)) ^ np.uint64(0xABCDEF00 + b - a))
        else:
            x = np.zeros(0, np.uint64)
        out.append(x)
    return out


def signature(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    one, two = x.sum(dtype=np.uint64), mix64(x ^ np.uint64(0x5555)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def nodes_of(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each set of ``rows`` (doc_id, n, s1, s2, ...) with words and an id: nid, n, s1, s2, first (the least id) and ``more``.

    Copies meet after a partial aggregate, so a large group of them sends one row from each task.
    """
    full = rows.filter("n > 0 and doc_id is not null")
    found = full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("first"), *[F.any_value(c).alias(c) for c in more])
    return materialise(found.withColumn("nid", F.monotonically_increasing_id()))


def buckets(entries: DataFrame) -> DataFrame:
    """``entries`` (key, nid, ...) of keys that several nodes have, with the bucket's size and its least node."""
    sized = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("nid").alias("pivot")).filter("size > 1")
    return materialise(entries.join(sized, "key"))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in chunks(batches):
            rows = []
            for x in shingle_sets(byte_texts(b), words):
                s = signature(x)
                if len(x) and s not in seen:
                    seen.add(s)
                    rows.append((*s, len(x), x.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["s1", "s2", "n", "items"])

    return docs.mapInArrow(run, "s1 long, s2 long, n int, items binary")


def sets_of(docs: DataFrame, nodes: DataFrame, ids: DataFrame, words: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(nid, items) of the nodes ``ids`` (nid), from their texts, which are read again."""
    wanted = materialise(nodes.join(ids.distinct(), "nid", "left_semi").select("nid", "s1", "s2", "n", F.col("first").alias("doc_id")))
    small = wanted.count() <= broadcast_ids
    keys = wanted.select("doc_id").distinct()
    texts = docs.join(F.broadcast(keys) if small else keys, "doc_id", "left_semi").select("text")
    return materialise(_sets(texts, words).join(wanted.select("nid", "s1", "s2", "n"), ["s1", "s2", "n"]).select("nid", "items").dropDuplicates(["nid"]))


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similar: tuple[int, int], words: int = 5, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose sets have a similarity of at least ``similar`` (as a fraction), counted over the whole sets.

    A node's set goes to its partners' tasks once for some ``PARTNERS`` of them, and is held while theirs pass by.
    """
    numer, denom = similar
    pairs = materialise(pairs.select("a", "b").distinct())
    ids = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid")))
    sets = sets_of(docs, nodes, ids, words, broadcast_ids)
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    left = salts.join(sets, F.col("a") == F.col("nid")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "items")
    right = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b").join(sets, F.col("b") == F.col("nid")).select("a", "salt", "b", "items")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for a, b, items in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                y = np.frombuffer(items.as_buffer(), np.uint64)
                if b is None:
                    x = y.copy()
                    continue
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if denom * shared >= numer * (len(x) + len(y) - shared):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])
        release()

    rows = left.unionByName(right).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return materialise(rows.mapInArrow(run, "a long, b long"))


def forest(nid: list[int], comp: list[int], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, may: np.ndarray, similar: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between rows of ``left`` and of ``right`` that join components, each only once; ``may`` says which pairs are worth counting.

    The overlaps of a row with all rows on the right are one row of a sparse matrix product: the
    postings of its shingles, added up.
    """
    numer, denom = similar
    root: dict[int, int] = {c: c for c in comp}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    flat = np.concatenate([sets[j] for j in right])
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(flat, kind="stable")
    shingles, start = np.unique(flat[order], return_index=True)
    start = np.append(start, len(flat))
    holder = np.repeat(np.arange(len(right)), sizes[right])[order]
    out = []
    for i, row in zip(left.tolist(), may, strict=True):
        own = find(comp[i])
        open_ = np.flatnonzero(row)
        if not len(open_) or all(find(comp[right[j]]) == own for j in open_.tolist()):
            continue
        at = np.minimum(np.searchsorted(shingles, sets[i]), len(shingles) - 1)
        at = at[shingles[at] == sets[i]]
        size = start[at + 1] - start[at]
        postings = np.repeat(start[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(at) else np.zeros(0, np.int64)
        shared = np.bincount(holder[postings], minlength=len(right))[open_]
        for j in open_[denom * shared >= numer * (sizes[i] + sizes[right[open_]] - shared)].tolist():
            k = int(right[j])
            x, y = find(comp[i]), find(comp[k])
            if x != y:
                root[x] = y
                out.append((nid[i], nid[k]))
    return out


def mixed_only(long: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """Of entries (``keys``, nid, ...) those whose bucket holds several components of ``labels`` (nid, label), with their component (comp)."""
    known = long.join(labels, "nid", "left").withColumn("comp", F.coalesce("label", "nid")).drop("label")
    mixed = known.groupBy(*keys).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(*keys)
    return materialise(known.join(mixed, list(keys), "left_semi"))


def stars(entries: DataFrame) -> DataFrame:
    """(a, b): the least node of each bucket and each other one; ``entries``: key, nid, pivot."""
    return entries.filter("nid <> pivot").select(F.col("pivot").alias("a"), F.col("nid").alias("b"))


def cells(dealt: DataFrame, keys: list[str], compare: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) that ``compare`` returns for the rows of each cell, one at a time; ``keys`` are the first columns, whole numbers."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell: tuple | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = compare(pa.Table.from_batches(held)) if held else []
            held.clear()
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(k).to_numpy() for k in range(len(keys))]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
            for first, last in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
                now = tuple(int(x[first]) for x in at)
                if now != cell:
                    yield from flush()
                    cell = now
                held.append(b.slice(first, last - first))
        yield from flush()
        release()

    return materialise(dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long"))


def in_blocks(entries: DataFrame, *keys: str) -> DataFrame:
    """``entries`` with ``blocks`` of their bucket dealt to the cells of pairs of blocks: own (the entry's block), lo and hi (the cell's)."""
    own = F.pmod(F.xxhash64("nid", F.lit(3)), F.col("blocks")).cast("int")
    dealt = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *[c for c in dealt.columns if c not in (*keys, "other", "blocks")])


def sketches(cell: pa.Table) -> np.ndarray:
    """The column ``sketch``: rows of 64-bit numbers, or byte strings as they are."""
    column = cell.column("sketch")
    if pa.types.is_list(column.type):
        return np.array(column.to_pylist(), np.int64).view(np.uint64)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def likely_edges(entries: DataFrame, match: Callable[[dict, dict], np.ndarray], keys: list[str], names: list[str], block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect, within each bucket, the nodes of different components of which ``match`` says that they may be linked.

    ``entries``: keys, nid, comp, the numbers ``names`` and, where ``match`` uses it, sketch. Of a cell come fewer edges than nodes.
    """
    sized = entries.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = in_blocks(entries.join(sized, keys), *keys)

    def compare(cell: pa.Table) -> list[tuple[int, int]]:
        own, lo, hi, nid, comp = (cell.column(k).to_numpy() for k in ("own", "lo", "hi", "nid", "comp"))
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(left) or not len(right) or comp.min() == comp.max():
            return []
        cols = {k: cell.column(k).to_numpy().astype(np.int64) for k in names}
        if "sketch" in cell.column_names:
            cols["sketch"] = sketches(cell)
        group, out, theirs = np.arange(len(nid)), [], {k: c[right] for k, c in cols.items()}
        for first in range(0, len(left), COMPARED_AT_ONCE):
            rows = left[first : first + COMPARED_AT_ONCE]
            may = match({k: c[rows] for k, c in cols.items()}, theirs) & (comp[rows][:, None] != comp[right][None, :])
            for i in np.flatnonzero(may.any(axis=1)).tolist():
                x = rows[i]
                for y in right[may[i]]:
                    if group[x] != group[y]:
                        group[group == group[y]] = group[x]
                        out.append((int(nid[x]), int(nid[y])))
        return out

    return cells(dealt, [*keys, "lo", "hi"], compare)


def components_of(links: DataFrame) -> DataFrame:
    """(nid, label) of the nodes of ``links``."""
    return connected(links).select(F.col("node").alias("nid"), "label")


def cross_links(docs: DataFrame, nodes: DataFrame, edges: DataFrame, labels: DataFrame, match: Callable[[dict, dict], np.ndarray], similar: tuple[int, int], words: int, broadcast_ids: int = BROADCAST_IDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) that join components of ``labels`` among nodes that ``edges`` connect, on whole sets.

    Nodes that edges connect are one pool. Its sets are dealt by a hash into blocks of about ``block_bytes``, and every
    pair of blocks is a cell: a task holds two blocks at a time, compares what ``match`` (on arrays n and sketch of two blocks) leaves, and
    returns no more links than join components. ``nodes`` has a column ``sketch``.
    """
    pool = connected(edges).select(F.col("node").alias("nid"), F.col("label").alias("pool"))
    member = materialise(pool.join(labels, "nid", "left").select("nid", "pool", F.coalesce("label", "nid").alias("comp")))
    sets = sets_of(docs, nodes, member.select("nid"), words, broadcast_ids)
    member = member.join(nodes.select("nid", "n", "sketch"), "nid")
    blocks = member.groupBy("pool").agg(F.ceil(F.sum(F.col("n").cast("long") * 8) / block_bytes).cast("int").alias("blocks"))
    dealt = in_blocks(member.join(blocks, "pool").join(sets, "nid"), "pool")

    def compare(cell: pa.Table) -> list[tuple[int, int]]:
        own, lo, hi, n, nid = (cell.column(k).to_numpy() for k in ("own", "lo", "hi", "n", "nid"))
        comp = cell.column("comp").to_numpy()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(left) or not len(right) or comp.min() == comp.max():
            return []
        sketch = sketches(cell)
        a, b = ({"n": n[side].astype(np.int64), "sketch": sketch[side]} for side in (left, right))
        may = match(a, b) & (comp[left][:, None] != comp[right][None, :])
        if lo[0] == hi[0]:
            may &= nid[left][:, None] < nid[right][None, :]
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in cell.column("items").chunks for x in chunk]
        return forest(nid.tolist(), comp.tolist(), sets, left, right, may, similar)

    return cells(dealt, ["pool", "lo", "hi"], compare)


def labelled_rows(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with component_id, the least id that links reach, copy_id, the least id of an equal set, and chosen, whether
    the row is its component's: of the least id and, of several sets with that id, of the least signature.

    A row without words or an id is its own. The nodes have one row a key, so a join splits a large group of copies.
    """
    label = connected(edges).withColumnRenamed("node", "nid")
    of = nodes.select("nid", "s1", "s2", "n", "first").join(label, "nid", "left")
    node = F.struct("first", "s1", "s2", "n")
    least = of.filter("label is not null").groupBy("label").agg(F.min(node).alias("least"))
    chosen = F.coalesce(F.col("least") == node, F.lit(True))
    named = of.join(least, "label", "left").select("s1", "s2", "n", F.col("first").alias("copy_id"), F.coalesce("least.first", "first").alias("component_id"), chosen.alias("chosen"))
    out = rows.join(named, ["s1", "s2", "n"], "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = out.withColumn("chosen", ~own | (F.col("chosen") & (F.col("doc_id") == F.col("copy_id"))))
    return out.withColumns({c: F.when(own, F.col(c)).otherwise(F.col("doc_id")) for c in ("component_id", "copy_id")})
