"""N-gram Jaccard join as a blocked sparse matrix product.

A document is a row of the document by shingle incidence matrix; equal rows are one. The product of the matrix with
its transpose counts the shingles that two documents share. Only a block of it can hold a link:
with the shingles in one global order, frequent ones last, two documents of similarity t share
one within the first ``n - ceil(t n) + 1`` of each. The product is taken over that block, grouped
by shingle. A link needs ``need = ceil(t / (1 + t) (n_a + n_b))`` common shingles, so the first of
them stands at place ``n - need`` or before in both. Entries of the block that break this bound are
discarded as they arise. The others are added up: a pair's overlap count within
the block, and the shingles that follow its last common one in both, bound the whole overlap, and
pairs below what a link needs are discarded. So are those whose sets differ in more than ``n_a + n_b - 2 need``
shingles, which the bits of their parities bound from below. The counts of the pairs that stay are then completed
over the whole of their rows, exactly.

The product takes all pairs of a shingle that at most ``SHORT`` rows of the block hold. A shingle
that more of them hold (one of a large group of near copies, or of a passage that many documents
share) is a longer bucket (``similar.py``): its rows meet the smallest of them and, where different
components are left, those of like size meet in blocks, under the bounds of places and of parities at once, and then of whole
parities among those that these connect; the product of the whole rows of what these leave is taken in blocks too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import byte_texts, chunks, materialise, small_batches
from veriframe.llm.similar import BROADCAST_IDS, SHORT, buckets, components_of, cross_links, labelled_rows, likely_edges, mixed_only, nodes_of, shingle_sets, signature, stars, verified

SHINGLE = 5
NUMER, DENOM = 3, 4  # the similarity 0.75, exactly
HEAVY_HERE, HEAVY = 3, 6  # documents of one chunk, and of all chunks, from which a shingle counts as frequent
HEAVY_KEPT = 1 << 17  # frequent shingles that are ordered by their count; others by their hash alone
PARITY = 512  # the least number of parity bits
TAG = 1 << 7  # of a set in its entries; two sets of one id that share a tag only meet more candidates


def parities(x: np.ndarray) -> np.ndarray:
    """Bits that say of which classes of shingles the set has an odd number; about two classes a shingle.

    Equal shingles cancel out, so two sets differ in at least as many shingles as their parities
    in bits. The number of classes is a power of two: halves of a longer one fold into a shorter.
    """
    size = max(PARITY, 1 << int(2 * len(x) - 1).bit_length())
    return np.packbits((np.bincount((x >> np.uint64(16)).astype(np.int64) & (size - 1), minlength=size) & 1).astype(np.uint8))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def needed(na: int, nb: int) -> int:
    """The common shingles that a link of sets of these sizes needs."""
    return -(-NUMER * (na + nb) // (NUMER + DENOM))


def _needed(na: Column, nb: Column) -> Column:
    return F.ceil(F.lit(float(NUMER)) * (na + nb) / (NUMER + DENOM) - 1e-9)


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose sizes and parities allow a link."""
    x, y = (nodes.select(F.col("nid").alias(k), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"o{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "oa", "ob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for na, nb, p, q in zip(*(t.column(k).to_pylist() for k in range(2, 6)), strict=True):
                need = needed(na, nb)
                u, v = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
                size = min(len(u), len(v))
                keep.append(need <= min(na, nb) and int(np.bitwise_count(folded(u, size) ^ folded(v, size)).sum()) <= na + nb - 2 * need)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(mask), t.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def prefix_length(n: int) -> int:
    return n - -(-NUMER * n // DENOM) + 1


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its set's size and signature and their parities (kind 0); of each chunk its frequent shingles (kind 1: s1, n)."""
    names = ["kind", "doc_id", "n", "s1", "s2", "odd"]
    for b in chunks(batches):
        sets = shingle_sets(byte_texts(b), SHINGLE)
        n = np.array([len(x) for x in sets], np.int32)
        signed = [signature(x) for x in sets]
        one, two = (np.array(c, np.int64) for c in zip(*signed, strict=True))
        bits = [parities(x) if len(x) else None for x in sets]
        odd = [None if x is None else x.tobytes() for x in bits]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), b.column(0), pa.array(n), pa.array(one), pa.array(two), pa.array(odd, pa.binary())], names=names)
        fresh = {s: x for s, x in zip(signed, sets, strict=True) if len(x)}
        if fresh:
            h, c = np.unique(np.concatenate(list(fresh.values())), return_counts=True)
            h, c = h[c >= HEAVY_HERE], c[c >= HEAVY_HERE]
            if len(h):
                none = pa.nulls(len(h), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), none, pa.array(c.astype(np.int32)), pa.array(h.view(np.int64)), none, pa.nulls(len(h), pa.binary())], names=names)


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of ``key``, those whose key occurs more than once; holds one row back."""
    last: pa.RecordBatch | None = None  # the last row, if its key occurred once so far
    key: int | None = None
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy(zero_copy_only=False)
        before = np.concatenate(([key is not None and h[0] == key], h[1:] == h[:-1]))
        after = np.concatenate((h[1:] == h[:-1], [False]))
        keep = before | after
        if last is not None and before[0]:
            yield last
        out = b.filter(pa.array(keep))
        if out.num_rows:
            yield out
        last = None if keep[-1] else b.slice(b.num_rows - 1)
        key = h[-1]


ENTRY = "key long, doc_id long, tag short, i int"


def entries(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The block: of each row the shingles (key) that stand first in the global order, with their places. ``tag`` tells sets of one id apart."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, level = shared.value
        for b in chunks(batches):
            hs, ds, ts, ns = [], [], [], []
            for i, x in zip(b.column(0).to_pylist(), shingle_sets(byte_texts(b), SHINGLE), strict=True):
                if i is None or not len(x):
                    continue
                p = prefix_length(len(x))
                y = x
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                    cls = np.where(keys[at] == x, level[at], np.uint8(0))
                    if cls.any():
                        y = x[np.argsort(cls, kind="stable")]
                hs.append(y[:p])
                ds.append(np.full(p, i, np.int64))
                ts.append(np.full(p, signature(x)[0] % TAG, np.int16))
                ns.append(np.arange(p, dtype=np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), *(pa.array(np.concatenate(c)) for c in (ds, ts, ns))], names=["key", "doc_id", "tag", "i"])

    return docs.mapInArrow(run, ENTRY)


def _by_length(sketch: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Parities of one length: their rows, and the bits as 64-bit numbers."""
    size = np.array([len(x) for x in sketch], np.int64)
    return {k: (rows := np.flatnonzero(size == k), np.frombuffer(b"".join(sketch[rows]), np.uint64).reshape(len(rows), -1)) for k in np.unique(size).tolist()}


def _match(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Whether sizes and parities allow a link: rows of ``a`` by rows of ``b``."""
    na, nb = a["n"][:, None], b["n"][None, :]
    need = -(-NUMER * (na + nb) // (NUMER + DENOM))
    ok = need <= np.minimum(na, nb)
    most = na + nb - 2 * need

    def fold(bits: np.ndarray, size: int) -> np.ndarray:
        while bits.shape[1] > size:
            bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
        return bits

    ours, theirs = _by_length(a["sketch"]), _by_length(b["sketch"])
    for rows, x in ours.values():
        for cols, y in theirs.values():
            size = min(x.shape[1], y.shape[1])
            other = fold(y, size)
            for i, row in zip(rows.tolist(), fold(x, size), strict=True):
                if ok[i, cols].any():
                    ok[i, cols] &= np.bitwise_count(other ^ row).sum(axis=1, dtype=np.int64) <= most[i, cols]
    return ok


def _match_bands(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Two rows from the band above are compared there."""
    return _match(a, b) & ~((a["above"][:, None] == 1) & (b["above"][None, :] == 1))


PAIRS_AT_ONCE = 1 << 16  # pairs of entries whose parities are held against each other at a time


def _match_entries(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Whether sizes, places and parities of entries of one shingle allow a link of different components; two rows from the band above are compared there."""
    na, nb = a["n"][:, None], b["n"][None, :]
    need = -(-NUMER * (na + nb) // (NUMER + DENOM))
    ok = (need <= np.minimum(na, nb)) & (a["i"][:, None] <= na - need) & (b["i"][None, :] <= nb - need)
    ok &= ~((a["above"][:, None] == 1) & (b["above"][None, :] == 1)) & (a["comp"][:, None] != b["comp"][None, :])
    rows, cols = np.nonzero(ok)
    if not len(rows):
        return ok
    size = min(len(x) for side in (a, b) for x in side["sketch"])
    ours, theirs = (np.frombuffer(b"".join(folded(np.frombuffer(x, np.uint8), size).tobytes() for x in side["sketch"]), np.uint64).reshape(len(side["n"]), -1) for side in (a, b))
    for first in range(0, len(rows), PAIRS_AT_ONCE):
        i, j = rows[first : first + PAIRS_AT_ONCE], cols[first : first + PAIRS_AT_ONCE]
        apart = np.bitwise_count(ours[i] ^ theirs[j]).sum(axis=1, dtype=np.int64)
        ok[i, j] = apart <= a["n"][i] + b["n"][j] - 2 * need[i, j]
    return ok


def halved(nodes: DataFrame) -> DataFrame:
    """(nid, sketch): the parities in half their length, which bound as well and go along with every entry of a long bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [folded(x := np.frombuffer(o, np.uint8), len(x) // 2).tobytes() for o in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(short, pa.binary())], names=["nid", "sketch"])

    return nodes.select("nid", "odd").mapInArrow(run, "nid long, sketch binary")


def by_size(long: DataFrame) -> DataFrame:
    """Entries (key, nid, n, ...) by bands of sizes within a factor of 4 / 3: each in its own band and, as ``above``, in the one below."""
    own = F.floor(F.log("n") / math.log(DENOM / NUMER)).cast("int")
    both = long.withColumn("above", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", own - F.col("above"))
    some = both.groupBy("key", "band").agg(F.count("*").alias("c"), F.min("above").alias("least")).filter("c > 1 and least = 0").select("key", "band")
    return both.join(some, ["key", "band"], "left_semi")


def product(held: DataFrame, short: int = SHORT) -> DataFrame:
    """Candidates (a, b) of the shingles that at most ``short`` rows hold, by their overlap counts; ``held``: key, nid, i, n, size."""
    slim = held.filter(F.col("size") <= short).select("key", "nid", "i", "n")
    x, y = slim.alias("x"), slim.alias("y")
    need = _needed(F.col("x.n"), F.col("y.n"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.nid") < F.col("y.nid")) & (F.col("x.i") <= F.col("x.n") - need) & (F.col("y.i") <= F.col("y.n") - need))
    met = met.select(F.col("x.nid").alias("a"), F.col("y.nid").alias("b"), *[F.col(f"{s}.{c}").alias(f"{c}_{k}") for s, k in (("x", "a"), ("y", "b")) for c in ("n", "i")])
    met = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("overlap"), F.max("i_a").alias("i_a"), F.max("i_b").alias("i_b"))
    # Common shingles stand in one order in both, so those not counted here or in longer buckets follow the last one counted.
    # What longer buckets may add to a pair's overlap is at most what either row has in them.
    more = held.filter(F.col("size") > short).groupBy("nid").agg(F.count("*").alias("more"))
    for k in "ab":
        met = met.join(more.select(F.col("nid").alias(k), F.col("more").alias(f"more_{k}")), k, "left")
    added = F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    most = F.col("overlap") + added + F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) - 1
    return met.filter(most >= _needed(F.col("n_a"), F.col("n_b"))).select("a", "b")


def links(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS, short: int = SHORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, s1, s2), nodes, and (a, b) links between nodes whose components are those of all links; ``docs``: doc_id, text."""
    spark = docs.sparkSession
    first = materialise(docs.mapInArrow(_signatures, "kind int, doc_id long, n int, s1 long, s2 long, odd binary"))
    rows = first.filter("kind = 0")
    nodes = nodes_of(rows, "odd")
    heavy = first.filter("kind = 1").groupBy("s1").agg(F.sum("n").alias("c")).filter(F.col("c") >= HEAVY).orderBy(F.desc("c"), "s1").limit(HEAVY_KEPT).collect()
    order = sorted((r.s1 & 0xFFFFFFFFFFFFFFFF, int(r.c).bit_length()) for r in heavy)
    block = entries(docs, (np.array([x[0] for x in order], np.uint64), np.array([x[1] for x in order], np.uint8)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = block.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shared_only, ENTRY)
    # Of copies one row's entries stay: those of the row that its node is named after.
    named = nodes.select(F.col("first").alias("doc_id"), F.pmod("s1", F.lit(TAG)).cast("short").alias("tag"), "nid", "n")
    post = materialise(block.join(named, ["doc_id", "tag"]).groupBy("key", "nid", "n").agg(F.min("i").alias("i")))
    held = buckets(post)
    found = product(held, short)
    long = held.filter(F.col("size") > short)
    near = verified(docs, nodes, possible(found.unionByName(stars(long)).distinct(), nodes), (NUMER, DENOM), SHINGLE, broadcast_ids)
    if long.limit(1).count():
        # First by sizes, places and short parities within a shingle's rows, so that rows which only share a passage never meet
        # outside its buckets; then by whole parities among the rows that these connect; then by whole rows.
        labels, sketched = components_of(near), nodes.withColumnRenamed("odd", "sketch")
        placed = mixed_only(by_size(long).select("key", "band", "above", "nid", "n", "i"), labels, "key", "band")
        near_places = likely_edges(placed.join(halved(nodes), "nid"), _match_entries, ["key", "band"], ["n", "i", "above", "comp"])
        pools = components_of(near_places).withColumnRenamed("label", "key")
        pooled = mixed_only(by_size(pools.join(nodes.select("nid", "n"), "nid")).select("key", "band", "above", "nid", "n"), labels, "key", "band")
        edges = likely_edges(pooled.join(sketched.select("nid", "sketch"), "nid"), _match_bands, ["key", "band"], ["n", "above"])
        near = near.unionByName(cross_links(docs, sketched, edges, labels, _match, (NUMER, DENOM), SHINGLE, broadcast_ids))
    return rows.select("doc_id", "n", "s1", "s2"), nodes, near


def _labelled(docs: DataFrame, id_col: str, text_col: str, broadcast_ids: int, short: int) -> DataFrame:
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return labelled_rows(*links(slim, broadcast_ids, short))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, short: int = SHORT) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id reachable by links, its own included.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z) text; a shingle is five words, or all
    of fewer. Documents link when 100 times their common shingles reach 75 times their union.
    Null, empty and blank texts have no shingle and link with nothing; equal texts link; a row
    without an id has no component. Rows that share an id and not the text are documents of their own; of equal
    rows each has the same result. Very long texts are taken whole; an empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    out = _labelled(docs, id_col, text_col, broadcast_ids, short)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, short: int = SHORT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row, of the least id; of several of its sets with that id the one of the
    least signature, of several rows of that set the least. Rows without words or without an id all stay.

    Only equal or linked sets go, so different documents under one id stay side by side, however the rows are dealt.
    """
    columns = docs.columns
    found = materialise(_labelled(docs, id_col, text_col, broadcast_ids, short).filter("doc_id is not null").select("doc_id", "n", "s1", "s2", "chosen"))
    many = materialise(found.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id"))
    n = many.count()
    few = lambda ids, n: F.broadcast(ids) if n <= broadcast_ids else ids
    gone = materialise(found.filter("not chosen").select("doc_id").distinct())
    key = F.col(id_col).cast("long") == F.col("_id")
    drop = gone if not n else gone.unionByName(many)
    drop = drop.select(F.col("doc_id").alias("_id"))
    kept = docs.join(few(drop, gone.count() + n), key, "left_anti")
    if not n:
        return kept.select(columns)
    # Ids that repeat: which set a row has is read again.
    again = docs.join(few(many.select(F.col("doc_id").alias("_id")), n), key, "left_semi")
    packed = again.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            sets = shingle_sets(byte_texts(b), SHINGLE)
            one, two = zip(*(signature(x) for x in sets), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in sets], pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["row", "doc_id", "text", "n", "s1", "s2"])

    schema = packed.selectExpr("*", "0 AS n", "0L AS s1", "0L AS s2").schema
    of = packed.mapInArrow(signed, schema)
    wanted = found.filter("chosen and n > 0").join(few(many, n), "doc_id", "left_semi").select("doc_id", "n", "s1", "s2").distinct()
    one = of.filter("n > 0").groupBy("doc_id", "n", "s1", "s2").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    one = one.join(wanted, ["doc_id", "n", "s1", "s2"], "left_semi")
    return kept.select(columns).unionByName(one.select("row.*")).unionByName(of.filter("n = 0").select("row.*"))
