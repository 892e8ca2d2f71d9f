"""How far the sources of a language lie apart, and by which terms, as a tournament of groups.

A group is one source of one language. Its counts of the language's kept terms become a vector of
fixed-point probabilities, cut into shards of about ``SHARD_TERMS`` terms each. Within a language and
shard, groups are dealt to cells, and a cell's groups stay with it. Vectors travel compressed, a cell's
at a time: in each round of a round-robin tournament every cell meets one other, at the home of either,
and a meeting gives the distances in both directions. A task reads a cell's own groups, then its
visitors in the order of rounds, so it holds two cells at most. The distances of the shards are added up
exactly. A cell also ranks its groups' own terms against the language in heaps, of which only the best are kept.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriframe.llm.common import byte_texts, chunks, materialise, release, small_batches

# Fixed values of the measure.
SCALE, ADDED = 1_000_000_000, 5
LEAST_DOCS, TOP = 30, 50
SHARD_TERMS = 1 << 15
CELL_GROUPS, LEAST_CELLS = 64, 8  # groups of a cell at most on average; cells of a language at least, if it has so many groups
COUNTED_AT_ONCE = 250_000
LANGUAGE, OWN = -2, -1  # rounds before the tournament: the language's vector, the cell's own groups
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and all that isn't ASCII, with A-Z lower-cased."""
    return text.translate(_TERM).split()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exactly: three divisions of three digits each."""
    rest, below, out = count + ADDED, total + ADDED * kept, F.lit(1).cast("long")
    for digits in (1_000_000, 1000, 1):
        grown = rest * 1000
        out, rest = out + digits * _div(grown, below), F.pmod(grown, below)
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; each group has a row of a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            for (lang, source), (n, d) in seen.items():
                for col, values in zip(cols, ([lang] * (len(n) + 1), [source] * (len(n) + 1), [None, *n], [0, *n.values()], [0, *(d[t] for t in n)]), strict=True):
                    col.extend(values)
            seen.clear()
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            arrays[2] = arrays[2].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

        for b in chunks(batches):
            langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, byte_texts(b), strict=True):
                n, d = seen.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                words = terms(text)
                n.update(words)
                d.update(set(words))
                held += len(n) - before
            if held > COUNTED_AT_ONCE:
                yield flush()
                held = 0
        if seen:
            yield flush()

    counted = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def round_of(a: int, b: int, cells: int) -> int:
    """The round of a tournament of ``cells`` (a < b) in which the two meet: the last one stands still, the others turn around it."""
    turning = cells - 1 + cells % 2  # an odd number turns around a bye
    return 2 * a % turning if b == turning else (a + b) % turning


def host_of(a: int, b: int) -> int:
    return a if (a + b) % 2 else b


def packed(positions: list[int], values: list[int]) -> bytes:
    order = np.argsort(np.array(positions, np.int64), kind="stable")
    at = np.array(positions, np.uint32)[order]
    at[1:] -= at[:-1].copy()
    return zstandard.ZstdCompressor(level=1).compress(at.tobytes() + np.array(values, np.uint32)[order].tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32)
    return np.cumsum(both[: len(both) // 2], dtype=np.int64), both[len(both) // 2 :].astype(np.int64)


def _pack(segments: DataFrame) -> DataFrame:
    """Replaces ``at`` and ``p``, lists, by one compressed vector."""
    keep = [c for c in segments.columns if c not in ("at", "p")]
    schema = segments.select(*keep).schema.add("vector", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [packed(x or [], y or []) for x, y in zip(b.column(b.schema.get_field_index("at")).to_pylist(), b.column(b.schema.get_field_index("p")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(vectors, pa.binary())], names=[*keep, "vector"])

    return segments.mapInArrow(run, schema)


MET = "part string, lang string, shard int, source string, item string, at int, value long"


def meet(rows: Iterator[tuple], top: int) -> Iterator[tuple]:
    """The rows (lang, shard, cell, round, source, terms, absent, vector) of cells, in this order, into distances and ranked terms."""
    home: tuple | None = None
    own: list[tuple[str, np.ndarray]] = []
    language = np.zeros(0, np.int64)
    stack = np.zeros((0, 0), np.int64)
    for lang, shard, cell, when, source, size, absent, data in rows:
        if (lang, shard, cell) != home:
            home, own, language = (lang, shard, cell), [], np.zeros(size, np.int64)
            stack = np.zeros((0, size), np.int64)
        at, p = unpacked(data)
        dense = np.full(size, absent, np.int64)
        dense[at] = p
        if when == LANGUAGE:
            language = dense
            continue
        if when == OWN:
            over = p - language[at]
            best = heapq.nsmallest(top, zip((-over[over > 0]).tolist(), at[over > 0].tolist(), strict=True))
            yield from (("term", lang, shard, source, None, i, -v) for v, i in best)
        elif len(stack) != len(own):
            stack = np.array([v for _, v in own])
        for (other, v), far in zip(own, (np.abs(stack - dense).sum(axis=1) if when != OWN else (np.abs(v - dense).sum() for _, v in own)), strict=True):
            yield "pair", lang, shard, source, other, None, int(far)
            yield "pair", lang, shard, other, source, None, int(far)
        if when == OWN:
            own.append((source, dense))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, shard_terms: int = SHARD_TERMS, cell_groups: int = CELL_GROUPS, least_cells: int = LEAST_CELLS) -> DataFrame:
    """lang, source, part, item, value and rank.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps
    the terms of at least ``least_docs`` of its documents. A group and a language give a kept term
    p = 1 + floor(10^9 (count + 5) / (N + 5 V)). Part ``pair`` has, for each group, every other
    source of its language with the sum of the differences of p, largest first; part ``term`` the
    ``top`` terms that the group holds with a p above the language's. Ties go by the item's bytes.

    Null text, lang and source count as ''. Each row is a document, equal rows too. A group without
    terms takes part in ``pair``; where a language keeps no term all values are 0; a language of
    one source has no pairs. Very long texts are counted whole; an empty table gives no rows. Other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = materialise(count_terms(docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))))
    groups = counted.filter("term is null").select("lang", "source")
    sized = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    common = counted.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    common = materialise(common.select("lang", "term", "n"))
    whole = common.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    # Of each language: kept terms and their occurrences, the shards of its terms and the cells of its groups.
    facts = sized.join(whole, "lang", "left").select("lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"), "sources")
    facts = facts.withColumn("shards", F.greatest(F.ceil(F.col("kept") / shard_terms), F.lit(1)).cast("int")).withColumn("cells", F.greatest(F.ceil(F.col("sources") / cell_groups), F.least("sources", F.lit(least_cells))).cast("int"))
    facts = materialise(facts)
    # A term's place in its shard follows its bytes, so that heaps of places break ties as terms do.
    numbered = common.join(facts, "lang").withColumn("shard", F.pmod(F.xxhash64("term", F.lit(1)), F.col("shards")).cast("int"))
    place = F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1
    numbered = materialise(numbered.select("lang", "term", "shard", place.alias("at"), share(F.col("n"), F.col("total"), F.col("kept")).cast("int").alias("q")))
    sizes = numbered.groupBy("lang", "shard").agg(F.count("*").cast("int").alias("size"))

    held = materialise(counted.filter("term is not null and n > 0").join(numbered.select("lang", "term", "shard", "at"), ["lang", "term"]).select("lang", "source", "shard", "at", "n"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    cell = F.pmod(F.xxhash64("source", F.lit(2)), F.col("cells")).cast("int")
    known = groups.join(facts, "lang").join(totals, ["lang", "source"], "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("cell", cell)
    zero = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("own"), F.greatest("kept", F.lit(1)))).otherwise(0).cast("int")
    known = materialise(known.select("lang", "source", "own", "kept", "shards", "cells", "cell", zero.alias("absent")))
    vector = held.join(known.select("lang", "source", "own", "kept"), ["lang", "source"]).select("lang", "source", "shard", "at", share(F.col("n"), F.col("own"), F.col("kept")).cast("int").alias("p"))
    vector = vector.groupBy("lang", "source", "shard").agg(F.collect_list("at").alias("at"), F.collect_list("p").alias("p"))
    segments = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(vector, ["lang", "source", "shard"], "left")
    segments = materialise(_pack(segments.select("lang", "shard", "cell", "cells", "source", "absent", "at", "p")))
    language = numbered.groupBy("lang", "shard").agg(F.collect_list("at").alias("at"), F.collect_list("q").alias("p"))
    language = _pack(language.select("lang", "shard", "at", "p"))

    # The schedule: where and when each cell's vectors are read.
    turning = F.col("cells") - 1 + F.col("cells") % 2
    away = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("peer")
    low, high = F.least("cell", "peer"), F.greatest("cell", "peer")
    when = F.when(high == turning, 2 * low % turning).otherwise((low + high) % F.greatest(turning, F.lit(1)))
    host = F.when((low + high) % 2 == 1, low).otherwise(high)
    columns = ["lang", "shard", "cell", "round", "source", "absent", "vector"]
    home = segments.withColumn("round", F.lit(OWN)).select(columns)
    guests = segments.select("*", away).filter((F.col("peer") != F.col("cell")) & (host == F.col("peer"))).withColumn("round", when.cast("int")).withColumn("cell", F.col("peer")).select(columns)
    cells = segments.select("lang", "shard", "cell").distinct()
    guide = cells.join(language, ["lang", "shard"]).select("lang", "shard", "cell", F.lit(LANGUAGE).alias("round"), F.lit("").alias("source"), F.lit(0).alias("absent"), "vector")
    all_rows = home.unionByName(guests).unionByName(guide).join(sizes, ["lang", "shard"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    columns = ["lang", "shard", "cell", "round", "source", "size", "absent", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)

        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64())
        names = ["part", "lang", "shard", "source", "item", "at", "value"]
        out: list[tuple] = []
        for row in meet(rows(), top):
            out.append(row)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        release()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = materialise(all_rows.select(columns).repartition(parts, "lang", "shard", "cell").sortWithinPartitions("lang", "shard", "cell", "round", "source").mapInArrow(run, MET))
    pairs = met.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by))
    ranked = met.filter("part = 'term'").join(numbered.select("lang", "shard", "at", F.col("term").alias("word")), ["lang", "shard", "at"]).select("lang", "source", "part", F.col("word").alias("item"), "value")
    ranked = ranked.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return pairs.unionByName(ranked).select("lang", "source", "part", "item", "value", "rank")
