"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has ``CELLS`` equal cells. Each shard owns ``virtual_nodes`` of them; a key starts at the
first owned cell at or clockwise of its own. Only the number of keys of each cell reaches the
driver (a fixed number of rows at any input size). The driver walks the cells once and hands out
the places: a cell's keys go to the first shard clockwise that has room, and what overflows goes
on clockwise. The outcome is a small table of ranges (cell, ranks, shard, first slot), so a key
needs only its rank within its cell, found by a window over a thousandth of the rows or less.
Cells that hold far more rows than others (one key repeated) are split by a hash of the whole row,
and rows that are repeated whole by a stored number; those are alike, so the outcome is the same
however the table is split.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriframe.llm.common import materialise

CELLS = 8192
ROW = ["doc_id", "size", "text_crc32"]


def ring(shards: int, virtual_nodes: int) -> tuple[list[int], list[int]]:
    """Sorted cells of all virtual nodes and their owners; adding a shard only adds cells."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            cell = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:4], "big") % CELLS
            at.setdefault(cell, s)  # an earlier shard keeps its cell
    cells = sorted(at)
    return cells, [at[c] for c in cells]


def places(counts: dict[tuple[int, int], int], shards: int, virtual_nodes: int, bounded: bool) -> list[dict]:
    """Ranges of ranks of each (cell, salt) with their shard and first slot."""
    cells, owners = ring(shards, virtual_nodes)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) if bounded else total for s in range(shards)]
    used, out = [0] * shards, []
    for (cell, salt), n in sorted(counts.items()):
        j, lo = bisect.bisect_left(cells, cell), 0
        while lo < n:
            s = owners[j % len(owners)]
            if take := min(n - lo, room[s] - used[s]):
                out.append({"cell": cell, "salt": salt, "lo": lo, "hi": lo + take, "shard": s, "base": used[s]})
                used[s] += take
                lo += take
            j += 1
    return out


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard(docs: DataFrame, shards: int = 8, virtual_nodes: int = 64, law: str = "rows", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: bounded loads, counts at most one apart. Law ``key``: id and number of shards
    decide alone; ``grown_shard`` is the shard on a ring with one more. A null text has size 1 and
    the crc of no bytes; a null id is a key of its own; equal rows get slots of their own; an empty
    table gives no rows. Texts never leave the scan's task, whatever their length.
    """
    if law not in ("rows", "key"):
        raise ValueError(f"unknown law {law!r}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    cell: Column = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(CELLS)).cast("int")
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), cell.alias("cell"))
    keys = materialise(keys.withColumn("part", F.monotonically_increasing_id()))
    found = {r["cell"]: r["n"] for r in keys.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    limit = 1000 + 8 * sum(found.values()) // CELLS
    # There are at most total / limit hot cells and hot rows, fewer than CELLS / 8.
    hot = [{"cell": c, "pieces": -(-n // limit)} for c, n in sorted(found.items()) if n > limit]
    counts = {(c, 0): n for c, n in found.items() if n <= limit}
    if hot:
        cells = F.broadcast(_table(spark, hot, "cell:int,pieces:int"))
        alike = keys.join(cells, "cell").groupBy("cell", *ROW).agg(F.count("*").alias("n")).filter(F.col("n") > limit).orderBy("cell", *ROW).collect()
        first, same = 1 << 20, []
        for r in alike:
            same.append(r.asDict() | {"first": first, "parts": -(-r["n"] // limit)})
            first += same[-1]["parts"]
        rows = F.broadcast(_table(spark, same, "cell:int,doc_id:long,size:long,text_crc32:long,n:long,first:int,parts:int")).alias("r")
        k = keys.join(cells, "cell", "left").alias("k")
        on = F.col("k.cell") == F.col("r.cell")
        for c in ROW:
            on &= F.col(f"k.{c}").eqNullSafe(F.col(f"r.{c}"))
        salt = F.when(F.col("parts").isNotNull(), F.col("first") + F.pmod("part", "parts")).when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64(*(F.col(f"k.{c}") for c in ROW)), F.col("pieces")) + 1).otherwise(0)
        keys = k.join(rows, on, "left").select("k.cell", *(f"k.{c}" for c in ROW), salt.cast("int").alias("salt"))
        counts |= {(r["cell"], r["salt"]): r["n"] for r in keys.filter("salt > 0").groupBy("cell", "salt").agg(F.count("*").alias("n")).collect()}
    else:
        keys = keys.withColumn("salt", F.lit(0))
    plan = _table(spark, places(counts, shards, virtual_nodes, law == "rows"), "cell:int,salt:int,lo:long,hi:long,shard:int,base:long")
    rank = F.row_number().over(Window.partitionBy("cell", "salt").orderBy(*ROW)).cast("long") - 1
    ranked = keys.withColumn("rank", rank).alias("k")
    p = F.broadcast(plan).alias("p")
    on = (F.col("k.cell") == F.col("p.cell")) & (F.col("k.salt") == F.col("p.salt")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    out = ranked.join(p, on)
    grown: Column = F.lit(None).cast("int")
    if law == "key":
        cells, owners = ring(shards + 1, virtual_nodes)
        owner = [owners[bisect.bisect_left(cells, c) % len(owners)] for c in range(CELLS)]
        grown = F.element_at(F.from_json(F.lit(json.dumps(owner)), "array<int>"), F.col("k.cell") + 1)
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), grown.alias("grown_shard"))
