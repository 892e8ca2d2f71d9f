"""Guards over a request log: a token bucket for each caller and a daily budget.

A token bucket depends on what it admitted before, so a caller's requests are scanned in order of time, with two
numbers of state, however many they are. A day's budget is a prefix sum, taken in levels of ever
shorter stretches of time, of which only the one that crosses the limit is looked into.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriframe.staging import staged

NANOS = 1_000_000_000
DAY = 86_400_000_000  # microseconds
STRETCHES = (60_000_000, 10_000)  # a minute, ten milliseconds


def token_bucket(log: DataFrame, rate: float, burst: float) -> DataFrame:
    """(key, request, admitted) for ``log`` (key, ts timestamp, request long, ...).

    A bucket starts full, refills by ``rate`` a second up to ``burst`` and gives one token to a
    request if it has one; requests of one time go by their number. A rate of 0 or less admits all. Requests without a
    time or a key are admitted by no bucket: they are refused.
    """
    if rate <= 0:
        return log.select("key", "request", F.lit(True).alias("admitted"))
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = log.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "request")
    known = F.col("key").isNotNull() & F.col("t").isNotNull()
    schema = rows.select("key", "request").schema.fields
    ordered = rows.filter(known).repartition(parts, "key").sortWithinPartitions("key", "t", "request")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, seen = None, 0.0, 0
        for b in batches:
            admitted = []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != now:
                    now, tokens, seen = key, float(burst), t
                tokens = min(float(burst), tokens + (t / 1e6 - seen / 1e6) * rate)
                seen = t
                ok = tokens >= 1
                tokens -= ok
                admitted.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(admitted, pa.bool_())], names=["key", "request", "admitted"])

    out = ordered.mapInArrow(run, f"key {schema[0].dataType.simpleString()}, request {schema[1].dataType.simpleString()}, admitted boolean")
    return out.unionByName(rows.filter(~known).select("key", "request", F.lit(False).alias("admitted")))


def cost_nanos(cost: Column) -> Column:
    """A cost in whole nanoseconds, so that sums don't depend on their order; what is null or below 0 costs nothing."""
    return F.greatest(F.coalesce(F.round(cost * NANOS).cast("long"), F.lit(0)), F.lit(0))


def daily_budget(log: DataFrame, limit: float, stretches: tuple[int, ...] = STRETCHES) -> DataFrame:
    """(key = UTC day, request, admitted): a request is admitted while the day's admitted costs (seconds) are below the limit.

    No cost is below 0, so what a day admits is the beginning of it: a request is admitted if all requests before it
    (by time, then by number) cost less than the limit. Costs are added up by minute, then, within the one minute of a day that crosses the
    limit, by ten milliseconds; only the requests of the stretch that crosses it are put in order. So no group holds a day,
    and all sums are of whole nanoseconds. A limit of 0 or less admits all. Requests without a time are refused.
    """
    day = F.to_date("ts")
    if limit <= 0:
        return log.select(day.alias("key"), "request", F.lit(True).alias("admitted"))
    most = round(limit * NANOS)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = log.select(day.alias("key"), at.alias("t"), "request", cost_nanos(F.col("cost")).alias("cost"), F.lit(0).cast("long").alias("base"))
    out = [rows.filter("t is null").select("key", "request", F.lit(False).alias("admitted"))]
    rows = rows.filter("t is not null")
    for size in stretches:
        rows = rows.withColumn("stretch", F.floor(F.col("t") / size))
        sums = rows.groupBy("key", "base", "stretch").agg(F.sum("cost").alias("own"))
        before = F.coalesce(F.sum("own").over(Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("base")
        sums = staged(sums.withColumn("before", before).select("key", "stretch", "own", "before"))
        crosses = (F.col("before") < most) & (F.col("before") + F.col("own") >= most)
        judged = rows.join(sums, ["key", "stretch"])
        out.append(judged.filter(~crosses).select("key", "request", (F.col("before") < most).alias("admitted")))
        rows = judged.filter(crosses).select("key", "t", "request", "cost", F.col("before").alias("base"))
    earlier = F.sum("cost").over(Window.partitionBy("key").orderBy("t", "request").rowsBetween(Window.unboundedPreceding, -1))
    out.append(rows.select("key", "request", (F.coalesce(earlier, F.lit(0)) + F.col("base") < most).alias("admitted")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found
