"""The engine over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veriframe import sinks
from veriframe.config import DEFAULT, Options
from veriframe.operators import claims as C
from veriframe.operators import decide, guards
from veriframe.operators.claims import why_not_verifiable
from veriframe.staging import staged

ADMITTED = "key string, request long, admitted boolean"
BUCKET = "tokens double, seen double"
IDLE_MS = 600_000
DAY_MS = 86_400_000
LATE = timedelta(hours=1)


def throttle(log: DataFrame, rate: float, burst: float) -> DataFrame:
    """A token bucket for each key of a stream (key string, ts timestamp, request long); a bucket idle for ten minutes is dropped, being full again."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, seen = state.get if state.exists else (float(burst), None)
        rows = pd.concat(list(batches)).sort_values(["ts", "request"], kind="stable")
        out = []
        for ts, request in zip(rows.ts, rows.request, strict=True):
            now = ts.timestamp()
            tokens = min(float(burst), tokens + (now - (now if seen is None else seen)) * rate)
            seen = now
            ok = rate <= 0 or tokens >= 1
            tokens -= ok and rate > 0
            out.append((key[0], request, bool(ok)))
        state.update((tokens, seen))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame(out, columns=["key", "request", "admitted"])

    return log.groupBy("key").applyInPandasWithState(step, ADMITTED, BUCKET, "append", GroupStateTimeout.ProcessingTimeTimeout)


class DayBudget(StatefulProcessor):
    """What a day has spent, in nanoseconds, as a state that goes with the day.

    A day's timer stands at its end plus ``late``; a request of a day whose timer has fired is late and refused.
    """

    def __init__(self, limit: float, late: timedelta):
        self.most, self.late_ms = round(limit * guards.NANOS), int(late.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "nanos long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (day,) = key
        end = int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000) + DAY_MS + self.late_ms
        over = timerValues.getCurrentWatermarkInMs() >= end
        spent = self.spent.get()[0] if self.spent.exists() else 0
        if not over and not self.spent.exists():
            self.handle.registerTimer(end)
        got = pd.concat(list(rows)).sort_values(["ts", "request"], kind="stable")
        admitted = []
        for cost in got["nanos"].tolist():
            ok = not over and spent < self.most
            spent += cost * ok
            admitted.append(ok)
        if not over:
            self.spent.update((spent,))
        yield pd.DataFrame({"key": [day] * len(got), "request": got["request"], "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.spent.clear()
        return iter(())

    def close(self) -> None:
        pass


def daily_budget(log: DataFrame, limit: float, late: timedelta = LATE) -> DataFrame:
    """(key = UTC day, request, admitted) of a stream (ts timestamp, request long, cost double): ``guards.daily_budget`` as requests arrive.

    The state is one number for each day and is dropped, by a timer of event time, once the watermark is ``late`` beyond
    the day. Replayed in order of time, a stream gives what the batch form gives. Needs a state store with timers, such as RocksDB.
    """
    rows = log.select("ts", "request", guards.cost_nanos(F.col("cost")).alias("nanos")).withWatermark("ts", f"{int(late.total_seconds())} seconds").withColumn("key", F.to_date("ts"))
    return rows.filter("ts is not null").groupBy("key").transformWithStateInPandas(DayBudget(limit, late), outputStructType="key date, request long, admitted boolean", outputMode="Append", timeMode="EventTime")


def judged_rows(rows: DataFrame, images: DataFrame) -> DataFrame:
    """``rows`` (row, image, an application's columns) with label (the image's base name) and error, null for a row that can be verified.

    ``images`` (key, error) are those that arrived, by lower-cased base name. A row is refused, and the others go on, if
    its image is missing or can't be read or if its application can't be verified.
    """
    known = images.select(F.col("key").alias("label"), F.lit(True).alias("there"), F.col("error").alias("image_error"))
    filed = F.greatest(*[F.coalesce(F.col(c), F.lit("")) != "" for c in ("brand", "class", "origin")], F.coalesce(F.size("producer"), F.lit(0)) > 0, *[F.coalesce(F.col(c), F.lit(0.0)) > 0 for c in ("abv", "net_ml")])
    missing = F.concat(F.lit("There is no file called "), "image", F.lit("."))
    unread = F.concat("image", F.lit(": "), "image_error")
    error = F.when(F.coalesce("image", F.lit("")) == "", "no image").when(F.col("there").isNull(), missing).when(F.col("image_error").isNotNull(), unread).otherwise(why_not_verifiable(F.col("beverage"), filed))
    joined = rows.withColumn("label", F.lower(F.element_at(F.split(F.coalesce("image", F.lit("")), "/"), -1))).join(known.dropDuplicates(["label"]), "label", "left")
    return joined.withColumn("error", error).drop("there", "image_error")


def verify_rows(rows: DataFrame, images: DataFrame, detections: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """(row, image, error, value): a JSON line for each row, with its verdicts or with its error.

    Each row is verified as a label of its own, so rows may share an image. ``detections`` are of labels by lower-cased base name.
    """
    judged = staged(judged_rows(rows, images))
    good = judged.filter("error is null").withColumn("image_key", F.col("label")).withColumn("label", F.col("row").cast("string"))
    det = detections.withColumnRenamed("label", "image_key").join(good.select("image_key", F.col("label")), "image_key").drop("image_key")
    filed = C.claims(good.select("label", "beverage", "brand", "class", "producer", "origin", "abv", "net_ml", "aliases"))
    done = sinks.results(decide.verify(det, filed, C.candidates(filed), options)).withColumn("claims", F.get_json_object("result", "$.claims"))
    out = judged.join(done.select(F.col("label").cast("long").alias("row"), "claims"), "row", "left")
    head = F.to_json(F.struct("image", "row"))
    body = F.when(F.col("error").isNotNull(), F.to_json(F.struct("image", "row", "error"))).otherwise(F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"claims":'), F.coalesce("claims", F.lit("[]")), F.lit("}")))
    return out.select("row", "image", "error", body.alias("value"))


def stream_rows(rows: DataFrame, images: DataFrame, detections: DataFrame, path: str, checkpoint: str, options: Options = DEFAULT):
    """Starts the query over a stream of claim rows: a line a row, results and errors side by side.

    A batch writes to a folder of its own number, so one that runs again after a failure replaces its lines.
    """

    def run(batch: DataFrame, number: int) -> None:
        verify_rows(staged(batch), images, detections, options).select("value").write.mode("overwrite").text(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verify_batches(claims: DataFrame, candidates: DataFrame, path: str, options: Options = DEFAULT) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that verifies the labels of each batch of detections and appends a line for each.

    A batch writes to a folder of its own number, so a batch that runs again replaces its lines.
    """

    def run(batch: DataFrame, number: int) -> None:
        labels = batch.select("label").distinct()
        own = claims.join(labels, "label", "left_semi")
        cands = candidates.join(labels, "label", "left_semi")
        sinks.write_ndjson(decide.verify(batch, own, cands, options), f"{path}/batch={number}")

    return run


def verify_stream(detections: DataFrame, claims: DataFrame, candidates: DataFrame, path: str, checkpoint: str, options: Options = DEFAULT):
    """Starts the query over a stream of detections in which a label's detections arrive together; ends when the source is read."""
    return detections.writeStream.foreachBatch(verify_batches(claims, candidates, path, options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
