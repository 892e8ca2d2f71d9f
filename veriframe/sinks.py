"""Writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wire_evidence(e: Column) -> Column:
    """Evidence as it is sent: distance, radius and confidence always; competitor fields, parts and region only where there is one."""
    region = e["region"]
    some = (region["x1"] > region["x0"]) & (region["y1"] > region["y0"])
    rival = e["competitor"].isNotNull() & (e["competitor"] != "")
    return F.when(
        e.isNotNull(),
        F.struct(
            F.when(some, region).alias("region"), e["read"].alias("read"), e["matched"].alias("matched"), F.coalesce(e["distance"], F.lit(0.0)).alias("distance"), F.coalesce(e["radius"], F.lit(0.0)).alias("radius"),
            F.coalesce(e["confidence"], F.lit(0.0)).alias("confidence"), F.when(rival, e["competitor"]).alias("competitor"), F.when(rival, e["competitor_distance"]).alias("competitor_distance"),
            F.when(e["reading"] != "", e["reading"]).alias("reading"), F.when(e["parts"] > 0, e["parts"]).alias("parts"),
        ),
    )


def results(verdicts: DataFrame) -> DataFrame:
    """(label, result): one JSON object a label, its claims in order of their names; absent fields are left out."""
    row = F.struct("claim", "status", F.when(F.col("reason") != "", F.col("reason")).alias("reason"), "expected", F.when(F.col("observed") != "", F.col("observed")).alias("observed"), wire_evidence(F.col("evidence")).alias("evidence"))
    each = verdicts.select("label", row.alias("v"), F.col("claim").alias("k"))
    listed = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.to_json("v").alias("v")))), lambda x: x["v"]).alias("c"))
    return listed.select("label", F.concat(F.lit('{"label":'), F.to_json(F.struct("label")).substr(F.lit(10), F.length(F.to_json(F.struct("label"))) - 10), F.lit(',"claims":['), F.array_join("c", ","), F.lit("]}")).alias("result"))


def write_ndjson(verdicts: DataFrame, path: str) -> None:
    """One line a label."""
    results(verdicts).select(F.col("result").alias("value")).write.mode("overwrite").text(path)


def batch_items(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(image, row, error, value): a line for each batch row; a row with an error has it in place of claims."""
    done = results(verdicts)
    joined = rows.join(done, rows["image"] == done["label"], "left")
    value = F.when(F.col("error").isNotNull(), F.to_json(F.struct("image", "row", "error"))).otherwise(F.to_json(F.struct("image", "row", F.col("result").alias("result"))))
    return joined.select("image", "row", "error", value.alias("value"))


def crop_box(region: Column, width: Column, height: Column) -> Column:
    """The region with a third of its height on every side, clipped to the image; null where nothing is left."""
    pad = F.floor((region["y1"] - region["y0"]) / 3)
    box = F.struct(F.greatest(region["x0"] - pad, F.lit(0)).cast("int").alias("x0"), F.greatest(region["y0"] - pad, F.lit(0)).cast("int").alias("y0"), F.least(region["x1"] + pad, width).cast("int").alias("x1"), F.least(region["y1"] + pad, height).cast("int").alias("y1"))
    return F.when((box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)


def has_crop(region: Column) -> Column:
    return F.coalesce((region["x1"] > region["x0"]) & (region["y1"] > region["y0"]), F.lit(False))


def write_records(verdicts: DataFrame, path: str) -> None:
    """All verdicts as JSON records."""
    verdicts.withColumn("evidence", wire_evidence(F.col("evidence"))).write.mode("overwrite").json(path)


def markdown(tallied: DataFrame) -> str:
    """A table of a tally with rates; a tally has one row for each claim name, which are few."""
    rows = tallied.orderBy(*[c for c in tallied.columns[:1]]).limit(10_000).collect()
    lines = ["| " + " | ".join(tallied.columns) + " |", "|" + "---|" * len(tallied.columns)]
    lines += ["| " + " | ".join(f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines)


def write_diagnostic(records: DataFrame, path: str, header: dict[str, str | float]) -> None:
    """A header line, then a line for each record."""
    spark = records.sparkSession
    head = spark.range(1).select(F.lit(0).alias("k"), F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in header.items()])).alias("value"))
    body = records.select(F.lit(1).alias("k"), F.to_json(F.struct(*records.columns)).alias("value"))
    head.unionByName(body).repartitionByRange(1, "k").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
