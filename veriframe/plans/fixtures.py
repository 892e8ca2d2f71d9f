"""The driver's tables in the roles of the engine's inputs; ``sql.py`` has the same rules for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections from documents: one line, one box."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("label"), F.posexplode(F.split("text", "\n")).alias("det_idx", "text"))
    conf = ((F.col("label") * 7 + F.col("det_idx") * 13) % 10).cast("double") / 10.0
    top = 13 * F.col("det_idx")
    return t.select("label", "det_idx", F.lit(10).alias("x0"), top.alias("y0"), (10 + 8 * F.length("text")).alias("x1"), (top + 12).alias("y1"), "text", conf.alias("confidence"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections from benchmark items: one word, one box, 8 to a character."""
    ls = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("label"), F.posexplode(F.split("text", "\n")).alias("l", "t"))
    ws = ls.select("label", "l", F.posexplode(F.split("t", " ")).alias("k", "text"))
    s = F.sum(F.length("text") + 1).over(Window.partitionBy("label", "l").orderBy("k"))
    ws = ws.withColumn("s", s).filter("text <> ''")
    idx = (F.row_number().over(Window.partitionBy("label").orderBy("l", "k")) - 1).cast("int")
    x1 = (8 * (F.col("s") - 1)).cast("int")
    top = (13 * F.col("l")).cast("int")
    return ws.select("label", idx.alias("det_idx"), (8 * (F.col("s") - F.length("text") - 1)).cast("int").alias("x0"), top.alias("y0"), x1.alias("x1"), (top + 12).alias("y1"), "text", F.lit(0.9).alias("confidence"))


def uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words, each a little lower or higher than its neighbours, some taller, so that lines run into each other."""
    down, taller = F.col("det_idx") * 5 % 9, F.col("det_idx") % 4 * 3
    return words(spark, sf_dir).withColumns({"y0": (F.col("y0") + down).cast("int"), "y1": (F.col("y1") + down + taller).cast("int")})


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and what is read of them."""
    n, k = F.col("p_name"), F.col("p_partkey") % 6
    reading = (
        F.when(k == 0, n).when(k == 1, F.translate(F.upper(n), "OISB", "0158")).when(k == 2, F.concat(F.substring(n, 1, 2), F.substring(n, F.lit(4), F.length(n))))
        .when(k == 3, F.concat(F.lit("THE "), n)).when(k == 4, F.concat(n, F.lit(", "), F.col("p_brand"))).otherwise(F.col("p_type"))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), n.alias("name"), reading.alias("reading"))


def one_box(df: DataFrame, text: str) -> DataFrame:
    """A detection for each label."""
    return df.select("label", F.lit(0).alias("det_idx"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), (8 * F.length(text)).alias("x1"), F.lit(12).alias("y1"), F.col(text).alias("text"), F.lit(0.9).alias("confidence"))
