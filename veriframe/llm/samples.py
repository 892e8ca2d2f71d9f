"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, train: Column, label_col: str, sample: int, longest: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[int, bytes]], dict[int, int]]:
    """About ``sample`` (label, text) rows of each label 0 and 1, drawn by a hash of the id, and the labels' counts.

    The drawn ids are at most ``4 * sample``, the first by the hash, and are broadcast; documents
    longer than ``longest`` characters and null texts are left out of the sample. Ids labelled
    twice alike count once, those labelled both 0 and 1 teach nothing; equal rows count once.
    """
    known = labels.filter(train).select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y in (0, 1) and _id is not null")
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_y = _z").select("_id", "_y")
    counts = {0: 0, 1: 0} | {r[0]: r[1] for r in known.groupBy("_y").agg(F.count("*")).collect()}
    share = F.when(F.col("_y") == 1, F.lit(min(1.0, sample / max(1, counts[1])))).otherwise(F.lit(min(1.0, sample / max(1, counts[0]))))
    chance = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30))
    drawn = known.filter(chance < share * (1 << 30)).orderBy(chance, "_id").limit(4 * sample)
    texts = docs.select(F.col(id_col).alias("_d"), F.col(text_col).cast("string").alias("_t")).filter(F.col("_t").isNotNull() & (F.length("_t") <= longest))
    found = texts.join(F.broadcast(drawn), F.col("_d") == F.col("_id")).select("_d", "_y", "_t").dropDuplicates()
    rows = found.orderBy(F.xxhash64("_d", "_t"), "_d", "_t").limit(8 * sample).collect()
    return [(r[1], r[2].encode()) for r in sorted(rows)], counts
