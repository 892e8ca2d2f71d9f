"""Intermediate tables that several parts of a plan read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, in ``spark.checkpoint.dir``; where that is unset, in the warehouse if all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/veriframe-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that both sides deal by the key, however small it looks: a table that grows with the input may be
    a few megabytes as a file of like rows and hundreds of them as a hash table in the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by the keys over as many tasks as shuffles have: a small file may hold rows of which much is made, and would be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so it is computed once, however often the plan reads it, and survives a lost executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Bounds the bytes of an Arrow batch: rows with images are few to a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = "".join(filter(str.isdigit, spark.conf.get(key)))
    if not now or int(now) > most:
        spark.conf.set(key, str(most))
