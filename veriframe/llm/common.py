"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1_000_000
BATCH_BYTES = 2 << 20


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id has fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(parts), F.lit(0))


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the bytes of an Arrow batch, which both the JVM and the Python worker hold as a whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = "".join(filter(str.isdigit, spark.conf.get(key)))
    if not now or int(now) > most:
        spark.conf.set(key, str(most))


class Recent(dict):
    """A table of at most about twice ``most`` entries: the entries of the generation before stay until the next one is full, and those in use move on."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors share, in ``spark.checkpoint.dir``. Where that is unset: in the warehouse if all
    runs in one process, else an error, since no folder is known that executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/veriframe-{uuid.uuid4().hex}"


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    for made in _made[-1:]:
        made.append(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that are written within, in order."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def release() -> None:
    """Gives freed memory back at the end of a task: the worker waits for the next one, beside a JVM that needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``column``; a single longer text is its own slice."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.array([0 if x is None else x for x in pc.binary_length(col).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < n:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def joined(texts: list[bytes], pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, each followed by ``pad`` zero bytes, and the n+1 offsets of their starts."""
    gap = b"\0" * pad
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + pad for t in texts], out=off[1:])
    return np.frombuffer(gap.join(texts) + gap, np.uint8), off


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


_LONGEST = 1 << 24
_R = 0x9E3779B97F4A7C15
_POW: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, at least n of each."""
    have = _POW.get(0)
    if have is None or len(have) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        inv = pow(_R, -1, 1 << 64)
        for key, r in ((0, _R), (1, inv)):
            p = np.full(m, r, np.uint64)
            p[0] = 1
            _POW[key] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a lower-cased byte array.

    Polynomial hashes of random byte values come from one prefix sum, so the work is a few
    passes over the bytes and independent of the number of words.
    """
    space = SPACE[buf]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix64(h ^ (ends - starts).astype(np.uint64)), starts, ends
