"""ZIP archives as a Spark data source.

Planning reads the archive's directory, which stands at its end, by seeking; each run of entries of about ``partitionBytes``
compressed bytes is a partition, whose task seeks to its entries and reads nothing else. So an
archive may be larger than a task's memory, one entry may not.

    spark.dataSource.register(ZipArchive)
    spark.read.format("zip_archive").option("partitionBytes", 16 << 20).load(path)
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, ordinal long, entry string, key string, size long, latest boolean, content binary, error string"
PARTITION_BYTES = 16 << 20
MAX_BYTES = 2 << 30
_LOCAL = struct.Struct("<4sHHHHHIIIHH")  # the header in front of an entry's bytes


def opened(path: str):
    """A seekable file of any store that Arrow knows; a plain path is a local file."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return store.open_input_file(inner)


@dataclass
class Entry:
    ordinal: int
    name: str
    size: int
    packed: int
    method: int
    flags: int
    crc: int
    at: int
    latest: bool


@dataclass
class Run(InputPartition):
    path: str
    entries: list[Entry]

    def __post_init__(self):
        super().__init__(self.entries[0].ordinal)


def key_of(name: str) -> str:
    return name.rsplit("/", 1)[-1].lower()


def directory(path: str, max_bytes: int) -> list[Entry]:
    """The files of an archive in the order of its directory; of several with one lower-cased base name the last is the latest.

    An archive without files, or whose files declare more than ``max_bytes`` in all, is refused.
    """
    with opened(path) as raw, zipfile.ZipFile(raw) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
    if not infos:
        raise ValueError(f"no files in {path}")
    if sum(i.file_size for i in infos) > max_bytes:
        raise ValueError(f"{path} declares over {max_bytes} bytes")
    last = {key_of(i.filename): k for k, i in enumerate(infos)}
    return [Entry(k, i.filename, i.file_size, i.compress_size, i.compress_type, i.flag_bits, i.CRC, i.header_offset, last[key_of(i.filename)] == k) for k, i in enumerate(infos)]


def content_of(raw, e: Entry) -> tuple[bytes | None, str | None]:
    """An entry's bytes, or why they can't be had."""
    if e.flags & 1:
        return None, "encrypted"
    if e.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None, f"compression method {e.method}"
    raw.seek(e.at)
    head = raw.read(_LOCAL.size)
    if len(head) < _LOCAL.size or head[:4] != b"PK\x03\x04":
        return None, "no entry where the directory says"
    *_, name, extra = _LOCAL.unpack(head)
    raw.seek(e.at + _LOCAL.size + name + extra)
    data = raw.read(e.packed)
    try:
        if e.method == zipfile.ZIP_DEFLATED:
            unpack = zlib.decompressobj(-15)
            data = unpack.decompress(data, e.size + 1)  # no more than it declares
    except zlib.error:
        return None, "damaged"
    return (data, None) if len(data) == e.size and zlib.crc32(data) == e.crc else (None, "damaged")


class ZipReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.max_bytes = int(options.get("maxBytes", MAX_BYTES))
        self.with_content = options.get("content", "true").lower() != "false"

    def partitions(self) -> list[Run]:
        runs: list[Run] = []
        held, size = [], 0
        for e in sorted(directory(self.path, self.max_bytes), key=lambda e: e.at):
            if held and size + e.packed > self.partition_bytes:
                runs.append(Run(self.path, held))
                held, size = [], 0
            held.append(e)
            size += e.packed
        return [*runs, Run(self.path, held)]

    def read(self, partition: Run) -> Iterator[tuple]:
        if not self.with_content:
            yield from ((partition.path, e.ordinal, e.name, key_of(e.name), e.size, e.latest, None, None) for e in partition.entries)
            return
        with opened(partition.path) as raw:
            for e in partition.entries:
                yield (partition.path, e.ordinal, e.name, key_of(e.name), e.size, e.latest, *content_of(raw, e))


class ZipArchive(DataSource):
    """Columns: archive, ordinal (in the directory), entry, key (lower-cased base name), size, latest, content and error (instead of content).

    Options: ``partitionBytes``, ``maxBytes`` that the entries may declare in all, and ``content`` (``false`` for the directory alone).
    """

    @classmethod
    def name(cls) -> str:
        return "zip_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def zip_archive(spark: SparkSession, path: str, content: bool = True, max_bytes: int = MAX_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """All files of an archive."""
    spark.dataSource.register(ZipArchive)
    return spark.read.format("zip_archive").option("content", str(content).lower()).option("maxBytes", max_bytes).option("partitionBytes", partition_bytes).load(path)


HEAD = 1 << 20  # bytes of an image within which its header has to stand
# Markers of a JPEG file's frame headers.
_FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


def header_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the beginning of a PNG or JPEG file."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(head):
        if head[at] != 0xFF:
            return None
        marker = head[at + 1]
        if marker == 0xFF:  # fill
            at += 1
        elif marker in _FRAMES:
            height, width = struct.unpack(">HH", head[at + 5 : at + 9])
            return (width, height) if width and height else None
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif marker in (0xD9, 0xDA):
            return None
        else:
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return None


def image_sizes(images: DataFrame, content: str = "content", max_pixels: int = 50_000_000) -> DataFrame:
    """``images`` with width, height and error, from the first ``HEAD`` bytes of each, before anything is decoded.

    An image of more than ``max_pixels`` is refused by its header. Other columns go on as they are; ``content`` stays.
    """

    @F.pandas_udf("struct<width:long,height:long>")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for heads in batches:
            found = [header_size(h) if h is not None else None for h in heads]
            yield pd.DataFrame({k: pd.array([None if f is None else f[i] for f in found], "Int64") for i, k in enumerate(("width", "height"))})

    out = images.withColumn("_s", sizes(F.substring(content, 1, HEAD)))
    out = out.withColumn("width", F.col("_s.width")).withColumn("height", F.col("_s.height")).drop("_s")
    error: Column = F.when(F.col("width").isNull(), "not an image").when(F.col("width") * F.col("height") > max_pixels, "too many pixels")
    return out.withColumn("error", F.coalesce(F.col("error"), error) if "error" in images.columns else error)

