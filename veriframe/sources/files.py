"""Readers of the engine's inputs. Paths go to Spark's own readers, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.operators.claims import APPLICATION
from veriframe.operators.evaluate import half
from veriframe.sources.archives import image_sizes, zip_archive

# The wire form of an application: what a file holds, without its label.
FILED = "beverage string, brand string, class string, producer array<string>, origin string, abv double, net_ml double, aliases map<string,array<string>>"
PRINTED = (
    "family string, brand string, class string, producer array<string>, origin string, abv double, abv_text string, net_ml double, net_text string, error string, wording string, body_face string, heavy_face string, "
    "brand_face string, carried map<string,string>, split map<string,boolean>, claim_faces map<string,string>, warning_caps boolean, inverted boolean, vertical_warning boolean, crowded boolean"
)
TRUTH = f"printed struct<{', '.join(f.replace(' ', ':', 1) for f in PRINTED.split(', '))}>, aug string, note string"
COLUMNS = ("image", "beverage", "brand", "class", "producer", "address", "origin", "abv", "net_ml")


class TooManyRows(ValueError):
    pass


def _label(suffix: str) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), suffix, "")


def applications(spark: SparkSession, path: str) -> DataFrame:
    """Application files ``NNNN.json``; the label is the file's stem."""
    read = spark.read.schema(FILED).json(path, multiLine=True, pathGlobFilter="[!.]*[0-9].json")
    return read.select(_label(r"\.json$").alias("label"), *read.columns)


def truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth files ``NNNN.truth.json``."""
    read = spark.read.schema(TRUTH).json(path, multiLine=True, pathGlobFilter="*.truth.json")
    return read.select(_label(r"\.truth\.json$").alias("label"), *read.columns)


def sliced(labels: DataFrame, which: str | None = None, limit: int = 0) -> DataFrame:
    """Half A or B by the label's number, then the first ``limit`` labels."""
    out = labels.filter(half(F.col("label").cast("long"), which)) if which else labels
    return out.orderBy("label").limit(limit) if limit else out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(family) of a set's manifest; a missing file is an error of the reader."""
    return spark.read.schema("families array<string>").json(path, multiLine=True).select(F.explode("families").alias("family"))


def charset(spark: SparkSession, path: str) -> list[str]:
    """The recogniser's characters: the blank, the file's lines, a space. A dictionary is a few thousand lines; more than a million are refused."""
    text = spark.read.text(path, wholetext=True).first()
    lines = (text[0] if text else "").removesuffix("\n").split("\n")
    if len(lines) > 1_000_000:
        raise TooManyRows("a dictionary of over a million lines")
    return ["", *lines, " "]


def claims_csv(spark: SparkSession, path: str, max_rows: int = 450) -> DataFrame:
    """Rows of a claims file: ``row`` (from 1, blank images counted), image and the application's columns.

    Headers are trimmed and lower-cased, in any order, and ``image`` must be there. Ragged rows
    are read as far as they go; numbers that are none are 0; an address counts only beside a
    producer. A file of more than ``max_rows`` records is refused before anything is read on.
    """
    lines = spark.read.option("header", False).csv(path, inferSchema=False, multiLine=True, mode="PERMISSIVE")
    head = lines.first()
    if head is None:
        raise ValueError("no header row")
    names = [(v or "").strip().lower() for v in head]
    if "image" not in names:
        raise ValueError("no image column")
    # A claims file is bounded by max_rows, so numbering its rows takes one small task.
    numbered = lines.limit(max_rows + 2).coalesce(1).withColumn("row", F.monotonically_increasing_id()).filter("row > 0")
    n = numbered.count()
    if n == 0:
        raise ValueError("no claims")
    if n > max_rows:
        raise TooManyRows(f"over {max_rows} rows")
    field = lambda name: F.trim(F.coalesce(F.col(lines.columns[names.index(name)]), F.lit(""))) if name in names else F.lit("")
    number = lambda name: F.coalesce(F.expr(f"try_cast({name} as double)"), F.lit(0.0))
    rows = numbered.select("row", *[field(c).alias(c) for c in COLUMNS])
    producer = F.when(F.col("producer") == "", F.array().cast("array<string>")).when(F.col("address") == "", F.array("producer")).otherwise(F.array("producer", "address"))
    none = F.lit(None).cast("map<string,array<string>>")
    return rows.filter("image <> ''").select("row", "image", "beverage", "brand", "class", producer.alias("producer"), "origin", number("abv").alias("abv"), number("net_ml").alias("net_ml"), none.alias("aliases"))


def zip_entries(spark: SparkSession, path: str, max_bytes: int = 2 << 30) -> DataFrame:
    """(key, archive, entry, size, ordinal) of an archive: one row for each lower-cased base name, the last entry of that name.

    Only the archive's directory is read; declared sizes over ``max_bytes`` in all and archives without a file are refused.
    """
    return zip_archive(spark, path, content=False, max_bytes=max_bytes).filter("latest").select("key", "archive", "entry", "size", "ordinal")


def join_images(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Claims with their images; a row whose image is not in the archive gets an error and the others go on."""
    joined = rows.withColumn("key", F.lower("image")).join(entries, "key", "left")
    return joined.withColumn("error", F.when(F.col("entry").isNull(), F.concat(F.lit("no image "), F.col("image"))))


def png_sizes(spark: SparkSession, path: str, max_pixels: int = 50_000_000) -> DataFrame:
    """(path, width, height, error) from the headers of PNG and JPEG files, before anything is decoded."""
    return image_sizes(spark.read.format("binaryFile").load(path).select("path", "content"), max_pixels=max_pixels).drop("content")


def diagnostic(spark: SparkSession, path: str, fingerprint: str, not_before: float = 0.0) -> DataFrame:
    """The records of a diagnostic file whose header comes first, has the engine's fingerprint and ran no earlier than ``not_before``."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is None or '"diagnostic"' not in first[0]:
        raise ValueError("no header")
    h = lines.limit(1).select(F.get_json_object("value", "$.fingerprint").alias("f"), F.get_json_object("value", "$.ran").cast("double").alias("ran")).first()
    if h.f != fingerprint:
        raise ValueError("made by another engine")
    if (h.ran or 0.0) < not_before:
        raise ValueError("older than the sources")
    return lines.filter(F.get_json_object("value", "$.diagnostic").isNull())


__all__ = ["APPLICATION", "COLUMNS", "applications", "charset", "claims_csv", "diagnostic", "join_images", "manifest", "png_sizes", "sliced", "truth", "zip_entries"]
