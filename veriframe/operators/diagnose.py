"""Why a claim was not verified: how near the reading came, whatever the rules say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from veriframe.functions import batch
from veriframe.functions import text as T
from veriframe.operators import geometry
from veriframe.staging import shuffled, staged

BLOCK_GATE, LEAST_BLOCK = 0.25, 8


@pandas_udf(DoubleType())
def infix_share(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The cost of a spelling's best stretch of a reading, all substitutions alike, as a share of the spelling; 1 for an empty one."""
    for a, b in batches:
        size = a.str.len().to_numpy()
        yield pd.Series(np.where(size > 0, batch.infix_edits(a.tolist(), b.tolist()) / np.maximum(size, 1), 1.0))


def _nearest(pairs: DataFrame, what: str) -> DataFrame:
    near = pairs.filter((F.col("cnorm") != "") & ~T.beyond(T.histogram("cnorm"), T.histogram("norm"), 2 * F.length("cnorm") - 1))
    near = near.withColumn("d", infix_share("cnorm", "norm"))
    return near.groupBy("label", "claim").agg(F.min("d").alias(f"{what}_distance"), F.min(F.struct("d", "text"))["text"].alias(f"{what}_text"))


def reach(detections: DataFrame, candidates: DataFrame) -> DataFrame:
    """(label, claim, distance, text): the least distance of any claimed spelling to a stretch of any reading, without a confidence floor."""
    from veriframe.config import Options

    everything = geometry.runs(detections, Options(min_confidence=-1.0)).select("label", "norm", "text")
    own = staged(candidates.filter("claimed").select("label", "claim", F.col("norm").alias("cnorm")))
    found = _nearest(own.join(shuffled(everything), "label"), "reach")
    claims = own.select("label", "claim").distinct()
    return claims.join(shuffled(found), ["label", "claim"], "left").select("label", "claim", F.coalesce("reach_distance", F.lit(1.0)).alias("distance"), F.coalesce("reach_text", F.lit("")).alias("text"))


def probes(detections: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each claim the least distance to a chain, to one box, to two boxes in either order, and to neighbours in reading order."""
    det = staged(geometry.reading_order(detections.withColumn("norm", T.normalize("text"))))
    own = staged(candidates.filter("claimed").select("label", "claim", F.col("norm").alias("cnorm")))
    chain = geometry.runs(detections).select("label", "norm", "text")
    boxes = det.select("label", "norm", "text")
    a, b = det.alias("a"), det.alias("b")
    two = a.join(shuffled(b), (F.col("a.label") == F.col("b.label")) & (F.col("a.pos") != F.col("b.pos"))).select(F.col("a.label").alias("label"), F.concat("a.norm", "b.norm").alias("norm"), F.concat_ws(" ", "a.text", "b.text").alias("text"))
    longest = own.groupBy("label").agg(F.max(F.length("cnorm")).alias("longest"))
    before = Window.partitionBy("label").orderBy("pos").rowsBetween(0, 13)
    tail = det.withColumn("ahead", F.collect_list("norm").over(before)).join(shuffled(longest), "label")
    grown = tail.select("label", "longest", F.explode(F.transform(F.sequence(F.lit(1), F.size("ahead")), lambda k: F.array_join(F.slice("ahead", F.lit(1), k), ""))).alias("norm"))
    sequence = grown.filter(F.length("norm") <= 2 * F.col("longest") + 8).select("label", "norm", F.col("norm").alias("text"))
    out = own.select("label", "claim").distinct()
    for name, side in (("run", chain), ("box", boxes), ("pair", two), ("sequence", sequence)):
        out = out.join(shuffled(staged(_nearest(own.join(shuffled(side), "label"), name))), ["label", "claim"], "left")
    return out


def block_boxes(detections: DataFrame, references: DataFrame) -> DataFrame:
    """(label, n, region): the boxes whose text lies within a passage, and their union; a box counts once for each passage.

    Of a box's text, cut into one piece more than the edits allowed, one piece stands in the passage as it is: boxes and
    passages meet by an equi-join of pieces and of the passages' stretches of that length, and only pairs that meet are aligned.
    Equal texts, of boxes or of passages, are aligned once, whatever their number.
    """
    parts = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, since a few bytes of pairs are many alignments
    det = staged(detections.select("label", "x0", "y0", "x1", "y1", T.normalize("text").alias("norm")).filter(F.length("norm") >= LEAST_BLOCK))
    n = F.length("norm")
    box = det.select("norm").distinct().withColumn("pieces", F.floor(n * BLOCK_GATE + 1e-9).cast("int") + 1).withColumn("q", F.floor(n / F.col("pieces")).cast("int"))
    start = lambda k: F.floor(k * F.length("norm") / F.col("pieces")).cast("int") + 1
    cut = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.col("norm").substr(start(k), F.col("q"))))
    box = staged(box.select(F.monotonically_increasing_id().alias("box"), "norm", "q", cut.alias("cut")))
    want = references.select(T.normalize("text").alias("want")).filter("want <> ''").groupBy("want").agg(F.count("*").alias("copies"))
    want = staged(want.withColumn("ref", F.monotonically_increasing_id()))
    sizes = box.select("q").distinct()  # a handful: pieces have a length of 2 to 4
    long = want.crossJoin(F.broadcast(sizes)).filter(F.length("want") >= F.col("q"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("want") - F.col("q") + 1), lambda i: F.col("want").substr(i, F.col("q"))))
    held = long.select("ref", F.explode(grams).alias("gram"))
    met = box.select("box", F.explode("cut").alias("gram")).join(held, "gram").select("box", "ref").distinct()
    pairs = met.repartition(parts, "box", "ref").join(box.select("box", "norm"), "box").join(want, "ref")
    near = pairs.withColumn("d", infix_share("norm", "want")).filter(F.col("d") <= BLOCK_GATE)
    hits = near.groupBy("norm").agg(F.sum("copies").alias("hits"))
    found = det.join(hits, "norm")
    return found.groupBy("label").agg(F.sum("hits").alias("n"), F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("region"))
