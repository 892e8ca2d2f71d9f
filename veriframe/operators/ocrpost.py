"""What surrounds text recognition: collapse of frames into text, boxes from probability maps, choices between readings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriframe.config import BOX_THRESHOLD, MIN_SIDE, SCORE_THRESHOLD, UNCLIP

BOX = "array<struct<x0:int,y0:int,x1:int,y1:int>>"


def ctc_decode(frames: DataFrame, charset: list[str]) -> DataFrame:
    """(crop, text, confidence) from ``frames`` (crop, t, probs array): the best class of each frame, without blanks and repeats.

    Class 0 is the blank; of equal classes the first wins; confidence is the mean probability of
    what was emitted, 0 for nothing. The charset is a small table and becomes a literal.
    """
    best = frames.select("crop", "t", F.array_position("probs", F.array_max("probs")).cast("int").alias("c"), F.array_max("probs").cast("double").alias("p")).withColumn("c", F.col("c") - 1)
    last = F.lag("c").over(Window.partitionBy("crop").orderBy("t"))
    kept = best.withColumn("emit", (F.col("c") != 0) & (F.coalesce(last, F.lit(-1)) != F.col("c")))
    chars = F.array(*[F.lit(c) for c in charset])
    char = F.coalesce(F.get(chars, F.col("c")), F.lit(""))
    letters = F.array_sort(F.collect_list(F.when(F.col("emit"), F.struct("t", char.alias("ch")))))
    return kept.groupBy("crop").agg(F.trim(F.array_join(F.transform(letters, lambda x: x["ch"]), "")).alias("text"), F.coalesce(F.avg(F.when(F.col("emit"), F.col("p"))), F.lit(0.0)).alias("confidence"))


def best_reading(readings: DataFrame) -> DataFrame:
    """Of a crop's readings (crop, turn, text, confidence) the most confident one, the first of equals."""
    return readings.groupBy("crop").agg(F.min(F.struct((-F.col("confidence")).alias("k"), "turn", "text", "confidence")).alias("r")).select("crop", "r.text", "r.confidence", "r.turn")


def is_tall(box: Column) -> Column:
    """Boxes over one and a half times as tall as wide are read in three turns."""
    return (box["y1"] - box["y0"]) * 2 > (box["x1"] - box["x0"]) * 3


def regions(prob: np.ndarray, threshold: float = BOX_THRESHOLD, score: float = SCORE_THRESHOLD, min_side: int = MIN_SIDE) -> list[tuple[int, int, int, int]]:
    """Bounds (last place included) of the 8-connected regions at or over the threshold whose mean reaches the score, in order of their first pixel."""
    h, w = prob.shape
    mask = prob >= threshold
    label = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:  # each pixel takes the least label around it until nothing changes
        pad = np.pad(label, 1, constant_values=h * w)
        least = np.minimum.reduce([pad[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        new = np.where(mask, least, h * w)
        if (new == label).all():
            break
        label = new
    out = []
    for k in np.unique(label[mask]):
        ys, xs = np.nonzero(label == k)
        if prob[ys, xs].mean() >= score and xs.max() - xs.min() + 1 >= min_side and ys.max() - ys.min() + 1 >= min_side:
            out.append((int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())))
    return out


def _round(v: float) -> int:
    return int(np.floor(abs(v) + 0.5) * (1 if v >= 0 else -1))


def grown(bounds: tuple[int, int, int, int], sx: float, sy: float, width: int, height: int, unclip: float = UNCLIP) -> tuple[int, int, int, int] | None:
    """A region's box on the image: grown by area over perimeter, scaled, rounded and clipped; nothing if no area is left."""
    x0, y0, x1, y1 = bounds
    bw, bh = x1 - x0 + 1, y1 - y0 + 1
    d = bw * bh * unclip / (2 * (bw + bh))
    box = max(0, _round((x0 - d) * sx)), max(0, _round((y0 - d) * sy)), min(width, _round((x1 + 1 + d) * sx)), min(height, _round((y1 + 1 + d) * sy))
    return box if box[2] > box[0] and box[3] > box[1] else None


def boxes(maps: DataFrame, threshold: float = BOX_THRESHOLD, score: float = SCORE_THRESHOLD, min_side: int = MIN_SIDE, unclip: float = UNCLIP) -> DataFrame:
    """(map, boxes) from probability maps (map, rows, cols, prob array, width, height)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for r in g.itertuples():
                p = np.asarray(r.prob, np.float64).reshape(r.rows, r.cols)
                found = (grown(b, r.width / r.cols, r.height / r.rows, r.width, r.height, unclip) for b in regions(p, threshold, score, min_side))
                out.append((r.map, [dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b in found if b]))
            yield pd.DataFrame(out, columns=["map", "boxes"])

    return maps.select("map", "rows", "cols", "prob", "width", "height").mapInPandas(run, f"map long, boxes {BOX}")


def network_size(width: int, height: int, max_side: float) -> tuple[int, int]:
    """The detector's input size: the longer side at most ``max_side``, both rounded to 32, at least 32."""
    k = min(1.0, max_side / max(width, height))
    return tuple(max(32, _round(v * k / 32) * 32) for v in (width, height))


# Mean and deviation of the three colours of common photographs.
MEAN, DEVIATION = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def network_input(rgb: np.ndarray) -> np.ndarray:
    """Colours first, scaled to 0..1 and standardised."""
    return ((rgb / 255.0 - MEAN) / DEVIATION).transpose(2, 0, 1).astype(np.float32)
