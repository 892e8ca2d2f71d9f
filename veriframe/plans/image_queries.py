"""Queries of pixels: bars drawn from the parts, and points and boxes that are moved."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriframe import sinks
from veriframe.operators import images as I
from veriframe.plans import sql as S
from veriframe.plans.fixtures import table, words

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# A bar for each part, `wide` by `tall` pixels, four pixels from the left and six from the top of its image.
_WIDE, _TALL = "CAST(20 + p_partkey % 15 AS INT)", "CAST(2 + p_size % 7 AS INT)"
_BARS = f"SELECT p_partkey AS label, {_WIDE} AS wide, {_TALL} AS tall FROM part"
_PIXELS = "unnest(range(0, wide)) AS x, tall FROM b), q AS (SELECT label, wide, tall, x, unnest(range(0, tall)) AS y FROM p"
_INSIDE = f"WITH b AS ({_BARS}), p AS (SELECT label, wide, {_PIXELS}), d AS (SELECT label, least(x + 1, wide - x, y + 1, tall - y) AS d FROM q)"


def bars(spark, d):
    """Ink images: label, wide, tall and the image's width, height and pix."""
    b = I.dealt(table(spark, d, "part").select("p_partkey", "p_size")).selectExpr("p_partkey AS label", f"{_WIDE} AS wide", f"{_TALL} AS tall")
    line = F.concat(F.lit("00000000"), F.repeat(F.lit("01"), F.col("wide")), F.lit("00000000"))
    blank = F.repeat(F.lit("00"), F.col("wide") + 8)
    pixels = F.concat(F.repeat(blank, F.lit(6)), F.repeat(line, F.col("tall")), F.repeat(blank, F.lit(6)))
    return b.select("label", "wide", "tall", (F.col("wide") + 8).alias("width"), (F.col("tall") + 12).alias("height"), F.unhex(pixels).alias("pix"))


@query(f"{_INSIDE} SELECT label, round(greatest(1, 4 * avg(d) - 2), 6) AS stroke_width FROM d GROUP BY label")
def image_strokes(spark, d):
    """Stroke widths by the mean distance within the ink."""
    return I.with_stroke_width(bars(spark, d)).select("label", F.round("stroke_width", 6).alias("stroke_width"))


@query(f"{_INSIDE} SELECT label, CAST(count(*) FILTER (WHERE d - 0.5 >= 1.5) AS BIGINT) AS ink FROM d GROUP BY label")
def image_eroded(spark, d):
    return I.with_ink(I.eroded(bars(spark, d), 1.5)).select("label", "ink")


@query(
    f"WITH b AS ({_BARS}), p AS (SELECT *, unnest(range(0, wide + 8)) AS x FROM b), q AS (SELECT *, unnest(range(0, tall + 12)) AS y FROM p), g AS (SELECT label, greatest(4 - x, x - 3 - wide, 0) AS dx, greatest(6 - y, y - 5 - tall, 0) AS dy FROM q) "
    "SELECT label, CAST(count(*) FILTER (WHERE (dx = 0 AND dy = 0) OR (3 * greatest(dx, dy) + least(dx, dy)) / CAST(3 AS DOUBLE) - 0.5 <= 2.5) AS BIGINT) AS ink FROM g GROUP BY label"
)
def image_dilated(spark, d):
    return I.with_ink(I.dilated(bars(spark, d), 2.5)).select("label", "ink")


@query(f"SELECT label, CAST(wide + 2 * (tall // 3) AS BIGINT) AS width, CAST(tall + 2 * (tall // 3) AS BIGINT) AS height, true AS png FROM (SELECT label, least(wide, 9999) AS wide, tall FROM ({_BARS}))")
def image_crops(spark, d):
    """What is cut out around each bar, as PNG files, by their headers."""
    found = I.with_ink(bars(spark, d))
    boxed = found.withColumn("box", sinks.crop_box(F.col("ink_box"), F.col("width"), F.col("height")))
    head = lambda at: F.conv(F.hex(F.substring("crop", at, 4)), 16, 10).cast("long")
    return I.cropped(I.shown(boxed), "box").select("label", head(17).alias("width"), head(21).alias("height"), (F.hex(F.substring("crop", 1, 8)) == "89504E470D0A1A0A").alias("png"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(greatest(0, least(255, 1.5 * (v - 128) + 128 - 20)) + 0.5) AS INT) AS levelled, CAST(least(255, floor(v + (255 - v) * CASE WHEN r < 40 THEN 0.7 * (1 - r / 40) * (1 - r / 40) ELSE 0 END + 0.5)) AS INT) AS glared FROM (SELECT l_orderkey, l_linenumber, floor(CAST(l_extendedprice AS DOUBLE) % 256) AS v, sqrt((l_quantity - 25) * (l_quantity - 25) + (l_linenumber * 5 - 10) * (l_linenumber * 5 - 10)) AS r FROM lineitem)")
def image_values(spark, d):
    """Levels and glare of single grey values."""
    v = F.floor(F.col("l_extendedprice").cast("double") % 256).cast("double")
    x, y = F.col("l_quantity").cast("double"), F.col("l_linenumber") * 5.0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", I.levels(v, 1.5, -20).alias("levelled"), I.glare(v, x, y, 25.0, 10.0, 40.0, 0.7).alias("glared"))


_QUAD = "p_partkey AS label, CAST(100 + p_partkey % 7 AS DOUBLE) AS w, CAST(60 + p_size % 5 AS DOUBLE) AS h, p_partkey % 11 + 0.5 AS ax, p_size % 9 - 3.0 AS ay, 90.0 + p_partkey % 13 AS bx, 4.0 - p_size % 6 AS \"by\", 110.0 + p_size % 8 AS cx, 70.0 + p_partkey % 5 AS cy, p_size % 4 - 2.0 AS dx, 55.0 + p_partkey % 9 AS dy"


@query(
    f"WITH q AS (SELECT {_QUAD} FROM part), t AS (SELECT *, ((ax - bx) * (\"by\" - dy) - (ay - \"by\") * (bx - dx)) / ((ax - cx) * (\"by\" - dy) - (ay - cy) * (bx - dx)) AS t FROM q) "
    "SELECT label, corner, round(x, 4) AS x, round(y, 4) AS y FROM (SELECT label, 0 AS corner, ax AS x, ay AS y FROM t UNION ALL SELECT label, 1, bx, \"by\" FROM t UNION ALL SELECT label, 2, cx, cy FROM t UNION ALL SELECT label, 3, dx, dy FROM t UNION ALL SELECT label, 4, ax + t * (cx - ax), ay + t * (cy - ay) FROM t)"
)
def image_projected(spark, d):
    """Rectangles that are seen as other quadrangles: their corners, and their centres, which go to where the diagonals meet."""
    q = table(spark, d, "part").selectExpr(*[c.replace('"by"', "`by`") for c in _QUAD.split(", ")])
    c = lambda k: F.col(k).cast("double")
    zero = F.lit(0.0)
    source = [(zero, zero), (c("w"), zero), (c("w"), c("h")), (zero, c("h"))]
    q = q.withColumn("m", I.homography(source, [(c(f"{k}x"), c(f"{k}y")) for k in "abcd"]))
    points = F.array(*[I.apply(F.col("m"), x, y) for x, y in [*source, (c("w") / 2, c("h") / 2)]])
    return q.select("label", F.posexplode(points).alias("corner", "p")).select("label", "corner", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


_TURN = "(SELECT label, det_idx, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y FROM w)"


@query(
    f"WITH w AS ({S.words()}), c AS (SELECT label, det_idx, 100.5 + cos(radians(30)) * (x - 100.5) - sin(radians(30)) * (y - 50.25) AS x, 50.25 + sin(radians(30)) * (x - 100.5) + cos(radians(30)) * (y - 50.25) AS y FROM {_TURN}) "
    "SELECT label, det_idx, CAST(floor(min(x)) AS INT) AS x0, CAST(floor(min(y)) AS INT) AS y0, CAST(ceil(max(x)) AS INT) AS x1, CAST(ceil(max(y)) AS INT) AS y1 FROM c GROUP BY label, det_idx"
)
def image_turned_boxes(spark, d):
    """The boxes of words on an image turned by thirty degrees."""
    turn = lambda x, y: I.rotate(x, y, F.lit(100.5), F.lit(50.25), 30)
    return words(spark, d).select("label", "det_idx", I.box_of(F.struct("x0", "y0", "x1", "y1"), turn).alias("b")).select("label", "det_idx", "b.*")
