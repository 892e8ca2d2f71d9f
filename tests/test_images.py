"""Pixels against hand cases and plain second implementations."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.operators import images as I

SCHEMA = "label string, width int, height int, pix binary"


def table(spark, *arrays, schema=SCHEMA):
    return spark.createDataFrame([(f"i{k}", a.shape[1], a.shape[0], a.astype(np.uint8).tobytes()) for k, a in enumerate(arrays)] + [("null", None, None, None)], schema)


def arrays(df):
    return {r.label: None if r.pix is None else np.frombuffer(bytes(r.pix), np.uint8).reshape(r.height, r.width) for r in df.collect()}


def ink(text):
    return np.array([[c == "#" for c in line] for line in text.split()], np.uint8)


def plain_distance(b, inside):
    """Shortest paths by relaxation, pixel by pixel."""
    h, w = b.shape
    d = {(y, x): math.inf if bool(b[y, x]) == inside else 0 for y in range(h) for x in range(w)}
    changed = True
    while changed:
        changed = False
        for (y, x), v in list(d.items()):
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if dy or dx:
                        near = d.get((y + dy, x + dx), 0 if inside else math.inf) + (3 if 0 in (dy, dx) else 4)
                        if near < v:
                            d[y, x] = v = near
                            changed = True
    return np.array([[0 if d[y, x] == math.inf else d[y, x] / 3 for x in range(w)] for y in range(h)])


def test_distances():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (1, 9), (7, 1), (9, 13), (12, 12)):
        for share in (0.0, 0.1, 0.7, 0.95, 1.0):
            b = (rng.random(shape) < share).astype(np.uint8)
            for inside in (True, False):
                assert np.allclose(I.chamfer(b, inside), plain_distance(b, inside), atol=1e-5)


def test_strokes_are_brought_to_a_width(spark):
    bar = np.zeros((30, 60), np.uint8)
    bar[12:18, 5:55] = 1
    got = arrays(I.with_stroke(table(spark, bar, np.zeros((5, 5), np.uint8)), 2.0))
    assert 1.0 <= I.stroke_of(got["i0"]) <= 3.0 < I.stroke_of(bar) and not got["i1"].any() and got["null"] is None
    wide = arrays(I.with_stroke(table(spark, bar), 9.0))["i0"]
    assert I.stroke_of(wide) > 7 and wide[14, 30] == 1
    same = arrays(I.with_stroke(table(spark, bar), I.stroke_of(bar)))["i0"]
    assert (same == bar).all()
    widths = {r.label: r.stroke_width for r in I.with_stroke_width(table(spark, bar, np.zeros((3, 3)))).collect()}
    assert widths["i1"] == 0 and widths["null"] is None and widths["i0"] == pytest.approx(I.stroke_of(bar))


def test_parts_seeds_and_cores(spark):
    weak = ink("##..#.# .#..#.# ..#...# ....... #.#.#.#")
    strong = ink("#...... ....#.. ....... ....... #.#.#..")
    of = I.parts(weak)
    assert of.max() == 7 and of[0, 0] == of[2, 2] == of[1, 1] and (of == 0).sum() == (weak == 0).sum()
    df = table(spark, weak).filter("pix is not null").withColumn("other", F.lit(bytearray(strong.tobytes())))
    assert (arrays(I.reconstructed(df, "other"))["i0"] == ink("##..#.. .#..#.. ..#.... ....... #.#.#..")).all()
    # A quarter of the first part is strict and half of the second: under a third of it a part stays whole.
    assert (arrays(I.hysteresis(df, "other", 0.34))["i0"] == ink("##..... .#..#.. ..#.... ....... #.#.#..")).all()


def test_ink_boxes_and_thresholds(spark):
    grey = np.array([[10, 200, 90], [250, 99, 100]], np.uint8)
    got = {r.label: (r.ink, r.ink_box and tuple(r.ink_box)) for r in I.with_ink(I.inked(table(spark, grey, np.full((2, 2), 255)), 100)).collect()}
    assert got == {"i0": (3, (0, 0, 3, 2)), "i1": (0, None), "null": (None, None)}
    assert (arrays(I.shown(I.inked(table(spark, grey), 100)))["i0"] == [[0, 255, 0], [255, 0, 255]]).all()


def test_blur_and_resize(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 256, (9, 11)).astype(np.uint8)
    k = I.gaussian(0.8)
    p = np.pad(g.astype(float), 3, mode="edge")
    want = np.array([[sum(k[i] * k[j] * p[y + i, x + j] for i in range(7) for j in range(7)) for x in range(11)] for y in range(9)])
    assert np.abs(arrays(I.blurred(table(spark, g), 0.8))["i0"] - want).max() <= 0.5 + 1e-6
    assert (arrays(I.blurred(table(spark, g), 0))["i0"] == g).all()
    assert (arrays(I.resized(table(spark, g), 11, 9))["i0"] == g).all()
    flat = arrays(I.resized(table(spark, np.full((8, 8), 77)), 3, 20))["i0"]
    assert flat.shape == (20, 3) and (flat == 77).all()
    ramp = np.tile(np.arange(0, 160, 10), (4, 1))
    half = arrays(I.resized(table(spark, ramp), 8, 2))["i0"]
    assert np.abs(half[0, 2:-2].astype(int) - np.array([45, 65, 85, 105])).max() <= 1


def test_turns_and_warps(spark):
    g = np.arange(24).reshape(4, 6)
    assert (arrays(I.quarter_turned(table(spark, g), 1))["i0"] == np.rot90(g, -1)).all()
    assert (arrays(I.quarter_turned(I.quarter_turned(table(spark, g), 1), 3))["i0"] == g).all()
    square = np.random.default_rng(3).integers(0, 256, (8, 8)).astype(np.uint8)
    assert (arrays(I.rotated(table(spark, square), 90.0))["i0"] == np.rot90(square, -1)).all()
    assert (arrays(I.rotated(table(spark, square), 0.0))["i0"] == square).all()
    moved = table(spark, square).withColumn("m", F.array(*map(F.lit, [1.0, 0.0, -2.0, 0.0, 1.0, -1.0, 0.0, 0.0, 1.0])))
    got = arrays(I.warped(moved, "m", fill=9))["i0"]
    assert (got[1:, 2:] == square[:-1, :-2]).all() and (got[0, :] == 9).all() and (got[:, :1] == 9).all()


def read_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, w, h, kind, packed = 8, 0, 0, 0, b""
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(name + body)
        if name == b"IHDR":
            w, h, _, kind = struct.unpack(">IIBB", body[:10])
        packed += body if name == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, -1)[:, 1:].reshape((h, w, 3) if kind == 2 else (h, w))


def test_crops(spark):
    g = np.arange(60).reshape(6, 10)
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    df = spark.createDataFrame([(k, 10, 6, g.astype(np.uint8).tobytes(), b, t) for k, b, t in (("in", (2, 1, 5, 4), 0), ("over", (7, 4, 99, 99), 0), ("none", (20, 20, 30, 30), 0), ("null", None, 0), ("turned", (2, 1, 5, 3), 1))], f"{SCHEMA}, box {box}, turn int")
    got = {r.label: r.crop for r in I.cropped(df, "box", "turn").collect()}
    assert (read_png(bytes(got["in"])) == g[1:4, 2:5]).all() and (read_png(bytes(got["over"])) == g[4:, 7:]).all() and got["none"] is None and got["null"] is None
    assert (read_png(bytes(got["turned"])) == np.rot90(g[1:3, 2:5], -1)).all()
    colours = np.arange(24).reshape(2, 4, 3)
    assert (read_png(I.png(colours)) == colours).all()


def test_maps_of_points(spark):
    c = lambda *v: [(F.lit(float(x)), F.lit(float(y))) for x, y in v]
    source, target = [(0, 0), (30, 2), (28, 20), (-1, 22)], [(3, 1), (40, -2), (35, 25), (2, 30)]
    df = spark.range(1).withColumn("m", I.homography(c(*source), c(*target)))
    df = df.withColumn("back", I.inverse(F.col("m")))
    for p, q in zip(source, target, strict=True):
        there = df.select(I.apply(F.col("m"), *c(p)[0]).alias("p")).first().p
        again = df.select(I.apply(F.col("back"), *c(q)[0]).alias("p")).first().p
        assert tuple(there) == pytest.approx(q) and tuple(again) == pytest.approx(p)
    m = df.first().m
    assert m[8] == pytest.approx(1.0)
    box = df.select(I.box_of(F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(4).alias("x1"), F.lit(2).alias("y1")), lambda x, y: I.rotate(x, y, F.lit(0.0), F.lit(0.0), 30)).alias("b")).first().b
    assert tuple(box) == (-1, 0, 4, 4)
    assert df.select(I.levels(F.lit(200), 2.0, -10.0).alias("v")).first().v == 255 and df.select(I.glare(F.lit(100), F.lit(5), F.lit(5), 5.0, 5.0, 10.0, 1.0).alias("v")).first().v == 255


def test_stacks_are_worked_on_as_single_images_in_many_tasks(spark):
    """Images of one size go through the morphology as one array, with each image's own result; bars are dealt to as many tasks as shuffles have."""
    rng = np.random.default_rng(4)
    inks = [(rng.random((h, w)) < p).astype(np.uint8) for h, w in ((9, 12), (5, 7), (1, 1)) for p in (0.0, 0.6, 0.9, 1.0)]
    for stack in (np.stack(inks[k : k + 4]) for k in (0, 4, 8)):
        for inside in (True, False):
            assert (I.chamfer(stack, inside) == np.stack([I.chamfer(x, inside) for x in stack])).all()
        assert (I.thicker(stack, 1.5) == np.stack([I.thicker(x, 1.5) for x in stack])).all()
    rows = [(k, x.shape[1], x.shape[0], bytearray(x.tobytes())) for k, x in enumerate(inks)] + [(99, None, None, None)]
    images = spark.createDataFrame(rows, "label int, width int, height int, pix binary").coalesce(1)
    assert {r.label: r.stroke_width for r in I.with_stroke_width(images).collect()} == {k: I.stroke_of(x) for k, x in enumerate(inks)} | {99: None}
    grown = {r.label: r.pix for r in I.dilated(images, 1.5).collect()}
    assert all(bytes(grown[k]) == I.thicker(x, 1.5).astype(np.uint8).tobytes() for k, x in enumerate(inks)) and grown[99] is None
    from veriframe.plans import image_queries

    assert image_queries.bars(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
