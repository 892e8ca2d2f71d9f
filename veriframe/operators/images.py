"""Pixels: morphology, geometry and resampling over tables of images.

An image is a row: any columns, and width, height and pix, its pixels row by row, one byte each: grey values, or 0 and 1 for ink.
Operators on pixels take such a table and a column's name and run on each image inside Arrow batches; what maps points,
boxes or single values is a column expression.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAR = np.float32(1e9)
FINER = 4  # strokes are a few pixels wide, so they are changed at so many times the resolution
TINY = 1e-12
STACKED = 1 << 20  # pixels of images of one size that are worked on at once
IMAGE = ("width", "height", "pix")

Result = dict[str, object]


def dealt(images: DataFrame) -> DataFrame:
    """``images`` over as many tasks as shuffles have: a small file of rows is many pixels, and would be one task."""
    return images.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def on_images(images: DataFrame, kernel: Callable[..., Result], adds: str = "", others: tuple[str, ...] = ()) -> DataFrame:
    """``images`` with what ``kernel`` returns for each.

    The kernel gets an image as an array (null pixels: None) and the values of the columns ``others``. It returns values of
    the columns ``adds`` (a schema) and, under ``pix``, an array that replaces the image.
    """
    return _on_rows(images, lambda pixels, rows: [kernel(p, *r) for p, r in zip(pixels, rows, strict=True)], adds, others)


def on_stacks(images: DataFrame, kernel: Callable[[np.ndarray], dict[str, object]], adds: str = "") -> DataFrame:
    """``images`` with what ``kernel`` returns for all those of one size in a batch, given as one array (images, rows, columns).

    It returns for each of ``adds`` and for ``pix`` a sequence with an entry for each image. A null image has null results.
    """

    def stacked(pixels: list[np.ndarray | None], _: list[tuple]) -> list[Result]:
        sizes: dict[tuple[int, int], list[int]] = {}
        for i, p in enumerate(pixels):
            if p is not None:
                sizes.setdefault(p.shape, []).append(i)
        out: list[Result] = [{} if adds else {"pix": None} for _ in pixels]
        for (h, w), found in sizes.items():
            step = max(1, STACKED // max(1, h * w))
            for first in range(0, len(found), step):
                some = found[first : first + step]
                made = kernel(np.stack([pixels[i] for i in some]))
                for k, i in enumerate(some):
                    out[i] = {n: v[k] for n, v in made.items()}
        return out

    return _on_rows(images, stacked, adds, ())


def _on_rows(images: DataFrame, kernel: Callable[[list, list[tuple]], list[Result]], adds: str, others: tuple[str, ...]) -> DataFrame:
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(adds) if adds else StructType()
    schema = StructType([*[f for f in images.schema.fields if f.name not in new.names], *new.fields])
    names = images.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(names.index(n)).to_pylist() for n in {*IMAGE, *others}}
            changed = {n: list(cols[n]) for n in IMAGE}
            made: dict[str, list] = {n: [] for n in new.names}
            pixels = [None if data is None or w is None or h is None else np.frombuffer(data, np.uint8).reshape(h, w) for w, h, data in zip(*(cols[n] for n in IMAGE), strict=True)]
            for i, out in enumerate(kernel(pixels, [tuple(cols[o][i] for o in others) for i in range(b.num_rows)])):
                if "pix" in out:
                    pix = out["pix"]
                    values = (None, None, None) if pix is None else (pix.shape[1], pix.shape[0], np.ascontiguousarray(pix, np.uint8).tobytes())
                    for n, v in zip(IMAGE, values, strict=True):
                        changed[n][i] = v
                for n in new.names:
                    made[n].append(out.get(n))
            kinds = {n: b.schema.field(k).type for k, n in enumerate(names)}
            arrays = [pa.array(made[f.name]) if f.name in made else pa.array(changed[f.name], kinds[f.name]) if f.name in changed else b.column(names.index(f.name)) for f in schema.fields]
            typed = [a if a.type != pa.null() else pa.nulls(len(a), _arrow(f)) for a, f in zip(arrays, schema.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([a.cast(_arrow(f)) if f.name in made else a for a, f in zip(typed, schema.fields, strict=True)], names=[f.name for f in schema.fields])

    return images.mapInArrow(run, schema)


def _arrow(field) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


# Ink.


def inked(images: DataFrame, darker_than: int) -> DataFrame:
    """Grey images to ink: pixels darker than ``darker_than``."""
    return on_images(images, lambda g: {"pix": None if g is None else g < darker_than})


def shown(images: DataFrame) -> DataFrame:
    """Ink to grey: black on white."""
    return on_images(images, lambda b: {"pix": None if b is None else np.where(b != 0, 0, 255)})


def with_ink(images: DataFrame) -> DataFrame:
    """Adds ink (how many pixels) and ink_box, the least box that holds them, null where there is none."""

    def kernel(b: np.ndarray | None) -> Result:
        if b is None:
            return {}
        ys, xs = np.nonzero(b)
        box = {"x0": int(xs.min()), "y0": int(ys.min()), "x1": int(xs.max()) + 1, "y1": int(ys.max()) + 1} if len(ys) else None
        return {"ink": len(ys), "ink_box": box}

    return on_images(images, kernel, "ink long, ink_box struct<x0:int,y0:int,x1:int,y1:int>")


def chamfer(ink: np.ndarray, inside: bool) -> np.ndarray:
    """Pixels from each inked pixel to the nearest blank one (``inside``; beyond the edge all is blank), or from each blank pixel to the nearest inked one.

    ``ink`` is an image, or images of one size along the first axes. Two passes with steps of 3 and 4 thirds, a row of all
    images at a time: what comes from the row before is a shifted minimum, what comes along the row a running minimum of the values less their place.
    """
    *many, h, w = ink.shape
    beyond = np.float32(0) if inside else FAR
    d = np.where((ink != 0) == inside, FAR, np.float32(0)).astype(np.float32)
    if not d.size:
        return d
    steps = 3 * np.arange(w + 1, dtype=np.float64)
    edge = np.full((*many, 1), beyond, np.float64)

    def along(row: np.ndarray) -> np.ndarray:
        return (np.minimum.accumulate(np.concatenate((edge, row), axis=-1) - steps, axis=-1) + steps)[..., 1:]

    for order, flip in ((range(h), 1), (range(h - 1, -1, -1), -1)):
        above = np.full((*many, w + 2), beyond, np.float64)
        for y in order:
            row = d[..., y, ::flip].astype(np.float64)
            near = np.minimum(above[..., 1:-1] + 3, np.minimum(above[..., :-2], above[..., 2:]) + 4)
            row = np.minimum(row, np.where(row == 0, 0, near))
            row = np.where(row == 0, 0, along(row))
            d[..., y, ::flip] = row
            above[..., 1:-1] = row
    return np.where(d >= FAR, 0, d / np.float32(3)).astype(np.float32)


def stroke_of(ink: np.ndarray) -> float:
    """Across a stroke of width w the distances run 1, 2, ... w/2 and back, with the mean w/4 + 1/2."""
    return strokes_of(ink[None])[0]


def strokes_of(inks: np.ndarray) -> list[float]:
    """``stroke_of`` images of one size."""
    far = chamfer(inks, True)
    return [max(1.0, 4 * float(d[on].astype(np.float64).sum()) / int(on.sum()) - 2) if on.any() else 0.0 for d, on in zip(far, inks != 0, strict=True)]


def with_stroke_width(images: DataFrame) -> DataFrame:
    """Adds stroke_width, of the mean distance within the ink; 0 where there is none."""
    return on_stacks(images, lambda b: {"stroke_width": strokes_of(b)}, "stroke_width double")


def thinner(ink: np.ndarray, r: float) -> np.ndarray:
    """Without the ink whose centre lies within r pixels of its edge, which is half a pixel from the outermost centres."""
    return (ink != 0) & (chamfer(ink, True) - 0.5 >= r) if r > 0 else ink != 0


def thicker(ink: np.ndarray, r: float) -> np.ndarray:
    """With the blank pixels whose centre lies within r pixels of the ink's edge; without ink there is nothing to grow."""
    return (ink != 0) | (chamfer(ink, False) - 0.5 <= r) & (ink != 0).any(axis=(-2, -1), keepdims=True) if r > 0 else ink != 0


def eroded(images: DataFrame, r: float) -> DataFrame:
    return on_stacks(images, lambda b: {"pix": thinner(b, r)})


def dilated(images: DataFrame, r: float) -> DataFrame:
    return on_stacks(images, lambda b: {"pix": thicker(b, r)})


def larger(x: np.ndarray, k: int) -> np.ndarray:
    return x.repeat(k, 0).repeat(k, 1)


def smaller(ink: np.ndarray, k: int) -> np.ndarray:
    """Blocks of k by k, ink where at least half of the block is."""
    h, w = ink.shape[0] // k, ink.shape[1] // k
    return 2 * (ink[: h * k, : w * k] != 0).reshape(h, k, w, k).sum((1, 3)) >= k * k


def with_stroke(images: DataFrame, target: float) -> DataFrame:
    """Brings strokes to ``target`` pixels by taking off or adding half of the difference on every side; a difference of under an eighth of a pixel stays."""

    def kernel(b: np.ndarray | None) -> Result:
        if b is None:
            return {"pix": None}
        now = stroke_of(b)
        more = (target - now) / 2 * FINER
        if now == 0 or target <= 0 or abs(more) < 0.5:
            return {"pix": b != 0}
        fine = larger(b, FINER)
        return {"pix": smaller(thinner(fine, -more) if more < 0 else thicker(fine, more), FINER)}

    return on_images(images, kernel)


def parts(ink: np.ndarray) -> np.ndarray:
    """Numbers of the 8-connected parts, from 1; 0 where there is no ink. A pixel takes the least number around it, and then that pixel's own, until nothing changes."""
    on = ink != 0
    h, w = on.shape
    none = on.size
    at = np.where(on, np.arange(on.size).reshape(h, w), none)
    while True:
        p = np.pad(at, 1, constant_values=none)
        least = np.minimum.reduce([p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
        flat = np.append(np.where(on, least, none).ravel(), none)
        new = flat[flat][:-1].reshape(h, w)
        if (new == at).all():
            break
        at = new
    out = np.zeros((h, w), np.int64)
    out[on] = np.unique(at[on], return_inverse=True)[1] + 1
    return out


def reconstructed(images: DataFrame, seed: str) -> DataFrame:
    """The parts of the ink that the pixels of the column ``seed`` (of the same size) touch."""

    def kernel(mask: np.ndarray | None, data: bytes | None) -> Result:
        if mask is None or data is None:
            return {"pix": None}
        of = parts(mask)
        hit = np.unique(of[(np.frombuffer(data, np.uint8).reshape(mask.shape) != 0) & (mask != 0)])
        return {"pix": np.isin(of, hit) & (mask != 0)}

    return on_images(images, kernel, others=(seed,))


def hysteresis(images: DataFrame, strong: str, core: float) -> DataFrame:
    """Permissive ink under the strict ink of the column ``strong``: each part goes if it holds none, stays whole if strict ink
    is less than the share ``core`` of it (faint text), and else shrinks to its strict pixels (dark text with a halo)."""

    def kernel(weak: np.ndarray | None, data: bytes | None) -> Result:
        if weak is None or data is None:
            return {"pix": None}
        strict = np.frombuffer(data, np.uint8).reshape(weak.shape) != 0
        of = parts(weak)
        size = np.bincount(of.ravel())
        held = np.bincount(of[strict].ravel(), minlength=len(size))
        whole = (held > 0) & (held < core * size)
        return {"pix": (weak != 0) & (held[of] > 0) & (whole[of] | strict)}

    return on_images(images, kernel, others=(strong,))


# Grey values.


def rounded(x: np.ndarray) -> np.ndarray:
    """To the nearest grey value, halves away from zero."""
    return np.floor(np.clip(x, 0, 255) + 0.5)


def gaussian(sigma: float) -> np.ndarray:
    reach = math.ceil(3 * sigma)
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def blurred(images: DataFrame, sigma: float) -> DataFrame:
    """A Gaussian of ``sigma`` pixels, cut at three of them, rows first and then columns; the edge is repeated."""

    def kernel(g: np.ndarray | None) -> Result:
        if g is None or sigma <= 0 or not g.size:
            return {"pix": g}
        k = gaussian(sigma)
        reach = len(k) // 2
        out = g.astype(float)
        for axis in (1, 0):
            p = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
            out = sum(w * np.take(p, np.arange(out.shape[axis]) + i, axis) for i, w in enumerate(k))
        return {"pix": rounded(out)}

    return on_images(images, kernel)


def cubic(x: np.ndarray) -> np.ndarray:
    """The Catmull-Rom kernel."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def resampling(size: int, new: int) -> np.ndarray:
    """Weights (new by size) of a resize along one side; the kernel widens when the image shrinks, and its weights add up to 1."""
    scale = size / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale - 0.5
    k = cubic((np.arange(size)[None, :] - centre[:, None]) / wide)
    return k / k.sum(1, keepdims=True)


def resized(images: DataFrame, width: int, height: int) -> DataFrame:
    """To ``width`` by ``height``, Catmull-Rom, side by side."""

    def kernel(g: np.ndarray | None) -> Result:
        return {"pix": None if g is None or not g.size else rounded(resampling(g.shape[0], height) @ g.astype(float) @ resampling(g.shape[1], width).T)}

    return on_images(images, kernel)


def quarter_turned(images: DataFrame, quarters: int) -> DataFrame:
    """Turned clockwise by quarters, exactly."""
    return on_images(images, lambda g: {"pix": None if g is None else np.rot90(g, -quarters)})


def seen_through(g: np.ndarray, inverse: np.ndarray, fill: int) -> np.ndarray:
    """The image behind a map of which ``inverse`` leads from the new pixels' centres to the old ones, bilinear; ``fill`` where there is none."""
    h, w = g.shape
    ys, xs = np.mgrid[0:h, 0:w]
    x, y = xs + 0.5, ys + 0.5
    z = inverse[6] * x + inverse[7] * y + inverse[8]
    z = np.where(z == 0, TINY, z)
    u, v = (inverse[0] * x + inverse[1] * y + inverse[2]) / z - 0.5, (inverse[3] * x + inverse[4] * y + inverse[5]) / z - 0.5
    out_of_it = (u < -1) | (v < -1) | (u > w) | (v > h) | ~np.isfinite(u + v)
    u, v = np.where(out_of_it, 0, u), np.where(out_of_it, 0, v)
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    fx, fy = u - x0, v - y0
    p = np.pad(g.astype(float), 2, constant_values=fill)
    at = lambda dx, dy: p[np.clip(y0 + dy, -2, h + 1) + 2, np.clip(x0 + dx, -2, w + 1) + 2]
    value = (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(1, 0)) + fy * ((1 - fx) * at(0, 1) + fx * at(1, 1))
    return np.where(out_of_it, fill, rounded(value))


def warped(images: DataFrame, inverse: str, fill: int = 255) -> DataFrame:
    """Seen through the map whose inverse (nine numbers) is the column ``inverse``; the size stays."""
    return on_images(images, lambda g, m: {"pix": None if g is None or m is None else seen_through(g, np.array(m), fill)}, others=(inverse,))


def rotated(images: DataFrame, degrees: float, fill: int = 255) -> DataFrame:
    """Turned about the centre, clockwise on screen; the size stays."""
    t = math.radians(degrees)
    c, s = math.cos(t), math.sin(t)

    def kernel(g: np.ndarray | None) -> Result:
        if g is None:
            return {"pix": None}
        cx, cy = g.shape[1] / 2, g.shape[0] / 2
        return {"pix": seen_through(g, np.array([c, s, cx - c * cx - s * cy, -s, c, cy + s * cx - c * cy, 0, 0, 1]), fill)}

    return on_images(images, kernel)


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of grey (h by w) or coloured (h by w by 3) pixels."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels, np.uint8).reshape(h, -1)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def cropped(images: DataFrame, box: str, turned: str | None = None) -> DataFrame:
    """Adds crop, the box as a PNG file, turned clockwise by the quarters of the column ``turned``; null where box and image share nothing.

    ``sinks.crop_box`` gives the box with air around it.
    """

    def kernel(g: np.ndarray | None, b, quarters: int = 0) -> Result:
        if g is None or b is None:
            return {}
        part = g[max(0, b["y0"]) : max(0, b["y1"]), max(0, b["x0"]) : max(0, b["x1"])]
        return {"crop": png(np.rot90(part, -(quarters or 0))) if part.size else None}

    return on_images(images, kernel, "crop binary", (box, turned) if turned else (box,))


# Values, points and boxes, as expressions.


def levels(v: Column, contrast: float, brightness: float) -> Column:
    """A grey value with another contrast, about the middle grey, and brightness."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.greatest(F.lit(0.0), contrast * (v - 128) + 128 + brightness) + 0.5))).cast("int")


def glare(v: Column, x: Column, y: Column, cx: float, cy: float, r: float, strength: float) -> Column:
    """A grey value within r of a point moved towards white, most at the point."""
    d = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
    k = F.when(d < r, strength * (1 - d / r) * (1 - d / r)).otherwise(0.0)
    return F.least(F.lit(255), F.floor(v + (255 - v) * k + 0.5)).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the optimizer copies a plain expression into each of its uses."""
    return F.transform(F.array(value), body)[0]


def inverse(m: Column) -> Column:
    """The inverse of a projective map of nine numbers."""

    def of(m: Column) -> Column:
        a, b, c, d, e, f, g, h, i = (m[k] for k in range(9))
        det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
        cofactors = (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)
        return let(F.when(det == 0, TINY).otherwise(det), lambda det: F.array(*[x / det for x in cofactors]))

    return let(m, of)


def of_unit_square(points: Column) -> Column:
    """The map that takes the corners (0, 0), (1, 0), (1, 1), (0, 1) to four points, given as eight numbers."""

    def of(p: Column) -> Column:
        x0, y0, x1, y1, x2, y2, x3, y3 = (p[k] for k in range(8))
        sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
        ax, ay, bx, by = x1 - x2, y1 - y2, x3 - x2, y3 - y2
        det = ax * by - bx * ay
        last = let(F.when(det == 0, TINY).otherwise(det), lambda det: F.array((sx * by - bx * sy) / det, (ax * sy - sx * ay) / det))
        return let(last, lambda q: F.array(x1 - x0 + q[0] * x1, x3 - x0 + q[1] * x3, x0, y1 - y0 + q[0] * y1, y3 - y0 + q[1] * y3, y0, q[0], q[1], F.lit(1.0)))

    return let(points, of)


def homography(source: list[tuple[Column, Column]], target: list[tuple[Column, Column]]) -> Column:
    """The projective map, nine numbers of which the last is 1, that takes four points to four points, by way of the unit square."""
    flat = lambda points: F.array(*[c.cast("double") for p in points for c in p])

    def both(b: Column, a: Column) -> Column:
        product = F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])
        return let(product, lambda m: F.transform(m, lambda x: x / m[8]))

    return let(inverse(of_unit_square(flat(source))), lambda b: let(of_unit_square(flat(target)), lambda a: both(b, a)))


def apply(m: Column, x: Column, y: Column) -> Column:
    """Where a map takes a point: x and y."""

    def of(m: Column) -> Column:
        z = m[6] * x + m[7] * y + m[8]
        return let(F.when(z == 0, TINY).otherwise(z), lambda z: F.struct(((m[0] * x + m[1] * y + m[2]) / z).alias("x"), ((m[3] * x + m[4] * y + m[5]) / z).alias("y")))

    return let(m, of)


def rotate(x: Column, y: Column, cx: Column, cy: Column, degrees: float) -> Column:
    """A point turned about another."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return F.struct((cx + c * (x - cx) - s * (y - cy)).alias("x"), (cy + s * (x - cx) + c * (y - cy)).alias("y"))


def box_of(box: Column, move: Callable[[Column, Column], Column]) -> Column:
    """The least whole box that holds where ``move`` takes a box's corners."""
    corners = F.array(*[move(box[x], box[y]) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    low, high = lambda v: F.floor(F.array_min(v)).cast("int"), lambda v: F.ceil(F.array_max(v)).cast("int")
    return F.struct(low(xs).alias("x0"), low(ys).alias("y0"), high(xs).alias("x1"), high(ys).alias("y1"))
