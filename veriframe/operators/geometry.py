"""Detections into chains: reading order, adjacency, bounded paths, one chain for each reading.

Everything is keyed by ``label`` (one image), so all steps share one partitioning. Boxes are half
open: ``x0, y0, x1, y1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriframe.config import DEFAULT, MAX_FOLLOW, MAX_RUN, Options
from veriframe.functions import text as T
from veriframe.staging import dealt, shuffled, staged


def kept(detections: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Detections that count as evidence: confident enough, and not blank."""
    return detections.filter((F.col("confidence") >= options.min_confidence) & (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))


def order_of_reading(boxes: list[tuple[int, int, int, int]]) -> list[int]:
    """Indexes in reading order, of one label's boxes in memory; ``reading_order`` has the rule."""
    lines: list[list[int]] = []
    for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0])):
        _, top, _, bottom = boxes[i]
        for line in lines:
            _, t, _, b = boxes[line[-1]]
            h = min(b - t, bottom - top)
            if h > 0 and min(b, bottom) - max(t, top) > h // 2:
                line.append(i)
                break
        else:
            lines.append([i])
    return [i for line in lines for i in sorted(line, key=lambda i: boxes[i][0])]


def reading_order(detections: DataFrame) -> DataFrame:
    """Adds ``pos``, the place in reading order within the label.

    From the top (then from the left, then by ``det_idx``) each box joins the first line whose last box it overlaps by more
    than half of the lower one's height; lines run from left to right. What a box joins depends on those placed before, so
    it is a fold over a label's sorted boxes, in the JVM: the state is each line's last box, and a box adds its line's number.
    A label's boxes are gathered once, with all their columns, and nothing is joined back.
    """
    others = [c for c in detections.columns if c not in ("label", "y0", "x0", "det_idx", "y1", "x1")]
    box = F.struct("y0", "x0", "det_idx", "y1", "x1", F.struct(*others).alias("rest")) if others else F.struct("y0", "x0", "det_idx", "y1", "x1")
    rows = detections.groupBy("label").agg(F.array_sort(F.collect_list(box)).alias("rows"))
    start = F.struct(F.array().cast("array<struct<t:int,b:int>>").alias("lines"), F.array().cast("array<int>").alias("at"))

    def overlaps(line: Column, b: Column) -> Column:
        h = F.least(line["b"] - line["t"], b["y1"] - b["y0"])
        return (h > 0) & (F.least(line["b"], b["y1"]) - F.greatest(line["t"], b["y0"]) > F.floor(h / 2))

    def step(acc: Column, b: Column) -> Column:
        own = F.struct(b["y0"].cast("int").alias("t"), b["y1"].cast("int").alias("b"))
        joined = F.array_position(F.transform(acc["lines"], lambda line: overlaps(line, b)), True).cast("int")
        lines = F.when(joined > 0, F.transform(acc["lines"], lambda line, i: F.when(i == joined - 1, own).otherwise(line))).otherwise(F.concat(acc["lines"], F.array(own)))
        return F.struct(lines.alias("lines"), F.concat(acc["at"], F.array(F.when(joined > 0, joined - 1).otherwise(F.size(acc["lines"])))).alias("at"))

    placed = rows.withColumn("at", F.aggregate("rows", start, step, lambda acc: acc["at"]))
    # The place before the line's own order decides between boxes that begin at one x.
    order = F.array_sort(F.transform("at", lambda line, k: F.struct(line.alias("line"), F.col("rows")[k]["x0"].alias("x0"), k.alias("k"))))
    out = placed.select("label", "rows", F.posexplode(order).alias("pos", "o")).select("label", "pos", F.col("rows")[F.col("o.k")].alias("b"))
    at = {"pos": F.col("pos"), "label": F.col("label")} | {c: F.col(f"b.{c}") for c in ("y0", "x0", "det_idx", "y1", "x1")} | {c: F.col(f"b.rest.`{c}`") for c in others}
    return out.select(*[at[c].alias(c) for c in [*detections.columns, "pos"]])


def follows(a: str, b: str) -> Column:
    """Whether box ``b`` continues box ``a``: beside it on one band, or under it in one column."""
    c = lambda side, name: F.col(f"{side}.{name}")
    h = F.least(c(a, "y1") - c(a, "y0"), c(b, "y1") - c(b, "y0"))
    half = F.floor(h / 2)
    band = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    across = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    gap = c(b, "y0") - c(a, "y1")
    beside = (c(b, "x0") >= c(a, "x0")) & (c(b, "x0") - c(a, "x1") <= h)
    under = (2 * across >= F.least(c(a, "x1") - c(a, "x0"), c(b, "x1") - c(b, "x0"))) & (gap >= -half) & (gap <= h)
    return (h > 0) & F.when(band > half, beside).otherwise(under)


def successors(ordered: DataFrame, most: int = MAX_FOLLOW) -> DataFrame:
    """(label, a, b): the first ``most`` boxes, in reading order, that may follow each.

    Boxes meet in the cells of a grid, of about a box's mean height and width on the label, that they reach: as the one
    that follows, the cells under the box; as the one before, also those within a box's height to the right of it and below. Two boxes
    meet in the first cell that both reach, so no pair comes twice and a label of many boxes isn't squared. Boxes
    without a height follow nothing; ``x1 >= x0`` is taken for granted.
    """
    by = Window.partitionBy("label")
    slim = ordered.select("label", "pos", "x0", "y0", "x1", "y1").filter("y1 > y0")
    tall, wide = (F.greatest(F.ceil(F.avg(F.col(hi) - F.col(lo)).over(by)), F.lit(1)) for hi, lo in (("y1", "y0"), ("x1", "x0")))
    slim = slim.withColumn("tall", tall).withColumn("wide", wide)
    cell = lambda c, size: F.floor(F.col(c) / F.col(size))

    def reached(side: str, more: Column) -> DataFrame:
        ends = [(cell("x0", "wide"), F.floor((F.col("x1") + more) / F.col("wide"))), (cell("y0", "tall"), F.floor((F.col("y1") + more) / F.col("tall")))]
        out = slim.select("label", "pos", "x0", "y0", "x1", "y1", ends[0][0].alias("fx"), ends[1][0].alias("fy"), F.explode(F.sequence(*ends[0])).alias("cx"), F.sequence(*ends[1]).alias("cys"))
        return out.select("label", "pos", "x0", "y0", "x1", "y1", "fx", "fy", "cx", F.explode("cys").alias("cy")).alias(side)

    a, b = reached("a", F.col("y1") - F.col("y0")), reached("b", F.lit(0))
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    first = (F.col("a.cx") == F.greatest("a.fx", "b.fx")) & (F.col("a.cy") == F.greatest("a.fy", "b.fy"))
    pairs = a.join(shuffled(b), same & first & (F.col("a.pos") != F.col("b.pos")) & follows("a", "b"))
    pairs = pairs.select(F.col("a.label").alias("label"), F.col("a.pos").alias("a"), F.col("b.pos").alias("b"))
    rank = F.row_number().over(Window.partitionBy("label", "a").orderBy("b"))
    return pairs.withColumn("k", rank).filter(F.col("k") <= most).drop("k")


def chains(ordered: DataFrame, edges: DataFrame, most: int = MAX_RUN) -> DataFrame:
    """Every path of one to ``most`` boxes along the edges; ``pos`` as ``reading_order`` numbers it.

    Columns: label, path (positions), box, text, confidence (the least), parts, widest (the
    longest member's normalized length). Ordering by ``path`` is the order of a depth-first walk.
    A label's boxes, with those that follow each, are gathered once; paths grow within the label's row, so no
    level of them is joined or written.
    """
    follow = edges.groupBy("label", F.col("a").alias("pos")).agg(F.collect_list("b").alias("next"))
    node = ordered.select("label", "pos", F.struct("x0", "y0", "x1", "y1").alias("box"), "text", "confidence", F.length(T.normalize("text")).alias("w"))
    node = node.join(shuffled(follow), ["label", "pos"], "left").withColumn("next", F.coalesce("next", F.array().cast("array<int>")))
    # Many paths are made of a few boxes, so their tasks are not merged for being small.
    out = dealt(node, "label").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "box", "text", "confidence", "w", "next"))).alias("nodes"))

    def path(*fields: Column) -> Column:
        return F.struct(*[f.alias(c) for c, f in zip(("path", "box", "text", "confidence", "parts", "widest"), fields, strict=True)])

    def longer(p: Column, n: Column) -> Column:
        box = F.struct(*[g(p["box"][c], n["box"][c]).alias(c) for c, g in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))])
        return path(F.concat(p["path"], F.array(n["pos"])), box, F.concat_ws(" ", p["text"], n["text"]), F.least(p["confidence"], n["confidence"]), p["parts"] + 1, F.greatest(p["widest"], n["w"]))

    node_at = lambda k: F.get("nodes", k)
    out = out.withColumn("level1", F.transform("nodes", lambda n: path(F.array(n["pos"]), n["box"], n["text"], n["confidence"], F.lit(1), n["w"])))
    for k in range(1, most):
        grown = lambda p: F.transform(node_at(F.element_at(p["path"], -1))["next"], lambda b: longer(p, node_at(b)))
        out = out.withColumn(f"level{k + 1}", F.flatten(F.transform(f"level{k}", grown)))
    return out.select("label", F.explode(F.concat(*[f"level{k + 1}" for k in range(most)])).alias("p")).select("label", "p.*")


def one_for_each_reading(paths: DataFrame) -> DataFrame:
    """Of chains of one normalized text: a single box first, then the smaller area, then the first walked."""
    area = (F.col("box.x1") - F.col("box.x0")) * (F.col("box.y1") - F.col("box.y0"))
    rank = F.row_number().over(Window.partitionBy("label", "norm").orderBy(F.col("parts") != 1, area, "path"))
    return paths.withColumn("norm", T.normalize("text")).withColumn("rank", rank).filter("rank = 1").drop("rank")


def runs(detections: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The readings of each label that claims are compared to, with their numbers and class counts."""
    ordered = staged(reading_order(kept(detections, options)))
    found = one_for_each_reading(chains(ordered, staged(successors(ordered))))
    return found.withColumn("nums", T.numbers("norm")).withColumn("hist", T.histogram("norm"))


# Turned boxes.


def side_on(boxes: DataFrame) -> DataFrame:
    """(label, side_on): whether any box is taller than wide, so that a turned pass is worth making."""
    return boxes.groupBy("label").agg(F.coalesce(F.bool_or(F.col("y1") - F.col("y0") > F.col("x1") - F.col("x0")), F.lit(False)).alias("side_on"))


def covered_by_any(boxes: DataFrame, others: DataFrame) -> DataFrame:
    """(label, det_idx, covered): whether any box of ``others`` on the label covers more than half of the box."""
    slim = others.select("label", F.struct("x0", "y0", "x1", "y1").alias("o")).groupBy("label").agg(F.collect_list("o").alias("others"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    both = lambda o: F.greatest(F.least("x1", o["x1"]) - F.greatest("x0", o["x0"]), F.lit(0)) * F.greatest(F.least("y1", o["y1"]) - F.greatest("y0", o["y0"]), F.lit(0))
    hit = F.exists(F.coalesce("others", F.array().cast("array<struct<x0:int,y0:int,x1:int,y1:int>>")), lambda o: 2 * both(o) > area)
    return boxes.join(slim, "label", "left").select("label", "det_idx", ((area <= 0) | hit).alias("covered"))


def uncovered(turned: DataFrame, upright: DataFrame) -> DataFrame:
    """Turned boxes that neither an upright box nor an earlier accepted turned box covers, in order of ``det_idx``.

    A box is covered if another covers more than half of it, or if it has no area. What was accepted covers what follows, so it
    is a fold over a label's sorted boxes, in the JVM; the state is the boxes that cover.
    """
    kind = "struct<x0:int,y0:int,x1:int,y1:int>"
    corners = F.struct(*[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
    seen = upright.groupBy("label").agg(F.collect_list(corners).alias("seen"))
    columns = [c for c in turned.columns if c not in ("label", "det_idx")]
    rows = turned.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("det_idx", *columns))).alias("rows"))
    both = rows.join(seen, "label", "left").withColumn("seen", F.coalesce("seen", F.array().cast(f"array<{kind}>")))

    def step(acc: Column, b: Column) -> Column:
        area = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
        shared = lambda o: F.greatest(F.least(b["x1"], o["x1"]) - F.greatest(b["x0"], o["x0"]), F.lit(0)) * F.greatest(F.least(b["y1"], o["y1"]) - F.greatest(b["y0"], o["y0"]), F.lit(0))
        gone = (area <= 0) | F.exists(acc["seen"], lambda o: 2 * shared(o) > area)
        own = F.array(F.struct(*[b[c].cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]))
        return F.struct(F.when(gone, acc["seen"]).otherwise(F.concat(acc["seen"], own)).alias("seen"), F.concat(acc["taken"], F.array(~gone)).alias("taken"))

    start = F.struct(F.col("seen"), F.array().cast("array<boolean>").alias("taken"))
    found = both.withColumn("taken", F.aggregate("rows", start, step, lambda acc: acc["taken"]))
    kept_ = found.select("label", F.explode(F.filter("rows", lambda r, i: F.col("taken")[i])).alias("r"))
    return kept_.select(*[F.col("label") if c == "label" else F.col(f"r.`{c}`") for c in turned.columns])


def turned_back(width: Column, box: Column) -> Column:
    """A box found on the image turned by a quarter, in the upright image's coordinates."""
    return F.struct(box["y0"].alias("x0"), (width - box["x1"]).alias("y0"), box["y1"].alias("x1"), (width - box["x0"]).alias("y1"))


def worth_turning(boxes: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(label, turn): whether a turned pass is worth making: a box taller than wide or, given ``verdicts``, a claim that was not found or not decided."""
    tall = side_on(boxes).withColumnRenamed("side_on", "turn")
    if verdicts is None:
        return tall
    open_ = verdicts.groupBy("label").agg(F.bool_or(F.col("status").isin("NOT_FOUND", "REVIEW")).alias("turn"))
    return tall.select("label").join(open_, "label", "left").select("label", F.coalesce("turn", F.lit(False)).alias("turn"))


def with_turned(upright: DataFrame, turned: DataFrame, width: Column) -> DataFrame:
    """The upright detections and, mapped back, those of the turned image that no other covers; numbered anew from the top, then from the left.

    ``width`` is the upright image's width, an expression over ``turned``. Both have label, det_idx,
    x0, y0, x1, y1, text and confidence; the result also has ``rotated``.
    """
    back = turned_back(width, F.struct("x0", "y0", "x1", "y1"))
    columns = ["label", "det_idx", "x0", "y0", "x1", "y1", "text", "confidence"]
    mapped = turned.withColumn("b", back).select("label", "det_idx", *(F.col(f"b.{c}").cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")), "text", "confidence")
    both = upright.select(*columns, F.lit(False).alias("rotated")).unionByName(uncovered(mapped, upright).withColumn("rotated", F.lit(True)))
    place = F.row_number().over(Window.partitionBy("label").orderBy("y0", "x0", "rotated", "det_idx")) - 1
    return both.withColumn("det_idx", place.cast("int"))
