"""Verbatim passages: finding them on a label, and judging their headings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.config import BAND, DEFAULT, EMPHASIS_CONTRAST, FOUND_ENOUGH, INLINE_GATE, MAX_REFERENCE_RUN, SEED_GATE, WORD_GATE, Options
from veriframe.functions import align, batch
from veriframe.functions import text as T
from veriframe.operators.geometry import kept, order_of_reading
from veriframe.staging import bounded_batches, shuffled, staged

REFERENCE_SCHEMA = (
    "label {label}, reference string, status string, reason string, distance double, agreement double, coverage double, read string, parts int, confidence double, "
    "x0 int, y0 int, x1 int, y1 int, heading string, heading_status string, heading_reason string, heading_ratio double, members array<int>"
)


PASSAGES, PASSAGE_BYTES, PASSAGES_AT_ONCE, SHORT_AT_ONCE = 10_000, 4 << 20, 256, 100
STARTS_AT_ONCE = 1 << 14  # boxes times passages of the labels that are searched together


@lru_cache(1 << 14)
def _norm(s: str) -> str:
    return T.normalize_with_offsets(s)[0]


def beside_or_under(a: tuple, b: tuple) -> bool:
    """The adjacency rule of ``geometry.follows`` for two boxes."""
    h = min(a[3] - a[1], b[3] - b[1])
    if h <= 0:
        return False
    if min(a[3], b[3]) - max(a[1], b[1]) > h // 2:
        return b[0] >= a[0] and b[0] - a[2] <= h
    across = min(a[2], b[2]) - max(a[0], b[0])
    return 2 * across >= min(a[2] - a[0], b[2] - b[0]) and -(h // 2) <= b[1] - a[3] <= h


def _distinct(kernel: Callable, claims: list[str], reads: list[str], *rest) -> np.ndarray | tuple[np.ndarray, ...]:
    """``kernel`` of the pairs, equal ones computed once."""
    at: dict[tuple[str, str], int] = {}
    place = np.array([at.setdefault(p, len(at)) for p in zip(claims, reads, strict=True)], np.int64)
    out = kernel([a for a, _ in at], [b for _, b in at], *rest)
    return tuple(v[place] for v in out) if isinstance(out, tuple) else out[place]


def _least(claims: list[str], reads: list[str]) -> np.ndarray:
    return batch.least_edits([x.translate(align._FOLD) for x in claims], [x.translate(align._FOLD) for x in reads], np.ones(len(claims), bool))


def find_on_labels(passages: list[str], labels: list[tuple[list[str], list[tuple]]], cc: int) -> list[list[dict | None]]:
    """For each label (texts and boxes of its detections) and each passage the chain of detections that reads most like it, grown greedily from each likely start.

    All starts of all labels and passages are bounded and aligned at once, all chains grow in step, and the continuations of a step are aligned at once.
    """
    wants = [_norm(p) for p in passages]
    norms = [[_norm(t) for t in texts] for texts, _ in labels]
    follows, pairs = [], []
    for n, (_, boxes) in enumerate(labels):
        order = order_of_reading(boxes)
        follows.append([[(k, j) for k, j in enumerate(order) if j != i and beside_or_under(boxes[i], boxes[j])] for i in range(len(boxes))])
        pairs += [(n, p, i) for p, want in enumerate(wants) if want for i in order]
    gate = np.array([SEED_GATE * 2 * len(norms[n][i]) for n, _, i in pairs])
    reads, shorts = ([wants[p] for _, p, _ in pairs], [norms[n][i] for n, _, i in pairs])
    least = _distinct(_least, shorts, reads)
    likely = np.flatnonzero((least <= gate) & (gate > 0)).tolist()
    cost, _, _ = _distinct(batch.infix, [shorts[k] for k in likely], [reads[k] for k in likely], cc)
    starts = [pairs[k] for k, c in zip(likely, cost.tolist(), strict=True) if c <= gate[k]]
    chains = [{"label": n, "passage": p, "members": [i], "text": labels[n][0][i], "norm": norms[n][i], "want": wants[p]} for n, p, i in starts]
    growing = chains
    for _ in range(MAX_REFERENCE_RUN - 1):
        growing = [c for c in growing if len(c["norm"]) < len(c["want"])]
        options = [(c, k, j, longer, _norm(longer)) for c in growing for k, j in follows[c["label"]][c["members"][-1]] if j not in c["members"] for longer in [f"{c['text']} {labels[c['label']][0][j]}"]]
        if not options:
            break
        cuts = [n[: len(c["want"])] for c, *_, n in options]
        costs = _distinct(batch.half_edits, cuts, [c["want"][: len(cut) + 8] for (c, *_), cut in zip(options, cuts, strict=True)], cc)
        best: dict[int, tuple] = {}
        for (c, k, j, longer, n), cut, x in zip(options, cuts, costs.tolist(), strict=True):
            near = (x / (2 * len(cut)) if cut else 1.0, k)
            if near[0] < 2.0 and (id(c) not in best or near < best[id(c)][0]):
                best[id(c)] = (near, c, j, longer, n)
        growing = []
        for _, c, j, longer, n in best.values():
            c["members"].append(j)
            c["text"], c["norm"] = longer, n
            growing.append(c)
    found: list[list[dict | None]] = [[None] * len(passages) for _ in labels]
    whole = _distinct(batch.infix, [c["want"] for c in chains], [c["norm"] for c in chains], cc)
    for c, x, start, stop in zip(chains, *(v.tolist() for v in whole), strict=True):
        now = found[c["label"]][c["passage"]]
        if now is None or x < now["cost"]:
            found[c["label"]][c["passage"]] = c | {"cost": x, "start": start, "stop": stop, "dist": x / (2 * len(c["want"]))}
    some = [c for of_label in found for c in of_label if c is not None]
    stretches = [c["norm"][c["start"] : c["stop"]] or c["norm"] for c in some]
    for c, stretch, n in zip(some, stretches, _distinct(batch.common, stretches, [c["want"] for c in some]).tolist(), strict=True):
        c["agreement"], c["coverage"] = (n / len(stretch) if stretch else 0.0), n / len(c["want"])
    return found


def find_passages(passages: list[str], texts: list[str], boxes: list[tuple], cc: int) -> list[dict | None]:
    return find_on_labels(passages, [(texts, boxes)], cc)[0]


def find_passage(passage: str, texts: list[str], boxes: list[tuple], cc: int) -> dict | None:
    return find_passages([passage], texts, boxes, cc)[0]


def find_heading(want: str, members: list[int], texts: list[str], boxes: list[tuple], cc: int) -> list[int] | None:
    """The detections of a heading that stands apart from the passage, in order, or nothing if a word is missing."""
    body = boxes[min(members, key=lambda m: boxes[m][1])]
    h = body[3] - body[1]
    if h <= 0:
        return None
    found = []
    for word in filter(None, map(_norm, want.split())):
        best, gate = None, WORD_GATE
        for i, b in enumerate(boxes):
            outside = b[1] >= body[3] or b[3] < body[1] - BAND * h
            inside = b[1] >= body[1] and b[3] <= body[3] and b[0] >= body[0]
            if not outside and not inside and (d := align.distance(word, _norm(texts[i]), cc)) < gate:
                best, gate = i, d
        if best is None:
            return None
        found.append(best)
    return sorted(found, key=lambda i: (boxes[i][1], boxes[i][0])) or None


def has_capitals_only(s: str) -> bool:
    return any(c.isalpha() for c in s) and not any(c.islower() for c in s)


def judge_heading(read: str, ratio: float | None) -> tuple[str, str]:
    """Capitals first, then weight: the heading's strokes against the body's."""
    if not has_capitals_only(read):
        return "MISMATCH", "header_not_capitals"
    if ratio is None:
        return "REVIEW", "weight_not_measurable"
    return ("VERIFIED", "") if ratio >= EMPHASIS_CONTRAST else ("REVIEW", "header_weight_uncertain")


def parts_of(members: list[int], norms: list[str], boxes: list[tuple], n: int) -> tuple[list[tuple], list[tuple]] | None:
    """The boxes of a heading of n normalized characters at the front of a chain, and of the body.

    The box that the heading ends in is cut in proportion to its characters, unless two pixels or fewer would be left.
    """
    head, body, got = [], [], 0
    for m in members:
        x0, y0, x1, y1 = boxes[m]
        size = len(norms[m])
        if got >= n:
            body.append(boxes[m])
        elif got + size <= n + 2:
            head.append(boxes[m])
        else:
            cut = x0 + int((x1 - x0) * (n - got) / size)
            if cut <= x0 + 2 or cut >= x1 - 2:
                return None
            head.append((x0, y0, cut, y1))
            body.append((cut, y0, x1, y1))
        got += size
    return head, body


def contrast(gray: np.ndarray | None, parts: tuple[list[tuple], list[tuple]] | None) -> float | None:
    """The stroke width of a heading over the body's; nothing where either can't be measured."""
    if gray is None or parts is None:
        return None
    head, body = (stroke_width(gray, p) for p in parts)
    return head / body if head and body else None


Heading = tuple[str | None, str | None, str | None, float | None]


def _heading(want: str, best: dict, texts: list[str], norms: list[str], boxes: list[tuple], gray: np.ndarray | None, cc: int) -> Heading:
    """A heading set apart is looked for first; else it is the front of the match, if that reads like it."""
    members = best["members"]
    apart = find_heading(want, members, texts, boxes, cc)
    if apart is not None:
        read = " ".join(texts[i].strip() for i in apart)
        parts = [boxes[i] for i in apart], [boxes[m] for m in members]
    else:
        word = _norm(want)
        _, at = T.normalize_with_offsets(best["text"])
        start, stop = best["start"], min(best["start"] + len(word), len(best["norm"]))
        read = best["text"][at[start] : at[stop]].strip() if start < stop < len(at) else ""
        if not read or align.infix_distance(word, _norm(read), cc) > INLINE_GATE:
            return "", "REVIEW", "heading not read", None
        parts = parts_of(members, norms, boxes, len(word))
    ratio = contrast(gray, parts) if has_capitals_only(read) else None
    return read, *judge_heading(read, ratio), ratio


def _judge(label: str, name: str, passage: str, span: tuple[int, int] | None, best: dict | None, texts: list[str], boxes: list[tuple], conf: list[float], idx: list[int], gray: np.ndarray | None, cc: int) -> tuple:
    want_heading = passage[span[0] : span[1]] if span and 0 <= span[0] < span[1] <= len(passage) else ""
    if best is None:
        blank = (("", "NOT_FOUND", "warning_not_read", None) if want_heading else (None, None, None, None))
        return (label, name, "NOT_FOUND", "not_found", None, None, None, None, None, None, None, None, None, None, *blank, None)
    members = best["members"]
    agree, cover = best["agreement"], best["coverage"]
    status, reason = ("VERIFIED", "") if best["cost"] == 0 else ("NOT_FOUND", "warning_not_read") if cover < FOUND_ENOUGH else ("REVIEW", "warning_read_imperfectly")
    _, at = T.normalize_with_offsets(best["text"])
    read = best["text"][at[best["start"]] : at[best["stop"]]].strip() if best["start"] < best["stop"] < len(at) else best["text"]
    b = [boxes[m] for m in members]
    region = (min(x[0] for x in b), min(x[1] for x in b), max(x[2] for x in b), max(x[3] for x in b))
    heading: Heading = (None, None, None, None)
    if want_heading:
        heading = ("", "NOT_FOUND", "warning_not_read", None) if status == "NOT_FOUND" else _heading(want_heading, best, texts, [_norm(t) for t in texts], boxes, gray, cc)
    return (label, name, status, reason, best["dist"], agree, cover, read, len(members), min(conf[m] for m in members), *region, *heading, [idx[m] for m in members])


def verify_references(detections: DataFrame, references: DataFrame, options: Options = DEFAULT, images: DataFrame | None = None) -> DataFrame:
    """Verdicts of each label and passage.

    ``references``: ref_idx, text and emphasis (start, stop; null for none). Passages are sent to every task in blocks of at most
    ``PASSAGES`` of them and ``PASSAGE_BYTES``; a label's detections are one row, and many labels are searched together.
    ``images`` (label, width, height, rgb binary, one row a label) gives the pixels by which a
    heading's strokes are held against the body's; without them its weight can't be measured.
    """
    cc = options.half_cost
    spark = detections.sparkSession
    bounded_batches(spark)
    kind = detections.schema["label"].dataType
    schema = REFERENCE_SCHEMA.format(label="string")  # pandas would make numbers beside a null inexact
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number, since a few bytes of labels are many alignments
    fields = ["det_idx", "x0", "y0", "x1", "y1", "text", "confidence"]
    # A struct of the label is never null, so a null label is a label as any other.
    keyed = kept(detections, options).select(F.struct("label").alias("key"), F.struct(*fields).alias("d"))
    by_label = keyed.repartition(parts, "key").groupBy("key").agg(F.sort_array(F.collect_list("d")).alias("d"))
    if images is not None:
        pixels = images.select(F.struct("label").alias("key"), F.struct("width", "height", "rgb").alias("image")).repartition(parts, "key")
        by_label = by_label.join(shuffled(pixels.groupBy("key").agg(F.first("image").alias("image"))), "key", "left")
    rows_of = by_label.select(F.col("key.label").cast("string").alias("label"), *[F.col(f"d.{c}").alias(c) for c in fields], *([F.col(f"image.{c}").alias(c) for c in ("width", "height", "rgb")] if images is not None else []))

    def gray_of(r: tuple) -> np.ndarray | None:
        rgb = getattr(r, "rgb", None)
        return None if rgb is None else luma(np.frombuffer(rgb, np.uint8).reshape(int(r.height), int(r.width), 3))

    def of(block: list[tuple]) -> DataFrame:
        def judged(labels: list[tuple]) -> Iterator[pd.DataFrame]:
            read = [(r.text.tolist(), list(zip(r.x0.tolist(), r.y0.tolist(), r.x1.tolist(), r.y1.tolist(), strict=True))) for r in labels]
            for first in range(0, len(block), PASSAGES_AT_ONCE):
                some, rows = block[first : first + PASSAGES_AT_ONCE], []
                for r, (texts, boxes), of_label in zip(labels, read, find_on_labels([t for _, t, _ in some], read, cc), strict=True):
                    gray = gray_of(r)
                    for (k, text, span), best in zip(some, of_label, strict=True):
                        rows.append(_judge(r.label, "reference" if k == 0 else f"reference_{k + 1}", text, span, best, texts, boxes, r.confidence.tolist(), r.det_idx.tolist(), gray, cc))
                out = pd.DataFrame(rows, columns=[f.split()[0] for f in REFERENCE_SCHEMA.split(", ")], dtype=object)
                yield out.astype({c: "Int32" for c in ("parts", "x0", "y0", "x1", "y1")} | {c: "float64" for c in ("distance", "agreement", "coverage", "confidence", "heading_ratio")})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in batches:
                labels, size = [], 0
                for r in g.itertuples(index=False):
                    labels.append(r)
                    size += len(r.text) * min(len(block), PASSAGES_AT_ONCE)
                    if size >= STARTS_AT_ONCE:
                        yield from judged(labels)
                        labels, size = [], 0
                if labels:
                    yield from judged(labels)

        return rows_of.mapInPandas(run, schema).withColumn("label", F.col("label").cast(kind))

    out = spark.createDataFrame([], REFERENCE_SCHEMA.format(label=kind.simpleString()))
    block, size = [], 0
    for k, r in enumerate(references.select("ref_idx", "text", "emphasis").orderBy("ref_idx").toLocalIterator()):
        if block and (len(block) >= PASSAGES or size + len(r.text or "") > PASSAGE_BYTES):
            out = out.unionByName(of(block))
            block, size = [], 0
        block.append((k, r.text or "", tuple(r.emphasis) if r.emphasis else None))
        size += len(r.text or "")
    return out.unionByName(of(block)) if block else out


BOUNDARY = "AEO"  # characters after which a passage may be cut
ANCHOR_PIECES = 3


def anchors(norm: Column) -> Column:
    """All stretches of ``ANCHOR_PIECES`` pieces in a row of a normalized text that is cut after each ``BOUNDARY``, but for the first and the last piece.

    Where a text holds another, it holds the other's stretches: what a cut depends on stands next to it. The text is cut
    once, not once for each stretch.
    """

    def stretches(pieces: Column) -> Column:
        last = F.size(pieces) - 1  # the first and last piece of a passage may go on in the text that holds it
        joined = lambda k: F.concat(*[F.get(pieces, k + i) for i in range(ANCHOR_PIECES)])
        return F.when(last > ANCHOR_PIECES, F.transform(F.sequence(F.lit(1), last - ANCHOR_PIECES), joined)).otherwise(F.array().cast("array<string>"))

    return T.let(F.split(norm, f"(?<=[{BOUNDARY}])"), stretches)


def held_exactly(docs: DataFrame, references: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, ref_idx): documents that hold a passage, word for word after normalization; each pair once.

    A passage's longest anchor is joined to the documents' anchors, both by their hashes and without the texts, and the
    passages so met are looked for in the document. Passages too short for an anchor are looked for in every document,
    ``SHORT_AT_ONCE`` in one pass.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, since a few files may hold many texts
    left = staged(docs.select(F.col(id_col), F.col(text_col).alias("norm")).repartition(parts).select(id_col, T.normalize("norm").alias("norm"), F.monotonically_increasing_id().alias("row")))
    right = staged(references.select("ref_idx", T.normalize("text").alias("want")).filter("want <> ''"))
    longest = F.array_max(F.transform(anchors(F.col("want")), lambda a: F.struct(F.length(a).alias("n"), a.alias("a"))))["a"]
    keyed = staged(right.withColumn("anchor", longest))
    held = left.select("row", F.explode(F.array_distinct(F.transform(anchors(F.col("norm")), lambda a: F.xxhash64(a)))).alias("anchor"))
    long = keyed.filter("anchor is not null").select("ref_idx", "want", F.xxhash64("anchor").alias("anchor"))
    met = staged(held.join(long.drop("want"), "anchor").select("row", "ref_idx").distinct())
    found = left.join(met.join(long.drop("anchor"), "ref_idx"), "row").filter(F.contains("norm", F.col("want"))).select(id_col, "ref_idx")
    short = keyed.filter("anchor is null").select("ref_idx", "want")
    block: list[tuple] = []

    def look(block: list[tuple]) -> DataFrame:
        hits = F.array(*[F.when(F.contains("norm", F.lit(want)), F.lit(k)) for k, want in block])
        return left.select(id_col, F.explode(F.array_compact(hits)).alias("ref_idx"))

    for r in short.toLocalIterator():
        block.append((r.ref_idx, r.want))
        if len(block) == SHORT_AT_ONCE:
            found, block = found.unionByName(look(block)), []
    return (found.unionByName(look(block)) if block else found).distinct()


def heading_status(read: Column, ratio: Column | None = None) -> Column:
    """``judge_heading`` as an expression."""
    weight = F.lit(None).cast("double") if ratio is None else ratio
    return F.when(~T.is_upper(read), "MISMATCH").when(weight >= EMPHASIS_CONTRAST, "VERIFIED").otherwise("REVIEW")


def heading_reason(read: Column, ratio: Column | None = None) -> Column:
    weight = F.lit(None).cast("double") if ratio is None else ratio
    return F.when(~T.is_upper(read), "header_not_capitals").when(weight.isNull(), "weight_not_measurable").when(weight >= EMPHASIS_CONTRAST, "").otherwise("header_weight_uncertain")


def split_heading(members: DataFrame, heading_length: Column) -> DataFrame:
    """Boxes of a chain into heading and body by their share of the normalized text.

    ``members``: label, k (order), norm, x0, y0, x1, y1. The box that the heading ends in is cut in
    proportion; each row may give a heading part, a body part or both.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("label").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("norm")).over(w), F.lit(0))
    n = F.length("norm")
    share = F.when(before >= heading_length, F.lit(0.0)).when(before + n <= heading_length + 2, F.lit(1.0)).otherwise((heading_length - before) / n)
    cut = F.col("x0") + F.floor((F.col("x1") - F.col("x0")) * F.col("share")).cast("int")
    out = members.withColumn("share", share).withColumn("cut", cut)
    part = lambda name, lo, hi, c: F.when(c, F.struct(F.lit(name).alias("part"), lo.alias("x0"), F.col("y0"), hi.alias("x1"), F.col("y1")))
    parts = F.array(part("heading", F.col("x0"), F.col("cut"), F.col("share") > 0), part("body", F.col("cut"), F.col("x1"), F.col("share") < 1))
    return out.select("label", "k", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("label", "k", "p.*")


def stroke_width(gray: np.ndarray, boxes: list[tuple]) -> float | None:
    """Mean stroke width of the ink in the boxes over their mean height; nothing where there is no ink.

    Ink is the rarer side of the mean grey, rounded down. Twice the area over the number of ink
    pixels at its edge is the width of a long stroke. Boxes of under four pixels a side count as blank.
    """
    area = edge = heights = 0
    for x0, y0, x1, y1 in boxes:
        crop = gray[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)].astype(np.int64)
        if min(crop.shape) < 4:
            continue
        dark = crop < crop.sum() // crop.size
        ink = dark if dark.sum() * 2 <= dark.size else ~dark
        pad = np.pad(ink, 1)
        within = pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:]
        area += int(ink.sum())
        edge += int((ink & ~within).sum())
        heights += crop.shape[0]
    return 2 * area / edge / (heights / len(boxes)) if edge and heights else None


def luma(rgb: np.ndarray) -> np.ndarray:
    """Grey of red, green and blue with integer weights."""
    # The weights of the three colours, in thousandths.
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return (299 * r + 587 * g + 114 * b) // 1000


def stroke_widths(images: DataFrame) -> DataFrame:
    """(label, part, width) from images (label, width, height, rgb binary) with boxes array<struct<part,x0,y0,x1,y1>>."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for r in g.itertuples():
                gray = luma(np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3))
                for part in sorted({b["part"] for b in r.boxes}):
                    rows.append((r.label, part, stroke_width(gray, [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in r.boxes if b["part"] == part])))
            yield pd.DataFrame(rows, columns=["label", "part", "width"])

    return images.select("label", "width", "height", "rgb", "boxes").mapInPandas(run, "label string, part string, width double")
