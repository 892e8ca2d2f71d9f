"""The passages query against brute force, and the bound that skips alignments."""

import random
import time

import duckdb

from veriframe.functions import align
from veriframe.operators import reference
from veriframe.queries import QUERIES


def items_of(small):
    return duckdb.sql(f"select item_id, text from '{small}/benchmark.parquet' order by 1").fetchall()


def boxes(lines):
    return [(10, 13 * i, 10 + 8 * len(t), 13 * i + 12) for i, t in enumerate(lines)]


def test_every_item_is_judged_on_every_label(spark, small):
    items = items_of(small)
    rows = QUERIES["reference_passages"](spark, small).collect()
    got = {(r.label, r.reference): r.status for r in rows}
    names = ["reference" if k == 0 else f"reference_{k + 1}" for k in range(len(items))]
    assert len(rows) == len(got) == len(items) ** 2 and set(got) == {(i, n) for i, _ in items for n in names}
    norm = {i: reference._norm(" ".join(t.split("\n"))) for i, t in items}
    held = {(i, n) for i, _ in items for n, (k, _) in zip(names, items, strict=True) if norm[k] in norm[i]}
    assert held == {k for k, v in got.items() if v == "VERIFIED"}


def plain_passage(passage, texts, boxes, cc=1):
    """The rule one alignment at a time."""
    want, norms = reference._norm(passage), [reference._norm(t) for t in texts]
    order, best = reference.order_of_reading(boxes), None
    for seed in order:
        if not norms[seed] or align.infix_distance(norms[seed], want, cc) > 0.5:
            continue
        members, text = [seed], texts[seed]
        while len(members) < 14 and len(reference._norm(text)) < len(want):
            options = [(align.prefix_distance(reference._norm(f"{text} {texts[j]}"), want, cc), k, j) for k, j in enumerate(order) if j not in members and reference.beside_or_under(boxes[members[-1]], boxes[j])]
            if not options or min(options)[0] >= 2.0:
                break
            j = min(options)[2]
            members.append(j)
            text = f"{text} {texts[j]}"
        cost, start, stop = align.infix(want, reference._norm(text), cc)
        if best is None or cost < best[0]:
            best = (cost, members, text, start, stop, *align.agreement(reference._norm(text)[start:stop] or reference._norm(text), want))
    return best


def test_passages_at_once_are_the_plain_ones(small):
    items = [t for _, t in items_of(small)][:6]
    words = [" ".join(w) for t in items[:3] for w in [t.split()[:9]]]
    damaged = [t.replace("o", "0").replace("e", "", 3) for t in items[:2]]
    for source in (*items[:3], *damaged):
        lines = [" ".join(source.split()[k : k + 4]) for k in range(0, 28, 4)]
        place = [(10 + 3 * (i % 2), 13 * (i // 2), 100 + 8 * len(t), 13 * (i // 2) + 12) for i, t in enumerate(lines)]
        got = reference.find_passages([*items, *words, ""], lines, place, 1)
        for passage, best in zip([*items, *words, ""], got, strict=True):
            want = plain_passage(passage, lines, place) if passage else None
            assert (None if best is None else (best["cost"], best["members"], best["text"], best["start"], best["stop"], best["agreement"], best["coverage"])) == want
    assert reference.find_passages(items, [], [], 1) == [None] * 6


def test_passages_held_by_documents(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdeo.,-1") for _ in range(rng.randint(1, 7))) for _ in range(n))
    docs = [(i, text(60)) for i in range(30)]
    refs = []
    for i in range(40):
        t = docs[rng.randrange(30)][1]
        at = rng.randrange(len(t) - 5)
        refs.append((i, t[at : at + rng.choice((1, 3, 8, 20, 60, 150))].upper()))
    refs += [(40, "zzz"), (41, ""), (42, None), (43, docs[3][1])]
    docs += [(30, None), (31, ""), (3, docs[3][1])]
    norm = lambda t: reference._norm(t or "")
    want = {(d, k) for d, t in docs for k, r in refs if norm(r) and norm(r) in norm(t)}
    found = reference.held_exactly(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(refs, "ref_idx long, text string"))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_long_documents_hold_passages(spark):
    # Before, each stretch of a document cut the whole document again and carried it along, so time grew with the square of its length.
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(2, 9))) for _ in range(60_000))
    refs = [(0, long[1000:1300]), (1, long[-400:-100].upper()), (2, long[5000:5200] + "zq" + long[5200:5400]), (3, long[70_000:90_000])]
    began = time.time()
    found = reference.held_exactly(spark.createDataFrame([(1, long), (2, long[:5000])], "doc_id long, text string"), spark.createDataFrame(refs, "ref_idx long, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, 0), (1, 1), (1, 3), (2, 0)]
    assert time.time() - began < 60


def test_many_passages_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(reference, "PASSAGES", 3)
    det = spark.createDataFrame([("a", 0, 0, 0, 80, 12, "KEEP IN A DRY PLACE", 0.9)], "label string, det_idx int, x0 int, y0 int, x1 int, y1 int, text string, confidence double")
    refs = spark.createDataFrame([(k, "Keep in a dry place" if k == 7 else f"Other words {k} of no label", None) for k in range(10)], "ref_idx int, text string, emphasis array<int>")
    got = {r.reference: r.status for r in reference.verify_references(det, refs).collect()}
    assert len(got) == 10 and got["reference_8"] == "VERIFIED" and sum(v == "VERIFIED" for v in got.values()) == 1
    assert reference.verify_references(det, refs.limit(0)).count() == 0


def test_many_labels_at_once(spark):
    # Before, each label was a call of its own on tiny arrays, some 40 ms of it.
    word = lambda k: "".join(chr(97 + int(x)) for x in str(k))
    rows = []
    for k in range(8000):
        for i, t in enumerate(("KEEP COLD.", f"Keep {word(k)} in a dry place", "out of the sun.")):
            rows.append((None if k == 5 else (1 << 60) + k, i, 10, 13 * i, 10 + 8 * len(t), 13 * i + 12, t, 0.9))
    det = spark.createDataFrame(rows, "label long, det_idx int, x0 int, y0 int, x1 int, y1 int, text string, confidence double").repartition(4)
    refs = spark.createDataFrame([(0, f"KEEP COLD. Keep {word(77)} in a dry place out of the sun.", [0, 10])], "ref_idx int, text string, emphasis array<int>")
    images = spark.createDataFrame([(None, 1, 1, bytes(3)), ((1 << 60) + 77, 1, 1, bytes(3))], "label long, width int, height int, rgb binary")
    began = time.time()
    got = reference.verify_references(det, refs, images=images).collect()
    seconds = time.time() - began
    assert sorted(r.label for r in got if r.label is not None) == [(1 << 60) + k for k in range(8000) if k != 5] and len(got) == 8000
    assert [r.label for r in got if r.status == "VERIFIED"] == [(1 << 60) + 77]
    assert all(r.members == [0, 1, 2] and r.heading == "KEEP COLD." for r in got)
    assert seconds < 45
