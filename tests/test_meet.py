"""Spellings and readings meet within buckets: the best pairs are those of all pairs, and neither pieces nor shared lists are written for each label."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veriframe.operators import claims as C
from veriframe.operators import decide, geometry

BOX = "label string, det_idx int, x0 int, y0 int, x1 int, y1 int, text string, confidence double"


def records_shuffled(spark, work):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def stages():
        every = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (every.apply(i) for i in range(every.size()))}

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = set(stages())
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def printed(spark, labels, lines):
    rows = [(str(k), 100 * i + j, 10 + 60 * j, 30 * i, 60 + 60 * j, 30 * i + 12, w, 0.9) for k in range(labels) for i, t in enumerate(lines) for j, w in enumerate(t.split())]
    return spark.createDataFrame(rows, BOX)


LINES = ["OLD TOM", "red wine of the valley", "Cellared and Bottled by Tom Cellars", "Lot 7, Harbour Road, Veneta, OR 97487", "ALC. 13.5% BY VOL.", "some other words that nobody filed", "750 ML"]


def filed_claims(spark, labels):
    row = lambda k: (str(k), "wine", "Old Tom", "Red Wine", ["Tom Cellars", "Lot 7, Harbour Road, Veneta, OR 97487"], "", 13.5, 750.0, None)
    return C.claims(spark.createDataFrame([row(k) for k in range(labels)], C.APPLICATION))


@pytest.mark.parametrize(("lines", "most"), [(LINES, 600), (["OLD TOM", "13.5% ALC/VOL"], 150)])
def test_what_is_shuffled_for_a_label_is_bounded(spark, lines, most):
    """Before, each stretch of each reading and each spelling of each claim was written: thousands of rows a label."""
    count = {}
    for labels in (10, 40):
        det, filed = printed(spark, labels, lines), filed_claims(spark, labels)
        count[labels] = records_shuffled(spark, lambda det=det, filed=filed: decide.verify(det, filed, *_given(filed)).collect())
    assert (count[40] - count[10]) / 30 < most


def _given(filed):
    import inspect

    return () if inspect.signature(decide.verify).parameters["candidates"].default is None else (C.candidates(filed),)


def test_shared_lists_give_the_verdicts_of_single_spellings(spark):
    rows = [
        ("a", "wine", "Old Tom", "Red Wine", ["Tom Cellars", "Lot 7, Harbour Road, Veneta, OR 97487"], "Oregon", 13.5, 750.0, None),
        ("b", "beer", "0ld T0m", "", ["Tom Cellars"], "", 4.33, 355.0, {"producer_1": ["Old Cellars", "Tom Cellar's"]}),
        ("c", "", "Brand#7", "Whiskey", ["Tom Cellars", "Lot 7, Harbour Road, Veneta, OR 97487"], "", 13.5, 375.0, {"brand": ["A"]}),
        ("d", "spirits", "Old Tom", "Red Wine", [], "", 40.0, 1750.0, None),
    ]
    filed = C.claims(spark.createDataFrame(rows, C.APPLICATION))
    det = printed(spark, 1, LINES).drop("label").crossJoin(spark.createDataFrame([("a",), ("b",), ("c",)], "label string")).unionByName(spark.createDataFrame([("d", 0, 0, 0, 80, 12, "45% Alc./Vol. (90 Proof) 175 mL", 0.9)], BOX))
    show = lambda v: sorted(map(str, v.collect()))
    want = show(decide.verify(det, filed, C.candidates(filed)))
    assert show(decide.verify(det, filed)) == want and len(want) == filed.count()
    wide = filed.withColumn("radius", F.when(F.col("claim") == "brand", 0.3).otherwise(0.0))
    assert show(decide.verify(det, wide)) == show(decide.verify(det, wide, C.candidates(wide)))


def test_many_boxes_in_one_row(spark):
    """Chains of a label with several rows of readings, walked in the order of their boxes."""
    lines = [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(12)] + ["OLD TOM"]
    ordered = geometry.reading_order(printed(spark, 1, lines))
    paths = [r.path for r in geometry.chains(ordered, geometry.successors(ordered)).collect()]
    edges = {(r.a, r.b) for r in geometry.successors(ordered).collect()}
    want = [[k] for k in range(110)]
    for k in range(3):
        want += [[*p, b] for p in want if len(p) == k + 1 for a, b in edges if a == p[-1]]
    assert sorted(paths) == sorted(want)
    filed = filed_claims(spark, 1).filter("claim = 'brand'")
    got = decide.verify(printed(spark, 1, lines), filed).collect()
    assert [(r.status, r.evidence.read) for r in got] == [("VERIFIED", "OLD TOM")]


@pytest.mark.parametrize("seed", range(4))
def test_the_best_pairs_are_those_of_all_pairs(seed, monkeypatch):
    from veriframe.operators import meet

    for name in ("READINGS", "PAIRS", "STEPS"):
        monkeypatch.setattr(meet, name, 16)
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(rng.choice("AB0O1IL7") for _ in range(rng.randint(lo, hi)))
    spellings = [{"set": f"s{s}", "cand_idx": i, "text": t, "norm": t, "name": t, "value": 0.0 if s < 4 else float(i % 3), "claimed": s < 4, "form": -1 if s < 3 else i % 2, "num": "" if s < 3 else "7"} for s in range(6) for i, t in enumerate(dict.fromkeys(word(1, 14) for _ in range(6)))]
    links, readings = [], []
    for label in range(12):
        for c in range(2):
            radius = rng.choice([0.14, 0.14, 0.5])
            at = {"label": label, "claim": f"c{c}", "radius": radius, "reach": max(radius + 0.15, 2 * radius)}
            links.append({**at, "set": f"s{rng.randrange(4)}", "want": None, "tolerance": None, "num": None})
            links += [{**at, "set": f"s{4 + k}", "want": 1.0, "tolerance": 0.5, "num": "7"} for k in range(2)]
        texts = [word(1, 16) for _ in range(4)] + [rng.choice(spellings)["text"] + word(0, 2)]
        readings += [{"label": label, "path": [i], "box": i, "text": t, "norm": t, "confidence": 0.9, "parts": 1 + i % 2, "widest": len(t), "nums": ["7"] if "7" in t else []} for i, t in enumerate(texts)]
    want = {}
    listed = {}
    for s in spellings:
        listed.setdefault(s["set"], []).append(s)
    for k in links:
        for s in listed[k["set"]]:
            if k["want"] is not None and abs(s["value"] - k["want"]) <= k["tolerance"]:
                continue
            for r in (r for r in readings if r["label"] == k["label"]):
                n = len(s["norm"])
                budget = int(np.floor(k["reach"] * 2 * n + 1e-9))
                cost, start, stop = (int(x[0]) for x in decide.match([s["norm"]], np.array([s["form"]]), [r["text"]], [r["norm"]], np.array([r["parts"]]), np.array([r["widest"]]), np.array([budget]), 1))
                dist, holds = cost / (2.0 * n), s["num"] == "" or s["num"] in r["nums"]
                if dist > k["reach"]:
                    continue
                roles = (s["claimed"] and holds and dist <= k["radius"], s["claimed"] and dist <= k["radius"] + 0.15, s["claimed"] and holds and dist <= 2 * k["radius"], not s["claimed"] and holds and dist <= k["radius"])
                row = (dist, -n, stop - start, s["cand_idx"], r["path"], s["text"], start, stop)
                for role, on in zip(meet.ROLES, roles, strict=True):
                    key = (k["label"], k["claim"], role)
                    if on and row < want.get(key, (9.0,)):
                        want[key] = row
    pack = lambda rows, key, name: [{key: v, name: [{c: x for c, x in r.items() if c != key} for r in rows if r[key] == v]} for v in sorted({r[key] for r in rows})]
    parts = [(meet.SPELLING, pack(spellings, "set", "spellings")), (meet.LINK, pack(links, "label", "links")), (meet.READING, pack(readings, "label", "readings"))]
    every = [{"bucket": 0, "kind": kind, **r} for kind, rows in parts for r in rows]
    fields = {c: pa.table({c: [r[c] for r in every if c in r]}).schema.field(c).type for c in ("set", "spellings", "label", "links", "readings")}
    table = pa.table({"bucket": pa.array([0] * len(every), pa.int32()), "kind": pa.array([r["kind"] for r in every], pa.int32()), **{c: pa.array([r.get(c) for r in every], t) for c, t in fields.items()}})
    names = ["label", "claim", "cand_idx", "ctext", "len", "path", "dist", "start", "stop", *meet.ROLES]
    run = meet.meeting(lambda *p: decide.match(*p, 1), 0.15, names)
    got = {}
    for b in run(iter(table.to_batches(max_chunksize=5))):
        for r in b.to_pylist():
            row = (r["dist"], -r["len"], r["stop"] - r["start"], r["cand_idx"], r["path"], r["ctext"], r["start"], r["stop"])
            for role in meet.ROLES:
                if r[role]:
                    key = (r["label"], r["claim"], role)
                    got[key] = min(row, got.get(key, row))
    assert got == want and len(want) > 20
