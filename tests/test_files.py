"""Sources, sinks, streams, guards, recognition and pixels."""

import json
import random
import struct
import time
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe import sinks
from veriframe.operators import claims as C
from veriframe.operators import decide, evaluate, geometry, guards, ocrpost, reference
from veriframe.sources import files
from veriframe.streaming import online

BOXES = "label string, det_idx int, x0 int, y0 int, x1 int, y1 int, text string, confidence double"


def test_json_scans_and_slices(spark, tmp_path):
    for k in range(1, 5):
        (tmp_path / f"{k:04}.json").write_text(json.dumps({"beverage": "wine", "brand": f"B{k}", "producer": ["P"], "abv": 12.5, "aliases": {"brand": ["X"]}}))
        (tmp_path / f"{k:04}.truth.json").write_text(json.dumps({"printed": {"brand": f"B{k}", "abv": 12.5, "carried": {"brand": "="}}}))
    apps, truth = files.applications(spark, str(tmp_path)), files.truth(spark, str(tmp_path))
    assert sorted((r.label, r.brand, r.aliases) for r in apps.collect()) == [(f"{k:04}", f"B{k}", {"brand": ["X"]}) for k in range(1, 5)]
    assert apps.join(truth, "label").filter(F.col("printed.carried")["brand"] == "=").count() == 4
    assert [r.label for r in files.sliced(apps, "A").collect()] == ["0002", "0004"] or sorted(r.label for r in files.sliced(apps, "A").collect()) == ["0002", "0004"]
    assert [r.label for r in files.sliced(apps, "B", 1).collect()] == ["0001"]


def test_claims_csv(spark, tmp_path):
    f = tmp_path / "claims.csv"
    f.write_text(" Brand ,IMAGE,abv,producer,address\nTom,a.png,12,P,Road 1\n,,,,\nJim,B.png,many,,Lost\nRag,c.png\n")
    rows = files.claims_csv(spark, str(f)).orderBy("row").collect()
    assert [(r.row, r.image, r.brand, r.abv, r.producer) for r in rows] == [(1, "a.png", "Tom", 12.0, ["P", "Road 1"]), (3, "B.png", "Jim", 0.0, []), (4, "c.png", "Rag", 0.0, [])]
    with pytest.raises(files.TooManyRows):
        files.claims_csv(spark, str(f), max_rows=3)
    (tmp_path / "head.csv").write_text("image,brand\n")
    (tmp_path / "odd.csv").write_text("brand\nx\n")
    for name in ("head.csv", "odd.csv"):
        with pytest.raises(ValueError):
            files.claims_csv(spark, str(tmp_path / name))


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/A.PNG", b"1")
        z.writestr("y/a.png", b"22")
        z.writestr("y/b.png", b"333")
    e = {r.key: r.size for r in files.zip_entries(spark, str(tmp_path / "a.zip")).collect()}
    assert e == {"a.png": 2, "b.png": 3}
    rows = spark.createDataFrame([(1, "A.png"), (2, "none.png")], "row int, image string")
    got = {r.row: r.error for r in files.join_images(rows, files.zip_entries(spark, str(tmp_path / "a.zip"))).collect()}
    assert got == {1: None, 2: "no image none.png"}
    with pytest.raises(Exception, match="declares over"):
        files.zip_entries(spark, str(tmp_path / "a.zip"), max_bytes=5).collect()


def test_png_header_dictionary_manifest(spark, tmp_path):
    ihdr = struct.pack(">IIBBBBB", 300, 200, 8, 2, 0, 0, 0)
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + ihdr + struct.pack(">I", zlib.crc32(b"IHDR" + ihdr)))
    (tmp_path / "q.png").write_bytes(b"text")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.error) for r in files.png_sizes(spark, str(tmp_path / "*.png"), max_pixels=50_000).collect()}
    assert got == {"p.png": (300, 200, "too many pixels"), "q.png": (None, None, "not an image")}
    (tmp_path / "keys.txt").write_text("a\nb\n")
    assert files.charset(spark, str(tmp_path / "keys.txt")) == ["", "a", "b", " "]
    (tmp_path / "manifest.json").write_text(json.dumps({"families": ["F", "G"]}))
    m = files.manifest(spark, str(tmp_path / "manifest.json"))
    known = spark.createDataFrame([("F",)], "family string")
    assert [r.family for r in evaluate.leaked(m, known).collect()] == ["G"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.manifest(spark, str(tmp_path / "nothing.json")).collect()


def small_case(spark):
    a = spark.createDataFrame([("a.png", "wine", "Old Tom", "", [], "", 0.0, 750.0, None), ("b.png", "wine", "Jim", "", [], "", 0.0, 0.0, None)], C.APPLICATION)
    det = spark.createDataFrame([("a.png", 0, 0, 0, 60, 12, "OLD TOM", 0.9), ("a.png", 1, 0, 40, 60, 52, "750 ML", 0.9), ("b.png", 0, 0, 0, 60, 12, "Other", 0.9)], BOXES)
    filed = C.claims(a)
    return det, filed, C.candidates(filed)


def test_sinks(spark, tmp_path):
    det, filed, cands = small_case(spark)
    v = decide.verify(det, filed, cands)
    lines = {json.loads(r.result)["label"]: json.loads(r.result) for r in sinks.results(v).collect()}
    brand = next(c for c in lines["a.png"]["claims"] if c["claim"] == "brand")
    assert brand["status"] == "VERIFIED" and brand["evidence"]["distance"] == 0.0 and "competitor" not in brand["evidence"]
    assert "evidence" not in lines["b.png"]["claims"][0]
    sinks.write_ndjson(v, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    rows = spark.createDataFrame([("a.png", 1, None), ("z.png", 2, "no image z.png")], "image string, row int, error string")
    items = {r.row: json.loads(r.value) for r in sinks.batch_items(rows, v).collect()}
    assert items[2] == {"image": "z.png", "row": 2, "error": "no image z.png"} and "result" in items[1]
    sinks.write_records(v, str(tmp_path / "records"))
    assert spark.read.json(str(tmp_path / "records")).count() == 3
    t = evaluate.with_rates(evaluate.tally(v.withColumn("want", F.lit("correct")), "claim"))
    assert sinks.markdown(t).startswith("| claim | n | tp |")
    sinks.write_diagnostic(v.select("label", "claim"), str(tmp_path / "diag"), {"diagnostic": "reach", "fingerprint": "abc", "ran": 5.0})
    assert files.diagnostic(spark, str(tmp_path / "diag"), "abc").count() == 3
    for f, t in (("abd", 0.0), ("abc", 6.0)):
        with pytest.raises(ValueError):
            files.diagnostic(spark, str(tmp_path / "diag"), f, t)


def test_streams(spark, tmp_path):
    det, filed, cands = small_case(spark)
    det.write.parquet(str(tmp_path / "in"))
    q = online.verify_stream(spark.readStream.schema(det.schema).parquet(str(tmp_path / "in")), filed, cands, str(tmp_path / "lines"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_stream_of_requests_is_throttled_as_the_batch_is(spark, tmp_path):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    rows = [("u", t + timedelta(seconds=s), i, 1.0) for i, s in enumerate([0, 0, 0, 1, 1, 5, 5, 5, 5])] + [("w", t, 100, 1.0)]
    log = spark.createDataFrame(rows, "key string, ts timestamp, request long, cost double")
    want = {(r.key, r.request): r.admitted for r in guards.token_bucket(log, 1.0, 2.0).collect()}
    assert [want["u", i] for i in range(9)] == [True, True, False, True, False, True, True, False, False] and want["w", 100]
    assert all(r.admitted for r in guards.token_bucket(log, 0.0, 2.0).collect())
    log.write.parquet(str(tmp_path / "log"))
    stream = online.throttle(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), 1.0, 2.0)
    q = stream.writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.request): r.admitted for r in spark.table("admitted").collect()} == want
    budget = {r.request: r.admitted for r in guards.daily_budget(log, 3.0).collect()}
    assert sum(budget.values()) == 3


def test_boxes_from_maps():
    p = np.zeros((20, 30))
    p[2:6, 3:12] = 0.9
    p[10:12, 3:20] = 0.9  # two pixels high
    p[14:18, 20:26] = 0.4  # too faint
    assert ocrpost.regions(p) == [(3, 2, 11, 5)]
    d = 9 * 4 * 1.6 / 26
    assert ocrpost.grown((3, 2, 11, 5), 2.0, 2.0, 60, 40) == (round((3 - d) * 2), max(0, round((2 - d) * 2)), round((12 + d) * 2), round((6 + d) * 2))
    assert ocrpost.grown((0, 0, 1, 1), 1, 1, 0, 0) is None
    assert ocrpost.network_size(3200, 1000, 1600) == (1600, 512) and ocrpost.network_size(10, 10, 1600) == (32, 32)
    assert ocrpost.network_input(np.zeros((4, 5, 3))).shape == (3, 4, 5)


BOX = "label string, det_idx int, x0 int, y0 int, x1 int, y1 int"


def test_reading_order_of_many_labels(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for label in "abcdefgh":
        boxes = []
        for _ in range(rng.randint(1, 40)):
            x, y = rng.randint(0, 60), rng.randint(0, 80)
            boxes.append((x, y, x + rng.randint(0, 20), y + rng.randint(0, 14)))
        rows += [(label, i, *b, None, i) for i, b in enumerate(boxes)]
        for pos, i in enumerate(geometry.order_of_reading(boxes)):
            want[label, i] = pos
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, BOX + ", text string, `odd name` int")
    got = geometry.reading_order(df)
    assert got.columns == [*df.columns, "pos"]
    assert {(r.label, r.det_idx): r.pos for r in got.collect()} == want
    assert geometry.reading_order(df.limit(0)).count() == 0
    assert geometry.order_of_reading([(50, 0, 90, 10), (0, 2, 40, 12), (0, 20, 40, 30)]) == [1, 0, 2]


def test_cover_depends_on_what_was_taken(spark):
    turned = spark.createDataFrame([("a", 0, 0, 0, 10, 10, "x"), ("a", 1, 1, 0, 11, 10, "y"), ("a", 2, 6, 0, 16, 10, "z"), ("a", 3, 5, 5, 5, 9, "no area"), ("a", 4, 50, 0, 60, 10, "under"), ("b", 0, 0, 0, 4, 4, "alone")], BOX + ", text string")
    upright = spark.createDataFrame([("a", 0, 50, 0, 60, 6), ("a", 1, 200, 0, 210, 5)], BOX)
    got = geometry.uncovered(turned, upright)
    assert got.columns == turned.columns
    assert sorted((r.label, r.text) for r in got.collect()) == [("a", "x"), ("a", "z"), ("b", "alone")]
    half = spark.createDataFrame([("a", 0, 50, 0, 60, 5)], BOX)
    assert {r.text for r in geometry.uncovered(turned, half).collect()} == {"x", "z", "under", "alone"}


def brute_successors(boxes):
    """Positions in a list of boxes; the first four that may follow each."""
    return {(a, b) for a in range(len(boxes)) for b in [j for j in range(len(boxes)) if j != a and reference.beside_or_under(boxes[a], boxes[j])][:4]}


def test_successors_by_grid(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for label, scale in (("small", 1), ("wide", 30), ("tall", 1)):
        boxes = []
        for i in range(60):
            x, y = rng.randint(-100, 300) * scale, rng.randint(-50, 200)
            tall = 150 if label == "tall" and i % 7 == 0 else 0
            boxes.append((x, y, x + rng.randint(0, 40) * scale, y + tall + rng.randint(0, 16)))
        rows += [(label, i, *b) for i, b in enumerate(boxes)]
        want |= {(label, *e) for e in brute_successors(boxes)}
    got = geometry.successors(spark.createDataFrame(rows, BOX).withColumnRenamed("det_idx", "pos"))
    assert {tuple(r) for r in got.collect()} == want


def test_a_label_of_many_boxes(spark):
    """10,000 boxes of one label: the pairs that meet are few, and found."""
    n = spark.range(10_000).selectExpr("'page' AS label", "CAST(id AS INT) AS pos", "CAST(id % 100 * 50 AS INT) AS x0", "CAST(id div 100 * 20 AS INT) AS y0", "CAST(id % 100 * 50 + 45 AS INT) AS x1", "CAST(id div 100 * 20 + 12 AS INT) AS y1")
    began = time.time()
    got = geometry.successors(n).groupBy("b").count().filter("b < 0").count()
    assert got == 0 and time.time() - began < 60
    edges = {(r.a, r.b) for r in geometry.successors(n).filter("a in (0, 99, 9999)").collect()}
    assert edges == {(0, 1), (0, 100), (99, 199)}


def test_strokes_and_pixels():
    thin, thick = np.full((40, 100), 255), np.full((40, 100), 255)
    thin[10:30, 10:12] = 0
    thick[10:30, 10:16] = 0
    a, b = (reference.stroke_width(g, [(0, 0, 100, 40)]) for g in (thin, thick))
    assert b / a > 2 and reference.stroke_width(np.zeros((0, 0)), []) is None
    assert reference.judge_heading("WARNING", b / a) == ("VERIFIED", "") and reference.judge_heading("WARNING", 1.0)[0] == "REVIEW" and reference.judge_heading("Warning", 2.0)[0] == "MISMATCH"


def test_heading_parts_and_weight():
    boxes = [(0, 0, 60, 10), (0, 12, 110, 22), (0, 24, 40, 34)]
    assert reference.parts_of([0, 1, 2], ["GOVERN", "WARNINGBODY", "BODY"], boxes, 13) == ([(0, 0, 60, 10), (0, 12, 70, 22)], [(70, 12, 110, 22), (0, 24, 40, 34)])
    assert reference.parts_of([0, 1], ["GOVERNMENTWARNING", "BODY"], boxes, 16) == ([boxes[0]], [boxes[1]])
    assert reference.parts_of([0, 1], ["A" * 100, "BODY"], boxes, 97) is None  # two pixels would be left
    gray = np.full((40, 120), 200)
    gray[2:7, 4:56] = 0
    gray[14:16, 4:100] = gray[26:28, 4:36] = 0
    ratio = reference.contrast(gray, ([boxes[0]], boxes[1:]))
    assert ratio == pytest.approx((2 * 52 * 5 / (2 * 52 + 2 * 3)) / (2 * (96 * 2 + 32 * 2) / (96 * 2 + 32 * 2)))
    assert reference.contrast(None, ([], [])) is None and reference.contrast(gray, None) is None and reference.contrast(gray, ([boxes[0]], [(0, 36, 10, 39)])) is None
    # The mean is rounded down, so a crop of one grey and one pixel less has no ink below it.
    flat = np.full((6, 6), 101)
    flat[0, 0] = 100
    assert reference.stroke_width(flat, [(0, 0, 6, 6)]) is None


def test_heading_split(spark):
    rows = [("a", 0, "GOVERN", 0, 0, 60, 10), ("a", 1, "WARNINGBODY", 0, 12, 110, 22), ("a", 2, "BODY", 0, 24, 40, 34)]
    parts = reference.split_heading(spark.createDataFrame(rows, "label string, k int, norm string, x0 int, y0 int, x1 int, y1 int"), F.lit(13)).collect()
    assert sorted((r.k, r.part, r.x0, r.x1) for r in parts) == [(0, "heading", 0, 60), (1, "body", 70, 110), (1, "heading", 0, 70), (2, "body", 0, 40)]


def test_time_to_verify_is_bounded(spark):
    det, filed, cands = small_case(spark)
    t = time.time()
    decide.verify(det, filed, cands).collect()
    assert time.time() - t < 120
