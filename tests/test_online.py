"""Archives as a data source, the budget and the rows of a stream."""

import io
import json
import random
import struct
import zipfile
import zlib
from datetime import UTC, datetime, timedelta

import pytest

from pyspark.sql import functions as F

from veriframe.operators import guards
from veriframe.sources import archives, files
from veriframe.streaming import online


def test_an_archive_in_runs(spark, tmp_path):
    rng = random.Random(1)
    path, want = tmp_path / "big.zip", {}
    with zipfile.ZipFile(path, "w") as z:
        z.mkdir("folder")
        for k in range(60):
            data = rng.randbytes(20_000) if k % 2 else b"x" * 50_000
            z.writestr(zipfile.ZipInfo(f"folder/F{k:02}.bin"), data, zipfile.ZIP_DEFLATED if k % 3 else zipfile.ZIP_STORED)
            want[f"f{k:02}.bin"] = data
        z.writestr("other/f07.BIN", b"later")
    want["f07.bin"] = b"later"
    df = archives.zip_archive(spark, str(path), partition_bytes=100_000)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    rows = df.collect()
    assert len(rows) == 61 and sum(r.latest for r in rows) == 60 and not any(r.error for r in rows)
    assert {r.key: bytes(r.content) for r in rows if r.latest} == want
    assert [r.ordinal for r in sorted(rows, key=lambda r: r.ordinal)] == list(range(61))
    assert all(r.content is None for r in archives.zip_archive(spark, f"file://{path}", content=False).collect())
    assert max(len(r.entries) for r in archives.ZipReader({"path": str(path), "partitionBytes": "100000"}).partitions()) < 20


def test_damaged_and_refused_archives(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "some text " * 50)
        z.writestr("b.txt", "other text " * 50)
        z.writestr("c.txt", "lzma", zipfile.ZIP_LZMA)
    data = bytearray(raw.getvalue())
    at = zipfile.ZipFile(io.BytesIO(bytes(data))).getinfo("b.txt").header_offset + 40
    data[at] ^= 0xFF
    (tmp_path / "d.zip").write_bytes(data)
    got = {r.entry: (r.content is not None, r.error) for r in archives.zip_archive(spark, str(tmp_path / "d.zip")).collect()}
    assert got == {"a.txt": (True, None), "b.txt": (False, "damaged"), "c.txt": (False, "compression method 14")}
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.mkdir("only")
    with pytest.raises(Exception, match="no files"):
        archives.zip_archive(spark, str(tmp_path / "e.zip")).collect()


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def jpeg(width, height, between=b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + bytes(10)):
    return b"\xff\xd8" + between + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + bytes(9)


def test_sizes_of_images(spark):
    far = b"\xff\xe1" + struct.pack(">H", 65_000) + bytes(64_998)
    rows = [("p", png(30, 20)), ("big", png(9000, 9000)), ("j", jpeg(640, 480)), ("far", jpeg(7, 5, far * 3)), ("beyond", jpeg(7, 5, far * 20)), ("cut", jpeg(7, 5)[:12]), ("scan", b"\xff\xd8\xff\xda\x00\x08" + bytes(20)), ("text", b"text"), ("none", None), ("empty", b"")]
    got = {r.k: (r.width, r.height, r.error) for r in archives.image_sizes(spark.createDataFrame(rows, "k string, content binary")).collect()}
    assert got["p"] == (30, 20, None) and got["big"] == (9000, 9000, "too many pixels") and got["j"] == (640, 480, None) and got["far"] == (7, 5, None)
    assert all(got[k] == (None, None, "not an image") for k in ("beyond", "cut", "scan", "text", "none", "empty"))


@pytest.fixture
def timers(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def test_a_replayed_budget_is_the_batch_budget(timers, tmp_path):
    spark, rng, rows = timers, random.Random(2), []
    for day in range(3):
        first = datetime(2024, 5, 1 + day, tzinfo=UTC)
        rows += [(first + timedelta(minutes=10 * k), len(rows) + k, rng.choice((0.5, 1.25, 2.0))) for k in range(100)]
    schema = "ts timestamp, request long, cost double"
    want = {(r.key, r.request): r.admitted for r in guards.daily_budget(spark.createDataFrame(rows, schema), 60.0).collect()}
    assert len(set(want.values())) == 2
    for k in range(6):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={k}"))
    late = [(datetime(2024, 5, 1, 1, tzinfo=UTC), 999, 0.1)]
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(str(tmp_path / "in/part=6"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    q = online.daily_budget(stream, 60.0).writeStream.format("memory").queryName("budgeted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    got = {(r.key, r.request): r.admitted for r in spark.table("budgeted").collect()}
    assert {k: v for k, v in got.items() if k[1] != 999} == want and got.get((late[0][0].date(), 999), False) is False


def test_rows_with_errors_beside_results(spark, tmp_path):
    app = "beverage string, brand string, class string, producer array<string>, origin string, abv double, net_ml double, aliases map<string,array<string>>"
    rows = [
        (1, "A.png", "wine", "OLD MILL", "", [], "", 0.0, 0.0, None), (2, "none.png", "wine", "X", "", [], "", 0.0, 0.0, None), (3, "bad.png", "wine", "X", "", [], "", 0.0, 0.0, None),
        (4, "a.PNG", "cider", "OLD MILL", "", [], "", 0.0, 0.0, None), (5, "a.png", "", "OLD MILL", "", [], "", 0.0, 0.0, None), (6, "dir/a.png", "wine", "STONE HALL", "", [], "", 0.0, 0.0, None),
        (7, None, "wine", "X", "", [], "", 0.0, 0.0, None), (8, "a.png", "", "", "", [], "", 0.0, 0.0, None),
    ]
    df = spark.createDataFrame(rows, f"row long, image string, {app}")
    images = spark.createDataFrame([("a.png", None), ("bad.png", "not an image")], "key string, error string")
    det = spark.createDataFrame([("a.png", 0, 0, 0, 80, 12, "Old Mill", 0.9)], "label string, det_idx int, x0 int, y0 int, x1 int, y1 int, text string, confidence double")
    df.write.parquet(str(tmp_path / "in"))
    q = online.stream_rows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), images, det, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(200)
    assert q.exception() is None
    got = {x["row"]: x for x in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect())}
    assert set(got) == set(range(1, 9))
    assert {k: v.get("error") for k, v in got.items()} == {
        1: None, 2: "There is no file called none.png.", 3: "bad.png: not an image", 4: "unknown beverage cider", 5: "claims without a beverage", 6: None, 7: "no image", 8: None,
    }
    assert got[1]["claims"][0]["status"] == "VERIFIED" and got[6]["claims"][0]["status"] == "NOT_FOUND" and got[8]["claims"] == []
    assert "claims" not in got[2]


def test_images_of_an_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/A.PNG", png(3, 4))
        z.writestr("x/b.jpg", jpeg(5, 6))
        z.writestr("x/c.png", b"no")
    sized = archives.image_sizes(archives.zip_archive(spark, str(tmp_path / "a.zip")).filter("latest"))
    assert {r.key: (r.width, r.height, r.error) for r in sized.collect()} == {"a.png": (3, 4, None), "b.jpg": (5, 6, None), "c.png": (None, None, "not an image")}
    assert {r.key for r in files.zip_entries(spark, str(tmp_path / "a.zip")).collect()} == {"a.png", "b.jpg", "c.png"}
