"""Pages that tax the scan, and toxicity on the held-out rows of the given tables."""

import os
import time
import zlib

import duckdb
import numpy as np
import pytest

from veriframe.llm import html, toxicity

BROKEN = {
    "unclosed tags": "<a " * 330_000,
    "tags ended by a bracket in the text": "a <" * 330_000 + ">",
    "open quotes": '<a x="' * 170_000,
    "quotes that never end a tag": '<a x=">" ' * 110_000,
    "deep with unmatched ends": "<div>" * 100_000 + "</p></section>" * 40_000,
    "comments": "<!--" * 250_000,
    "spaces": "<a x =" + " " * 900_000 + ">",
    "attributes": "<div " + "a " * 450_000 + ">",
}
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_a_million_bytes_of_broken_markup(name):
    start = time.perf_counter()
    html.main_text("<article><p>" + "word " * 30 + "</p></article>" + BROKEN[name])
    assert time.perf_counter() - start < 5


def test_quotes_and_comments():
    text = "word " * 30 + "end"
    blocks = lambda page: [b[0] for b in html.blocks(page)]
    assert blocks(f'<p title="a > b">{text}</p><p data-x=\'"\'>two</p>') == [text, "two"]
    assert blocks(f"<p title=it's>{text}</p><p>don't > 5</p>") == [text, "don't > 5"]
    assert blocks("<!--> one <!-- <p>no</p> --> <p>a < b <c</p>two") == ["one", "a < b", "two"]
    assert blocks('<p>one</p><p x="2>two</p><p>three</p>') == ["one", "two", "three"]  # a quote that never closes holds nothing
    assert blocks("<p>one</p> two <p") == ["one", "two"]


def brute_typical(ordinary, toxic):
    flat = lambda t: toxicity._flat(t)
    held = lambda texts, g: sum(g in flat(t) for t in texts)
    grams = {f[i : i + toxicity.GRAM] for f in map(flat, toxic) for i in range(len(f) - toxicity.GRAM + 1)}
    out = set()
    for g in grams:
        a, b = held(toxic, g) / len(toxic), held(ordinary, g) / len(ordinary)
        p = (held(toxic, g) + held(ordinary, g)) / (len(toxic) + len(ordinary))
        if held(toxic, g) > 1 and a > toxicity.TIMES * b and a - b > toxicity.SIGNIFICANT * (p * (1 - p) * (1 / len(toxic) + 1 / len(ordinary))) ** 0.5:
            out.add(g)
    return out


def test_typical_sequences_by_brute_force():
    rng = np.random.default_rng(5)
    words = [b"baba", b"dede", b"kiko", b"mumo", b"bodu"]
    text = lambda *more: b" ".join([*(words[i] for i in rng.integers(0, 5, 12)), *more])
    ordinary = [text() for _ in range(60)] + [b"", b"ab"]
    toxic = [text(b"zarquon") for _ in range(12)] + [text() for _ in range(6)]
    got = toxicity.typical(ordinary, toxic)
    assert {int(g).to_bytes(8, "little")[: toxicity.GRAM] for g in got} == brute_typical(ordinary, toxic)
    assert any(b"zarqu" in s for s in toxicity.stretches(toxic[0], got)) and toxicity.stretches(b"", got) == []
    assert len(toxicity.typical([b"", b"a"], [b"", b"b"])) == 0


@pytest.mark.parametrize(("sf", "least_auc"), [("sf0.01", 0.8), ("sf0.1", 0.86)])
def test_toxicity_beats_the_majority_on_held_out_rows(sf, least_auc):
    folder = f"/root/testdata/{sf}"
    if not os.path.exists(folder):
        pytest.skip("no tables")
    rows = duckdb.sql(f"select doc_id, toxic, text from '{folder}/documents.parquet' join '{folder}/labels.parquet' using (doc_id) where text is not null and toxic is not null order by all").fetchall()
    held = [(y, t.encode()) for i, y, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    model = toxicity.fit([(y, t.encode()) for i, y, t in rows if zlib.crc32(str(i).encode()) % 5 and len(t) <= toxicity.LONGEST])
    got = model.judge([t for _, t in held])
    y = np.array([y for y, _ in held])
    assert np.mean([g[1] == z for g, z in zip(got, y, strict=True)]) > max(y.mean(), 1 - y.mean())
    s1, s0 = (np.array([g[0] for g, z in zip(got, y, strict=True) if z == k]) for k in (1, 0))
    assert (np.sign(s1[:, None] - s0[None]) / 2 + 0.5).mean() > least_auc


def test_neighbours_are_added_up_over_batches(spark):
    # Before, each Arrow batch sent rows of its own for every word.
    import numpy as np

    from veriframe.llm import brown

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        docs = spark.createDataFrame([(f"alpha beta word{k % 7}",) for k in range(200)], "text string").coalesce(1)
        rows = brown.count_neighbours(docs, {b"alpha": brown.END + 1}, np.arange(brown.END + 2) % 3, 3).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(r.word for r in rows) == ["beta", *[f"word{k}" for k in range(7)]]
    assert {r.word: sum(r.ns) for r in rows}["beta"] == 400


def test_quality_learns_from_all_labelled_documents(spark, monkeypatch):
    # Before, a sample of documents of at most 20,000 characters was learnt from: without them no score but 0.5.
    from veriframe.llm import quality

    monkeypatch.setattr(quality, "FEW", 3)
    long = lambda k: "a fair line of words " * (1100 + k) if k % 2 else "@# $$ !! || 99 " * (1500 + k)
    docs = spark.createDataFrame([(k, long(k)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    rows = quality.rank(docs, labels, F.col("doc_id") >= 0).collect()
    assert len(rows) == 40 and all(r.predicted == r.doc_id % 2 for r in rows)
    values = [float(x) for x in (5, 1, 1, 1, 9, 2, 2, 7)]
    scores = spark.createDataFrame([(x,) for x in values], "s double")
    assert [quality.between(scores, n) for n in range(1, 8)] == [(a + b) / 2 for a, b in zip(sorted(values), sorted(values)[1:])]
    rare = spark.createDataFrame([(k, k, int(k < 2), [float(k)]) for k in range(1000)], "doc_id long, h long, y int, f array<double>")
    dealt = quality.buckets(rare, {0: 998, 1: 2}).collect()
    assert sorted(x for r in dealt for x in r.bad) == list(range(2, 1000)) and all(sorted(r.good) == [0, 1] for r in dealt) and len(dealt) > 10
