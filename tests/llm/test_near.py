"""Joins of near copies: odd sketches, long buckets, and rows that share an id."""

import random

import numpy as np
import pytest

import corpus_pipeline
from veriframe.llm import jaccard, oddsketch, queries, similar
from veriframe.llm.common import materialise

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def shingles(text, k):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").translate({ord(c): " " for c in SPACE}).split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k, numer, denom):
    """Of each row (its place) the size of its set and the least id that links reach."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and denom * both >= numer * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_texts(seed, n=150):
    """Chains of edits, a group around one text, texts that share a passage, short ones, copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, passage = [word() for _ in range(90)], [word() for _ in range(40)]
    walk = list(base)
    out = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            walk[rng.randrange(90)] = word()
            out.append(" ".join(walk))
        elif kind == 1:
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(90)] = word()
            out.append(" ".join(own))
        elif kind == 2:
            out.append(" ".join([word() for _ in range(rng.randint(1, 25))] + passage))
        elif kind == 3:
            out.append(" ".join(rng.choice("pqr") for _ in range(rng.randint(0, 5))))
        else:
            out.append(out[rng.randrange(len(out))].upper())
    return list(enumerate(out))


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize(("short", "block"), [(16, 1 << 21), (2, 3000)])
def test_odd_sketch_components(spark, monkeypatch, short, block):
    monkeypatch.setattr(similar.cross_links, "__defaults__", (similar.BROADCAST_IDS, block))
    monkeypatch.setattr(similar.likely_edges, "__defaults__", (block // 300,))
    rows = near_texts(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in oddsketch.components(frame(spark, rows), short=short).collect())
    assert got == sorted(brute(rows, 3, 17, 20))


def test_odd_sketches_of_the_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op12_minhash_dedup(spark, small).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 17, 20))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize(("short", "block"), [(16, 1 << 21), (2, 3000)])
def test_jaccard_by_long_and_short_buckets(spark, monkeypatch, short, block):
    monkeypatch.setattr(similar.cross_links, "__defaults__", (similar.BROADCAST_IDS, block))
    monkeypatch.setattr(similar.likely_edges, "__defaults__", (block // 300,))
    rows = near_texts(6)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(frame(spark, rows), short=short).collect())
    assert got == sorted(brute(rows, 5, 3, 4))


def test_links_come_from_the_product(spark):
    """Without a long bucket, every link between sets that differ is a candidate of the product."""
    rows = [(i, t) for i, t in near_texts(7, 60) if i % 5 in (0, 2, 3)]
    docs = frame(spark, rows)
    _, nodes, edges = jaccard.links(docs, short=1000)
    first = {r.nid: r.first for r in nodes.collect()}
    sets = {i: shingles(t, 5) for i, t in rows}
    got = {tuple(sorted((first[r.a], first[r.b]))) for r in edges.collect()}
    want = {(i, j) for i in first.values() for j in first.values() if i < j and sets[i] & sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    assert got == want and want


@pytest.mark.parametrize("broadcast_ids", [1_000_000, 0])
def test_rows_that_share_an_id(spark, broadcast_ids):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [
        (1, "a b c d e f g"), (1, "z y x w v u t"), (4, "z y x w v u t"), (4, near), (2, near + " more"), (2, near + " more"), (2, "A  b c d e f g"),
        (7, None), (7, ""), (None, near), (None, "a b c d e f g"), (9, "lone words here"), (9, "lone words here"),
    ]
    want = sorted([(1, "a b c d e f g"), (1, "z y x w v u t"), (2, near + " more"), (7, None), (7, ""), (None, near), (None, "a b c d e f g"), (9, "lone words here")], key=str)
    for seed in (1, 2):
        dealt = list(rows)
        random.Random(seed).shuffle(dealt)
        docs = spark.createDataFrame([(*r, 3, "x") for r in dealt], "doc_id long, text string, n int, row string").repartition(4)
        got = jaccard.deduplicated(docs, broadcast_ids=broadcast_ids)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
        parts = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs.select("doc_id", "text")).collect() if r.doc_id is not None]
        assert sorted(parts) == sorted(brute([r for r in rows if r[0] is not None], 5, 3, 4))
        stage = materialise(corpus_pipeline.drop_near_copies(spark, docs, ""))
        assert sorted(((r.doc_id, r.text) for r in stage.collect()), key=str) == want


def test_documents_that_share_only_a_passage_are_not_pooled(spark, monkeypatch):
    """Rows of a long bucket are held against each other there; they don't all become one pool that is compared pair by pair."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(12)]
    texts = [" ".join([word() for _ in range(12)] + passage) for _ in range(24)]
    texts += [f"{t} {word()}" for t in texts[:3]]
    rows = list(enumerate(texts))
    found = []
    kept = jaccard.likely_edges
    monkeypatch.setattr(jaccard, "likely_edges", lambda *a, **k: found.append(kept(*a, **k)) or found[-1])
    # Few documents a task, so that the passage's shingles don't count as frequent.
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(27)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs, short=2).collect()]
    assert sorted(got) == sorted(brute(rows, 5, 3, 4))
    assert found and all(x.count() == 0 for x in found)


def test_odd_sketches_on_odd_tables(spark, odd, empty):
    rows = oddsketch.components(odd).collect()
    assert len(rows) == odd.count() and oddsketch.components(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert [by[i].n_shingles for i in (0, 1, 2, 3)] == [0, 0, 0, 1] and [by[i].component_id for i in (0, 1, 2)] == [0, 1, 2]
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept and by[None].kept and by[None].component_id is None
    assert [r.kept for r in rows if r.doc_id == 5] == [True, True]


def test_sketches_bound_and_estimate_differences():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    for part in (1.0, 0.95, 0.9, 0.5):
        other = np.unique(np.concatenate((base[: int(len(base) * part)], rng.integers(0, 2**63, int(3000 * (1 - part))).astype(np.uint64))))
        a, b = oddsketch.minima([base, other])
        apart = int((a != b).sum())
        bits = int(np.bitwise_count(np.bitwise_xor(*oddsketch.odd_sketch(np.stack((a, b)))).view(np.uint64)).sum())
        assert bits <= 2 * apart and bits % 2 == 0
        guess = -oddsketch.BITS / 2 * np.log(1 - 2 * bits / oddsketch.BITS)
        assert abs(guess - 2 * apart) <= 4 + 0.25 * apart
    assert oddsketch.MOST_BITS < oddsketch.SAMPLES
    similarity = 17 / 20
    assert (1 - similarity**oddsketch.ROWS) ** oddsketch.BANDS < 1e-6
