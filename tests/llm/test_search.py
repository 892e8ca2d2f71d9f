"""Ranked search and the audit of sources against plain second implementations."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veriframe.llm import divergence, search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_search(docs, items, top):
    docs = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in docs]
    full = [(i, w, Counter(w)) for i, w in docs if w]
    n, length = len(full), sum(len(w) for _, w, _ in full)
    df = Counter(t for _, _, c in full for t in c)
    out = []
    for k, text in items:
        scores = []
        for i, w, c in full:
            m = 25 + 75 * len(w) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in WORD.findall((text or "").translate(LOWER)) if c[t])
            if s > 0:
                scores.append((-s, math.inf if i is None else i, i))
        out += [(k, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:top], 1)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1], str(r[2]), r[3]))


@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_search_of_the_tables(spark, small, monkeypatch, block_bytes):
    monkeypatch.setattr(search, "BLOCK_DOCS", 7 if block_bytes == 300 else 4096)
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    if block_bytes == 300:
        items = items.withColumn("text", F.substring("text", 1, 120))
    got = [tuple(r) for r in search.search(docs, items, block_bytes=block_bytes).collect()]
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert ordered(got) == ordered(want)


def test_search_edges(spark, odd, empty):
    items = [(1, "the quick brown FOX fox"), (1, "river"), (2, None), (3, "..."), (None, "unbroken é"), (5, "ééééé a 1234"), (6, "nowhere met")]
    table = spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id long, text string, doc_id string, n int")
    got = search.search(odd, table, top=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute_search(docs, items, 3))
    assert search.search(empty, table).count() == 0 and search.search(odd, table.limit(0)).count() == 0
    assert search.search(odd.filter("text is null or text = ''"), table).count() == 0


def test_equal_scores_by_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(40, 0, -1)] + [(7, "same words here"), (None, "same words here"), (99, "other")], "doc_id long, text string").repartition(5)
    got = search.search(docs, spark.createDataFrame([(1, "words same")], "item_id int, text string"), top=12).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11] and len({r.score for r in got}) == 1


def brute_audit(docs, least, top):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        words = LETTERS.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in df[lang].items() if c >= least]
        whole = sum((counts[g] for g in groups if g[0] == lang), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        own = {g[1]: shares(counts[g]) for g in groups if g[0] == lang}
        q = shares(whole)
        for s, p in own.items():
            pairs = [(-sum(abs(p[t] - x[t]) for t in kept), o.encode()) for o, x in own.items() if o != s]
            terms = [(q[t] - p[t], t.encode()) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard_terms": 5, "cell_groups": 2, "least_cells": 3}, {"shard_terms": 40, "cell_groups": 1000, "least_cells": 1}])
def test_audit_of_the_table(spark, small, sizes):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(docs, least_docs=8, top=6, **sizes).collect())
    assert got == brute_audit([(r.lang, r.source, r.text) for r in docs.collect()], 8, 6)


def test_audit_edges(spark, odd, empty):
    rows = [("en", "a", "x y y Z é"), ("en", "b", "x x x, y"), ("en", None, None), (None, "a", "x"), (None, "b", ""), ("de", "only", "x y"), ("en", "a", "x y y Z é"), ("en", "ü", "Ä ä x")]
    docs = spark.createDataFrame([(*r, 1, "t", "p", 2) for r in rows], "lang string, source string, text string, n int, term string, part string, round int")
    for least in (1, 2, 30):
        got = sorted(tuple(r) for r in divergence.audit(docs, least_docs=least, top=2).collect())
        assert got == brute_audit(rows, least, 2)
    assert divergence.audit(empty).count() == 0
    got = sorted(tuple(r) for r in divergence.audit(odd, least_docs=1).collect())
    assert got == brute_audit([(r.lang, r.source, r.text) for r in odd.collect()], 1, 50)


def test_tournament_meets_once():
    for cells in range(2, 40):
        rounds = defaultdict(list)
        for a in range(cells):
            for b in range(a + 1, cells):
                rounds[divergence.round_of(a, b, cells)] += [a, b]
                assert divergence.host_of(a, b) in (a, b)
        assert len(rounds) == cells - 1 + cells % 2 and all(len(x) == len(set(x)) for x in rounds.values())


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (9_000_000_000, 9_000_000_001, 3), (123_456_789_012, 987_654_321_098_765, 1_000_000), (5, 7, 2)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 1_000_000_000 * (c + 5) // (n + 5 * v) for c, n, v in cases]
