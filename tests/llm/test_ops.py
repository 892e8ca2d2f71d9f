"""The training-data operators against brute force, and on odd tables."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from veriframe.llm import brown, common, components, decontamination, fingerprints, html, jaccard, langid, pieces, quality, queries, sharding, toxicity

MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def documents(small):
    return duckdb.sql(f"select doc_id, text, lang from '{small}/documents.parquet' order by doc_id").fetchall()


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


# 1


fold_column = common.fold


def brute_base(rows, learn):
    c = Counter()
    for i, t in rows:
        if learn(i):
            c.update((t or "").encode().lower().split() + [b"\n"])
    n, v = sum(c.values()), len(c)
    return c, n, {i: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in (t or "").encode().lower().split() + [b"\n"]) for i, t in rows}


@pytest.mark.parametrize("head", [1 << 18, 300])
def test_language_model(spark, small, monkeypatch, head):
    monkeypatch.setattr(brown, "HEAD", head)
    rows = [(i, t) for i, t, _ in documents(small)]
    c, n, base = brute_base(rows, lambda i: fold(i, 5) != 1)
    got = {r.doc_id: r for r in queries.op1_lm_scoring(spark, small).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        words = t.encode().lower().split() + [b"\n"]
        r = got[i]
        assert r.base_score == pytest.approx(base[i], rel=1e-9) and r.train_tokens == n and r.n_tokens == len(words)
        assert r.n_known == sum(c[w] > 0 for w in words) and r.held_out == (fold(i, 5) == 1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    group = np.arange(60) % 3  # words of group g are followed by words of group g + 1
    n = np.zeros((60, 60))
    for _ in range(20_000):
        w = rng.integers(60)
        n[w, rng.choice(np.flatnonzero(group == (group[w] + 1) % 3))] += 1
    c = brown.exchange(n, classes=3)
    assert len({(a, b) for a, b in zip(group.tolist(), c.tolist(), strict=True)}) == 3


@pytest.mark.parametrize("head", [1 << 18, 1000])
def test_classes_reach_rare_words_and_grow(spark, monkeypatch, head):
    monkeypatch.setattr(brown, "HEAD", head)
    rng = random.Random(4)
    kinds = [[[f"{rng.randrange(10**9)}" for _ in range(n)] for n in (20, 2000)] for _ in range(2)]
    rows = [(i, " ".join(rng.choice(kinds[k % 2][rng.randrange(2)]) for k in range(100))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = brown.score(docs, train=fold_column("doc_id", 5) != 1).filter(fold_column("doc_id", 5) == 1).collect()
    # Each word is of one of two kinds that take turns, so a model that knows the kind gains log10(2) a token.
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.11
    assert brown.classes_of(1000) == 32 < brown.classes_of(400_000) < brown.classes_of(20_000_000)


def test_ends_outside_the_table_are_known(spark, monkeypatch):
    """Few long texts: an end is rarer than the words that fill the table of frequent ones."""
    monkeypatch.setattr(brown, "HEAD", 30)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(30)) + " " + " ".join(f"w{k}" for k in range(30))) for i in range(3)], "doc_id long, text string")
    rows = brown.score(docs, F.lit(True)).collect()
    base = 60 * math.log10((6 + 0.5) / (183 + 0.5 * 32)) + math.log10((3 + 0.5) / (183 + 0.5 * 32))
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(61, 61, 183)] * 3
    assert all(r.base_score == pytest.approx(base, rel=1e-9) for r in rows)


def test_language_model_on_odd_tables(spark, odd, empty):
    rows = brown.score(odd, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert brown.score(empty, F.lit(True)).count() == 0
    assert {r.n_known for r in brown.score(odd, F.lit(False)).collect()} == {0}


# 2, 6, 7


def synthetic(spark, n=300):
    rng = random.Random(4)
    parts = "ba be bi bo bu da de di do du ka ke ki ko ku ma me mi mo mu".split()
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        bad, low = i % 4 == 0, i % 3 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zarquon", "flumptious", "grobnik"]))
        if low:
            words = [w + rng.choice(["###", "%%%", "$$$"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if low else 1, 1 if bad else 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality_on_held_out_rows(spark):
    docs, labels = synthetic(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    t = toxicity.score(docs, labels, common.fold("doc_id", 5) != 0).collect()
    held = [r for r in t if fold(r.doc_id, 5) == 0]
    assert np.mean([r.predicted == truth[r.doc_id].toxic for r in held]) > 0.95
    kept = {r.doc_id for r in toxicity.score(docs, labels, common.fold("doc_id", 5) != 0, keep=True).collect()}
    assert kept == {r.doc_id for r in t if not r.predicted}
    q = [r for r in quality.rank(docs, labels, common.fold("doc_id", 3) != 1).collect() if fold(r.doc_id, 3) == 1]
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in q]) > 0.95


def test_toxicity_compares_window_lengths():
    rng = random.Random(8)
    parts = "ba be bi bo bu da de di do du ka ke ki ko ku ma me mi mo mu".split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(1200):
        w = [word() for _ in range(rng.randint(5, 120))]
        if i % 4 == 0:
            for k in range(0, len(w), 25):
                w[k + rng.randrange(min(25, len(w) - k))] = rng.choice(["zarquon", "flumptious", "grobnik", "vexarious"])
        rows.append((int(i % 4 == 0), " ".join(w).encode()))
    model = toxicity.fit(rows[:900])
    held = rows[900:]
    got = model.judge([t for _, t in held])
    # Every pair of a toxic and an ordinary document in the right order (ties count half).
    s1, s0 = ([g[0] for g, (y, _) in zip(got, held, strict=True) if y == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in s1 for b in s0]) > 0.97 and len(set(s1)) > 20
    # The same by one call of the library for each window.
    ordinary, toxic = model.raw
    p = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=18, hash_log=18, chain_log=18, search_log=6, write_content_size=False, write_checksum=False, write_dict_id=False)
    one, two = (zstandard.ZstdCompressor(compression_params=p, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (ordinary + bytes(len(toxic)), ordinary + toxic))
    for (_, t), g in zip(held[:60], got, strict=False):
        w = t.decode().lower().split()
        cut = [f" {' '.join(w[i : i + 8])} ".encode() for i in range(0, len(w), 8)]
        saved = [len(one.compress(x)) - len(two.compress(x)) for x in cut]
        total = sum(model.weights[min(max(x, -1), toxicity.MOST) + 1] for x in saved)
        assert g[2:] == (len(cut), sum(model.weights[min(max(x, -1), toxicity.MOST) + 1] > 1 for x in saved), sum(saved))
        assert g[0] == pytest.approx(1 / (1 + math.exp(model.threshold - total))) and g[1] == (total >= model.threshold)
    assert model.judge([b""]) == [(pytest.approx(1 / (1 + math.exp(model.threshold))), 0, 0, 0, 0)]
    long = [b"x" * 100_000, b"ab " * 100_000]
    assert [g[2] for g in model.judge(long)] == [math.ceil(math.ceil(100_000 / 48) / 8), 12_500]


def test_language_on_held_out_rows(spark, small):
    truth = {i: lang for i, _, lang in documents(small)}
    got = [r for r in queries.op6_language_id(spark, small).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.95


def test_mixture_names_both_languages(small):
    rows = [(lang, t.encode()) for _, t, lang in documents(small) if len(t) > 300]
    langs, prob = langid.fit(rows)
    a, b = (next(t for x, t in rows if x == lang)[:1500] for lang in ("de", "fr"))
    h, off = langid.ngrams([a + b" " + b])
    u, c = np.unique(h, return_counts=True)
    w, _, _ = langid.infer(c.astype(float), prob[u])
    assert {langs[k] for k in np.flatnonzero(w > 0.15)} == {"de", "fr"}


def test_classifiers_on_odd_tables(spark, odd, empty, labels):
    n = odd.count()
    t = toxicity.score(odd, labels, F.lit(True)).collect()
    q = quality.rank(odd, labels, F.lit(True)).collect()
    g = langid.identify(odd, F.lit(True)).collect()
    assert len(t) == len(q) == len(g) == n
    assert all(0 <= r.score <= 1 for r in [*t, *q, *g])
    assert {r.lang_pred for r in g if r.doc_id in (0, 1, 2, 12)} == {"und"}
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.score(odd, none, F.lit(True)).collect()} == {0}
    assert {r.score for r in quality.rank(odd, none, F.lit(True)).collect()} == {0.5}
    assert {r.lang_pred for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}
    assert toxicity.score(empty, labels, F.lit(True)).count() == quality.rank(empty, labels, F.lit(True)).count() == langid.identify(empty, F.lit(True)).count() == 0
    assert langid.identify(odd, F.lit(True), keep=0.1).columns == odd.columns


# 3

PAGES = {
    "plain": ("<html><head><title>T</title></head><body><nav><a href=x>Home</a><a href=y>News</a></nav><article><h1>Head &amp; tail</h1><p>First   line\nhere.<br>More.</p><p>Oh.</p></article><footer>Legal words here</footer></body></html>", "Head & tail\nFirst line here. More.\nOh."),
    "comments": ('<article><p>The story goes on for quite a few words in this block.</p><div class="comments"><p>I liked this story very much, thank you all.</p></div></article>', "The story goes on for quite a few words in this block."),
    "sidebar": ('<body><div class="sidebar"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><main><p>Words of the page stand here.</p></main><div id="cookie-notice">We use cookies on this site.</div></body>', "Words of the page stand here."),
    "form": ('<article><p>Text before the form, long enough to stay.</p><form><label>Name</label><input><button>Send</button></form><p>After it.</p></article>', "Text before the form, long enough to stay.\nAfter it."),
    "script": ('<article><p>One &lt;two&gt; &#233;</p><script>var p="</p><p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><p>Three</p></article>', "One <two> é\nThree"),
    "no article": ("<body><div><a href=1>Home</a> <a href=2>About</a></div><h1>Title of the page</h1><p>" + "word " * 40 + "</p><p>" + "more " * 30 + "</p></body>", "Title of the page\n" + ("word " * 40).strip() + "\n" + ("more " * 30).strip()),
    "unclosed": ("<article><h1>Head</h1><p>First one<p>Second <b>one", "Head\nFirst one\nSecond one"),
    "empty": ("", ""),
    "text only": ("Just some words without any markup at all in this page", "Just some words without any markup at all in this page"),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text(name):
    page, want = PAGES[name]
    assert html.main_text(page)[0] == want


def brute_features(shape):
    out = []
    for i in range(len(shape)):
        row = []
        for j in (i, i - 1, i + 1, i - 2, i + 2):
            row += shape[j] if 0 <= j < len(shape) else (0, 0.0)
        out.append(tuple(row))
    return out


def test_density_tree_of_the_labelled_table(small):
    pages = [[(*map(int, e[:-1].split("/")), e[-1] == "+") for e in line.split()] for line in html.LABELLED.strip().splitlines()]
    rows = [brute_features([(n, k / n) for n, k, _ in p]) for p in pages]
    for p, r in zip(pages, rows, strict=True):
        assert html.features([(n, k / n) for n, k, _ in p]) == r and [html.classify(x) for x in r] == [y for *_, y in p]
    # A tree of the other pages' blocks, on each page.
    right = []
    for i, p in enumerate(pages):
        rest = [j for j in range(len(pages)) if j != i]
        tree = html.grow(np.array([x for j in rest for x in rows[j]]), np.array([float(y) for j in rest for *_, y in pages[j]]))
        right += [html.classify(x, tree) == y for x, (*_, y) in zip(rows[i], p, strict=True)]
    assert np.mean(right) > 0.95


def test_density_decides_without_names(small):
    """With classes and the elements that name a part taken out, what the tree alone does is nearly the same."""
    plain = lambda h: re.sub(r"</?(article|nav|footer|aside|main|header)\b[^>]*>", "<div>", re.sub(r' (class|id|role)="[^"]*"', "", h))
    pages = [h for (h,) in duckdb.sql(f"select html from '{small}/pages.parquet' where html is not null").fetchall()]
    blocks = declared = wrong = 0
    for h in pages:
        text, n, _, d = html.main_text(h)
        alone = html.main_text(plain(h))
        assert alone[1] == n and alone[3] == 0
        blocks, declared = blocks + n, declared + d
        wrong += len(set(text.split("\n")) ^ set(alone[0].split("\n")))
    assert declared / blocks < 0.08 and wrong / blocks < 0.08


def test_pages(spark, small):
    df = spark.createDataFrame([(1, None, "<p>x"), (2, "u", None), (2, "u", None), (None, "v", "<!-- never ends")], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    assert sorted((str(r.page_id), r.text) for r in html.extract(df).collect()) == [("1", "x"), ("2", ""), ("2", ""), ("None", "")]
    assert html.extract(df.limit(0)).count() == 0
    rows = queries.op3_html_extraction(spark, small).collect()
    assert all(r.n_chars == len(r.text) for r in rows) and all(r.text for r in rows)


# 4


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in at[x] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def chained(n=60, seed=1):
    """Texts of which each is like the next but not like all, beside shared passages and unlike ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = [word() for _ in range(30)]
    words = [word() for _ in range(80)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            words = words[: -4] + [word() for _ in range(4)] if i % 6 else words[3:] + [word()]
            out.append((i, " ".join(words)))
        elif i % 3 == 1:
            out.append((i, " ".join([word() for _ in range(rng.randint(3, 30))] + shared)))
        else:
            out.append((i, " ".join(word() for _ in range(rng.randint(0, 9)))))
    return out + [(n, out[0][1]), (n + 1, out[0][1].upper())]


@pytest.mark.parametrize("broadcast_ids", [1_000_000, 0])
def test_jaccard_components(spark, broadcast_ids):
    rows = chained()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df, broadcast_ids=broadcast_ids).collect()}
    assert got == brute_components(rows)


def test_jaccard_of_the_tables(spark, small):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_ngram_jaccard(spark, small).collect()}
    assert got == brute_components([(i, t) for i, t, _ in documents(small)])


def test_jaccard_on_odd_tables(spark, odd, empty):
    rows = jaccard.components(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert [by[i].n_shingles for i in (0, 1, 2, 3)] == [0, 0, 0, 1] and [by[i].component_id for i in (0, 1, 2)] == [0, 1, 2]
    assert by[6].component_id == by[7].component_id == 5 and by[None].component_id is None
    assert jaccard.components(empty).count() == 0


def test_parities_bound_differences():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)) for _ in "ab")
        b = np.union1d(b, a[: len(a) // 2])
        p, q = jaccard.parities(a), jaccard.parities(b)
        size = min(len(p), len(q))
        assert int(np.bitwise_count(jaccard.folded(p, size) ^ jaccard.folded(q, size)).sum()) <= len(np.setxor1d(a, b))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components.connected(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_chains_of_a_task_cost_no_rounds(spark):
    """Each round writes a table, so a chain that one task holds makes no more of them than a single edge."""
    chain = spark.createDataFrame([((i * 37) % 401, ((i + 1) * 37) % 401) for i in range(400)] + [(900, 900)], "a long, b long").coalesce(1)
    with common.recorded() as made:
        got = {r.node: r.label for r in components.connected(chain).collect()}
    assert got == dict.fromkeys(range(401), 0) | {900: 900}
    assert len(made) <= 3



# 5


def test_pieces_as_the_library(spark, small, odd, empty):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    alphabet = "aabbtheinerosnd  \n▁é日😀ing"
    texts = [t for _, t, _ in documents(small)] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(500)] + ["", " ", "  a  b ", "▁x ▁▁ y", "<s></s><unk><0x41>", " " * 50 + "x" + " " * 33]
    with open(MODEL, "rb") as f:
        p = pieces.Pieces(f.read())
    for t, (n, ids, decoded) in zip(texts, p.encode([t.encode() for t in texts]), strict=True):
        want = [sp.bos_id(), *sp.encode(t), sp.eos_id()]
        assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want) and decoded.decode() == sp.decode(want)
    letters = "abcdefghijklmnopqrstuvwxyz"
    unbroken = ["the" * 350_000, " " * 1_000_000, "".join(rng.choices(letters, k=1_000_000)), "x" * 65 + " " + "ab" * 40 + "\n" * 200, *("".join(rng.choices(" ethinaosr%", k=rng.randint(60, 400))).replace(" ", "q") for _ in range(100))]
    start = time.monotonic()
    for t, (_, ids, decoded) in zip(unbroken, p.encode([t.encode() for t in unbroken]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [sp.bos_id(), *sp.encode(t), sp.eos_id()] and decoded.decode() == sp.decode(sp.encode(t))
    assert time.monotonic() - start < 60
    got = {r.doc_id: r for r in pieces.encode_decode(odd, MODEL).collect()}
    for r in odd.filter("doc_id is not null").collect():
        want = [sp.bos_id(), *sp.encode(r.text or ""), sp.eos_id()]
        assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == want and got[r.doc_id].decoded == sp.decode(want)
    assert pieces.encode_decode(odd, MODEL).count() == odd.count() and pieces.encode_decode(empty, MODEL).count() == 0
    rows = queries.op5_sentencepiece(spark, small).collect()
    text = {i: t for i, t, _ in documents(small)}
    assert all(r.decoded_sha256 == hashlib.sha256(sp.decode(sp.encode(text[r.doc_id])).encode()).hexdigest() for r in rows)


# 8


def test_shards(spark, small, odd, empty):
    for df in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        rows = sharding.shard(df, 8).collect()
        count = Counter(r.shard for r in rows)
        assert len(rows) == df.count() and max(count.values()) - min(count[s] for s in range(8)) <= 1
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
        assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    text = {i: (t or "").encode() for i, t, _ in documents(small)}
    for r in queries.op8_sharding(spark, small).collect():
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))
    keyed = sharding.shard(spark.read.parquet(f"{small}/documents.parquet"), 8, law="key").collect()
    assert all(r.grown_shard in (r.shard, 8) for r in keyed) and any(r.grown_shard == 8 for r in keyed)
    assert sharding.shard(empty).count() == 0


def brute_ring(rows, shards, virtual_nodes, bounded):
    """Every key alone: its cell by the same hash, then clockwise to the first shard with room, cells in order."""
    spots = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            spots.setdefault(int(hashlib.sha256(f"{s}/{v}".encode()).hexdigest()[:8], 16) % sharding.CELLS, s)
    room = [len(rows) // shards + (s < len(rows) % shards) if bounded else len(rows) for s in range(shards)]
    used, out = [0] * shards, Counter()
    for cell, *row in sorted(rows):
        at = cell
        while at not in spots or used[spots[at]] == room[spots[at]]:
            at = (at + 1) % sharding.CELLS
        out[*row, spots[at], used[spots[at]]] += 1
        used[spots[at]] += 1
    return out


@pytest.mark.parametrize("law", ["rows", "key"])
def test_shards_as_a_ring_walked_key_by_key(spark, small, law):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    cell = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(sharding.CELLS)).cast("int")
    rows = [(r.cell, r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.select(cell.alias("cell"), "doc_id", "text").collect()]
    got = Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, 8, law=law).collect())
    assert got == brute_ring(rows, 8, 64, law == "rows")


def test_shards_do_not_depend_on_partitions(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("t")).otherwise(F.concat(F.lit("u"), F.col("id") % 50)).alias("text"))
    one, two = (Counter(tuple(r) for r in sharding.shard(df.repartition(n), 8).collect()) for n in (3, 7))
    assert one == two


def test_shards_of_one_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard(df, 8).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("s"), F.max("slot").alias("m")).collect()
    assert {(r.n, r.s, r.m) for r in rows} == {(2500, 2500, 2499)}


# 9


def test_decontamination_finds_items_exact_and_edited(spark, small, odd, empty):
    items = duckdb.sql(f"select item_id, text from '{small}/benchmark.parquet' order by 1").fetchall()
    base = [t for _, t, _ in documents(small) if len(t) > 2000]
    rng = random.Random(2)
    rows, want = [], set()
    for k, (item, t) in enumerate(items):
        w = t.split()
        for rate in (0.0, 0.1, 0.2):
            v = [x for x in w if rng.random() >= rate / 2]
            v = [("qq" + x) if rng.random() < rate / 2 else x for x in v]
            d = rng.choice(base).split()
            at = rng.randrange(len(d))
            i = 3 * k + round(rate * 10)
            rows.append((i, " ".join(d[:at] + v + d[at:])))
            a, b = (decontamination.words_of([x.encode()])[0].tolist() for x in (t, rows[-1][1]))
            if decontamination.best_match(a, b)[0] <= int(decontamination.EDITS * len(a)):
                want.add((i, item))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()}
    assert len(want & found) / len(want) >= 0.95 and {(3 * k, i) for k, (i, _) in enumerate(items)} <= found
    clean = {r.doc_id for r in decontamination.clean(docs, bench).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in found}
    assert decontamination.matches(odd, bench).count() == 0 and decontamination.matches(empty, bench).count() == 0
    assert decontamination.matches(docs, bench.limit(0)).count() == 0 and decontamination.clean(odd, bench).count() == odd.count()


def edited(rng, words, edits):
    v = list(words)
    for e in range(edits):
        k = rng.randrange(len(v))
        if rng.random() < 0.5 and len(v) > 1:
            del v[k]
        else:
            v[k] = f"edit{e}x{rng.randrange(10**6)}"
    return v


def assert_as_brute_force(lengths, vocabulary, seed, copies=10):
    """Items of each length with 0, a fifth and a quarter of their words edited, against the best match with each whole document."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    items = [some(m) for m in lengths for _ in range(copies)]
    texts = [" ".join(some(rng.randrange(40)) + edited(rng, w, e) + some(rng.randrange(40))).encode() for w in items for e in (0, len(w) // 5, len(w) // 4)]
    got = {(d, i): (distance, last) for d, i, distance, _, last in decontamination.Items([(k, " ".join(w)) for k, w in enumerate(items)]).search(texts)}
    patterns, want = [decontamination.words_of([" ".join(w).encode()])[0].tolist() for w in items], {}
    for d, t in enumerate(texts):
        h, _, ends, _, _ = decontamination.words_of([t])
        for i, p in enumerate(patterns):
            distance, end = decontamination.best_match(p, h.tolist())
            if distance <= len(p) // 4:
                want[d, i] = (distance, int(ends[end - 1]))
    assert got == want and {(3 * i + e, i) for i in range(len(items)) for e in range(3)} <= set(got)


@pytest.mark.parametrize("vocabulary", [50, 20_000])
@pytest.mark.parametrize("length", [12, 16, 23, 24, 28, 32, 40, 70])
def test_decontamination_finds_all_edits_within_the_limit(length, vocabulary):
    assert_as_brute_force([length], vocabulary, seed=length)


@pytest.mark.parametrize("vocabulary", [50, 20_000])
def test_decontamination_finds_short_items(spark, vocabulary):
    assert_as_brute_force(range(1, 12), vocabulary, seed=7, copies=4)
    docs = spark.createDataFrame([(1, "one Alpha, here"), (2, "alpha"), (3, "alphabet one"), (4, "here alpha one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha"), (2, "one alpha")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(docs, items).collect()} == {(1, 1), (2, 1), (4, 1), (1, 2)}
    assert [r.doc_id for r in decontamination.clean(docs, items).collect()] == [3]


def test_decontamination_takes_items_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEM_BYTES_AT_ONCE", 100_000)
    rng = random.Random(9)
    long = [f"word{rng.randrange(5000)}" for _ in range(15_000)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, "a short item of six words"), (3, " ".join(long[:9000]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(edited(rng, long, 900))), (2, "here is a short item of six words"), (3, " ".join(long[:7000]))], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.matches(docs, items).collect()}
    assert set(found) == {(1, 1), (1, 3), (2, 2), (3, 3)}
    assert found[1, 1].item_words == 15_000 and 0 < found[1, 1].distance <= 900 and found[3, 3].distance == 2000
    assert decontamination.clean(docs, items).count() == 0


def test_best_match_is_an_edit_distance():
    rng = random.Random(3)

    def brute(p, t):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(300):
        p, t = ([rng.randint(0, 3) for _ in range(rng.randint(1, n))] for n in (8, 15))
        assert decontamination.best_match(p, t)[0] == brute(p, t)


# 10


def test_fingerprints(spark, small, odd, empty):
    rows = {r.doc_id: r for r in queries.op10_fingerprints(spark, small).collect()}
    docs = documents(small)
    for (i, t, _), (_, n, _) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        d = fingerprints.digests([t.encode(), e.encode(), n.encode()])
        assert rows[i].fingerprint == fingerprints.text_of(d[0]) and rows[i].near_edited == pytest.approx(fingerprints.likeness(d[0], d[1])) and rows[i].near_next == pytest.approx(fingerprints.likeness(d[0], d[2]))
    long = [r for r in rows.values() if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > 0.3 > 10 * np.mean([r.near_next for r in long])
    got = fingerprints.fingerprint(odd).collect()
    assert len(got) == odd.count() and {r.fingerprint for r in got if r.doc_id in (0, 1)} == {""}
    same = [r.fingerprint for r in got if r.doc_id in (5, 6)]
    assert len(set(same)) == 1 and fingerprints.fingerprint(empty).count() == 0
    one = fingerprints.fingerprint(odd.filter("doc_id = 7")).first()
    assert one.near_next == 1.0


# The pipeline


def test_pipeline(spark, small):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    docs = {i: t for i, t, _ in documents(small)}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    assert out and set(out) <= set(docs)
    group = brute_components(list(docs.items()))
    assert max(Counter(group[i][1] for i in out).values()) == 1
    items = duckdb.sql(f"select text from '{small}/benchmark.parquet'").fetchall()
    held = {i for i, t in docs.items() if any(x in t for (x,) in items)}
    assert held and not held & set(out)


def test_pipeline_drops_junk_and_keeps_known_languages(spark, small):
    rng = random.Random(6)
    junk = {
        10**6: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=500)), 10**6 + 1: "asdf jkl qwer uiop zxcv asdfgh hjkl qwerty " * 8, 10**6 + 2: base64.b64encode(rng.randbytes(500)).decode(),
        10**6 + 3: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        10**6 + 4: "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.", 10**6 + 5: "12345 67890 ... ///", 10**6 + 6: None,
    }
    docs = spark.read.parquet(f"{small}/documents.parquet")
    more = spark.createDataFrame([(i, t) for i, t in junk.items()], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, both, small).select("doc_id").collect()}
    assert not kept & set(junk)
    known = {i for i, t, lang in documents(small) if t and lang and len(re.findall(r"[^\W\d_]{2,}", t)) >= 8}
    assert len(known - kept) == 0


def test_pipeline_stages_on_odd_tables(spark, odd, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such passage anywhere in the documents of this table at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, empty):
            got = stage(spark, df, str(tmp_path))
            assert got.count() <= df.count()
            if name != "sentencepiece":
                assert got.columns == df.columns
    near = corpus_pipeline.drop_near_copies(spark, odd, str(tmp_path))
    assert sorted(r.doc_id for r in near.collect() if r.doc_id in (5, 6, 7)) == [5]
