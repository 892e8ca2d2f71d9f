"""The language mixture, the quality features and the fingerprints against plain second implementations."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from veriframe.llm import fingerprints, langid, quality

M64 = (1 << 64) - 1


def texts(small, most=4000):
    return [t for (t,) in duckdb.sql(f"select text from '{small}/documents.parquet' where text is not null order by doc_id").fetchall() if len(t) < most]


def plain_grams(text):
    """Four letters or spaces, none with two spaces side by side in its first three; digits and signs are spaces."""
    b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in b" " + text.encode() + b" "]
    out = Counter()
    for w in zip(b, b[1:], b[2:], b[3:], strict=False):
        if (w[0], w[1]) != (32, 32) and (w[1], w[2]) != (32, 32):
            g = sum(c << 8 * k for k, c in enumerate(w))
            out[(g * 2654435761 & 0xFFFFFFFF) >> (32 - langid.BITS)] += 1
    return out


def plain_mixture(grams, prob):
    """Languages one by one while the likelihood gains more than the penalty; proportions by expectation-maximisation."""
    n = sum(grams.values())
    like = lambda langs, w: sum(c * math.log(sum(prob[g][k] * v for k, v in zip(langs, w, strict=True))) for g, c in grams.items())
    languages = range(len(prob[next(iter(grams))]))
    chosen = [max(languages, key=lambda k: like([k], [1.0]))]
    w, best = [1.0], like(chosen, [1.0])
    while len(chosen) < len(languages):
        mix = {g: sum(prob[g][k] * v for k, v in zip(chosen, w, strict=True)) for g in grams}
        gain = {k: sum(c / mix[g] * prob[g][k] for g, c in grams.items()) / n for k in languages if k not in chosen}
        extra = max(gain, key=gain.get)
        if gain[extra] <= 1:
            break
        more, v = [*chosen, extra], [*(x * 0.8 for x in w), 0.2]
        for _ in range(langid.ROUNDS):
            new = [0.0] * len(v)
            for g, c in grams.items():
                part = [prob[g][k] * x for k, x in zip(more, v, strict=True)]
                for i, p in enumerate(part):
                    new[i] += c * p / sum(part) / n
            v = new
        now = like(more, v)
        if now - best <= langid.PENALTY * math.log(n + 1):
            break
        chosen, w, best = more, v, now
    return dict(zip(chosen, w, strict=True)), best / n


def test_mixture_as_plain_loops(small):
    rows = duckdb.sql(f"select lang, text from '{small}/documents.parquet' where lang is not null and text is not null order by doc_id").fetchall()
    langs, prob = langid.fit([(lang, t.encode()) for lang, t in rows[:150]])
    some = [t for _, t in rows[150:] if len(t) < 1500][:12]
    some += [some[0] + " " + next(t for lang, t in rows if lang == "de")[:800], "x", "ab cd"]
    for t in some:
        h, _ = langid.ngrams([t.encode()])
        assert Counter(h.tolist()) == plain_grams(t)
        u, c = langid.counted(h)
        w, _, mean = langid.infer(c.astype(float), prob[u].astype(float))
        want, plain = plain_mixture(dict(zip(u.tolist(), c.tolist(), strict=True)), {int(g): [float(p) for p in prob[g]] for g in u})
        assert {k: v for k, v in enumerate(w) if v} == pytest.approx(want, rel=1e-6) and mean == pytest.approx(plain, rel=1e-9)


def plain_features(text):
    b = text.encode()
    w = b.decode("latin-1").translate({c: c + 32 for c in range(65, 91)}).replace("\x1c", "_").replace("\x1d", "_").replace("\x1e", "_").replace("\x1f", "_").replace("\x85", "_").replace("\xa0", "_").split()
    if not b:
        return [0.0] * 15
    k, m, n = Counter(b), max(1, len(w)), len(b)
    upper, lower = sum(k[c] for c in range(65, 91)), sum(k[c] for c in range(97, 123))
    signs = sum(k[c] for c in b"#$%&*|^~@<=>")
    pairs = list(zip(w[1:], w, strict=False))
    same, again = sum(x == y for x, y in zip(w, w[1:], strict=False)), sum(x == y for x, y in zip(w, w[2:], strict=False))
    loops = 1 - len(set(pairs)) / max(1, len(pairs))
    return [
        signs / m, math.log1p(10 * signs / m), upper / (upper + lower + 1), k[33] / m, math.log1p(10 * k[33] / m), sum(k[c] for c in range(48, 58)) / n, same / m, math.log1p(10 * same / m),
        again / m, loops, 1 - len(set(w)) / m, math.log1p(n) / 10, (sum(map(len, w)) / len(w) if w else 0) / 10, k[124] / m, (k[46] + k[44]) / m,
    ]


def test_quality_features_and_ranking_as_plain_loops(small):
    some = [*texts(small)[:60], "", " ", "A", "a a a a", "x|y ## 12 !!", "ä ö ü"]
    got = quality.features([t.encode() for t in some])
    for row, t in zip(got, some, strict=True):
        assert row.tolist() == pytest.approx(plain_features(t), abs=1e-9)
    # The loss is least at the weights: no small step along an axis lowers it. The threshold leaves its share below.
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 15))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > -0.5).astype(int)
    mean, scale, w, threshold = quality.fit(x, y, 0.3)
    z = np.clip((x - mean) / scale, -5, 5)
    z = np.hstack([z, z * z])
    pick = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[pick.choice(good, quality.PAIRS)] - z[pick.choice(bad, quality.PAIRS)]
    loss = lambda v: np.log1p(np.exp(-(d @ v))).mean() + 0.001 * (v @ v)
    least = loss(w)
    assert all(loss(w + s * e) >= least - 1e-12 for e in np.eye(len(w)) for s in (1e-3, -1e-3))
    below = z @ w < threshold
    assert 0.3 * below[y == 0].mean() + 0.7 * below[y == 1].mean() == pytest.approx(0.3, abs=0.01)


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_fingerprint(text):
    b = text.encode()
    n, size = len(b) - fingerprints.WINDOW + 1, fingerprints.WINDOW
    r = []
    for i in range(max(0, n)):
        pairs = sum(c * (c - 1) // 2 for c in Counter(b[i : i + size]).values())
        h = -math.log2((size + 2 * pairs) / size**2)
        r.append(0 if h < fingerprints.WEAKEST else 1 + min(250, int(np.rint(abs(h - fingerprints.TYPICAL) * 48))))
    found = []
    for i, x in enumerate(r):
        if x and x > max(r[max(0, i - fingerprints.RADIUS) : i], default=0) and x >= max(r[i + 1 : i + 1 + fingerprints.RADIUS], default=0):
            h = 0x1234567
            for k in range(0, size, 8):
                h = plain_mix(h ^ int.from_bytes(b[i + k : i + k + 8], "little"))
            found.append(h)
    if not found and b:
        padded = b + bytes(-len(b) % 8)
        total = sum(int.from_bytes(padded[k : k + 8], "little") * (2 * (k // 8) + 1) for k in range(0, len(padded), 8)) & M64
        found = [plain_mix(total ^ len(b))]
    out = []
    for lo in range(0, len(found), fingerprints.PER_FILTER):
        bits = [0] * fingerprints.FILTER_BITS
        for h in found[lo : lo + fingerprints.PER_FILTER]:
            for k in range(fingerprints.HASHES):
                bits[h >> 11 * k & fingerprints.FILTER_BITS - 1] = 1
        out.append("".join(f"{int(''.join(map(str, bits[k : k + 8])), 2):02x}" for k in range(0, len(bits), 8)))
    return "-".join(out)


def test_fingerprints_as_plain_loops(small):
    rng = random.Random(2)
    some = [*texts(small, 3000)[:40], "", "a", "short text", "x" * 500, "ab" * 300, "".join(rng.choices("abcdefgh ij", k=9000))]
    got = [fingerprints.text_of(d) for d in fingerprints.digests([t.encode() for t in some])]
    assert got == [plain_fingerprint(t) for t in some]
