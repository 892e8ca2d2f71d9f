"""Alignment of many pairs at once against the same one pair at a time."""

import random

import numpy as np
import pytest

from veriframe.functions import align, batch


def pairs(seed, n, alphabet="O0DQI1LGCS5B8Z2UVAé"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    claims, reads = [], []
    for _ in range(n):
        a = word(rng.randint(0, 14))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = word(rng.randint(0, 2))
        claims.append(a)
        reads.append(word(rng.randint(0, 5)) + "".join(b) + word(rng.randint(0, 9)) if rng.random() < 0.8 else word(rng.randint(0, 30)))
    return claims, reads


@pytest.mark.parametrize("cc", [0, 1, 2])
@pytest.mark.parametrize("cells", [1 << 20, 60])
def test_tables_of_blocks(monkeypatch, cc, cells):
    monkeypatch.setattr(batch, "CELLS", cells)
    claims, reads = pairs(cc, 600)
    assert batch.half_edits(claims, reads, cc).tolist() == [align.half_edits(a, b, cc) for a, b in zip(claims, reads, strict=True)]
    assert list(zip(*(x.tolist() for x in batch.infix(claims, reads, cc)), strict=True)) == [align.infix(a, b, cc) for a, b in zip(claims, reads, strict=True)]
    assert batch.common(reads, claims).tolist() == [align.common(b, a) for a, b in zip(claims, reads, strict=True)]


def test_bounds_of_blocks():
    claims, reads = pairs(9, 500)
    claims += ["A" * 64, "AB" * 32, "A" * 65, "B" * 64]
    reads += ["A" * 70, "BA" * 40, "A" * 3, ""]
    for anywhere in (True, False):
        folded = [[s.translate(align._FOLD) for s in side] for side in (claims, reads)]
        got = batch.least_edits(*folded, np.full(len(claims), anywhere)).tolist()
        want = [align.least_edits(a, b, anywhere) for a, b in zip(claims, reads, strict=True)]
        assert [g for g, a in zip(got, claims, strict=True) if 0 < len(a) <= 64] == [w for w, a in zip(want, claims, strict=True) if 0 < len(a) <= 64]
        for g, a, b in zip(got, claims, reads, strict=True):
            assert g <= (align.infix(a, b)[0] if anywhere else align.half_edits(a, b))


@pytest.mark.parametrize("words", [1 << 21, 300])
def test_edits_of_long_claims(monkeypatch, words):
    monkeypatch.setattr(batch, "WORDS_AT_ONCE", words)
    rng = random.Random(5)
    claims, reads = pairs(11, 300)
    for m in (63, 64, 65, 127, 128, 129, 200):
        for alphabet in ("AB", "AÄ中BC", "ABCDEFGH"):
            b = [rng.choice(alphabet) for _ in range(rng.choice((30, m + 20)))]
            a = [rng.choice((x, x, x, "Z", "")) for x in (b * m)[3 : 3 + m]]
            claims.append("".join(a))
            reads.append("".join(b))
    claims += ["A" * 64, "", "", "A" * 70]
    reads += ["A" * 64, "", "AB", ""]
    assert (2 * batch.infix_edits(claims, reads)).tolist() == [align.infix(a, b, 2)[0] for a, b in zip(claims, reads, strict=True)]
    assert batch.infix_edits([], []).tolist() == []


def test_empty_blocks():
    assert batch.half_edits([], []).tolist() == [] and [x.tolist() for x in batch.infix([""], ["abc"])] == [[0], [0], [0]]
    assert batch.half_edits(["", "ab", ""], ["abc", "", ""]).tolist() == [6, 4, 0]
