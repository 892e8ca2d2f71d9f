"""Alignment of many pairs of normalized strings at once, in half edits.

Tables are filled along their anti-diagonals: all cells of one, of all pairs of a block, are one array
operation. Pairs are taken in order of their lengths, so little of a block is padding. A bit-parallel
bound over blocks comes first where most pairs are beyond a budget.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

from veriframe.functions.align import ALIKE

CELLS = 1 << 20  # of one anti-diagonal of a block
FAR = 1 << 20
_ASCII = 128
_ALIKE = np.zeros((_ASCII + 1, _ASCII + 1), bool)
for _p in ALIKE:
    _ALIKE[ord(_p[0]), ord(_p[1])] = True


def codes(strings: Sequence[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the strings, one row each and filled up at the end, and their lengths."""
    size = np.array([len(s) for s in strings], np.int64)
    out = np.full((len(strings), int(size.max(initial=0))), fill, np.int32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def blocks(m: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """Places of pairs of like lengths, so many that an anti-diagonal has some ``CELLS``."""
    order = np.lexsort((n, m))
    at = 0
    while at < len(order):
        ahead = order[at : at + max(1, CELLS // (int(m[order[at]]) + 1))]
        yield ahead
        at += len(ahead)


def _costs(x: np.ndarray, y: np.ndarray, cc: int) -> np.ndarray:
    alike = _ALIKE[np.minimum(x, _ASCII), np.minimum(y, _ASCII)]
    return np.where(x == y, 0, np.where(alike, cc, 2)).astype(np.int32)


def _diagonals(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, step: Callable, seen: Callable) -> None:
    """Calls ``step(d, i0, i1, x, y)`` for each anti-diagonal (rows i0 to i1 - 1, their characters) and ``seen(d, rows)`` for the pairs whose last row is on it."""
    rows, width = a.shape[1], b.shape[1]
    back = b[:, ::-1]
    for d in range(rows + width + 1):
        i0, i1 = max(1, d - width), min(rows, d - 1) + 1  # both sides have a character here
        if i0 < i1:
            # The character of the reading at row i is that of column d - i.
            y = back[:, width - d + i0 : width - d + i1]
            step(d, i0, i1, a[:, i0 - 1 : i1 - 1], y)
        else:
            step(d, 1, 1, a[:, :0], b[:, :0])
        column = d - m
        seen(d, np.flatnonzero((column >= 0) & (column <= n)))


def _aligned(claims: Sequence[str], reads: Sequence[str], cc: int, anywhere: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = len(claims)
    m, n = np.array([len(s) for s in claims], np.int64), np.array([len(s) for s in reads], np.int64)
    cost, start, stop = np.zeros(total, np.int32), np.zeros(total, np.int32), np.zeros(total, np.int32)
    for at in blocks(m, n):
        a, k = codes([claims[i] for i in at.tolist()], -1)
        b, size = codes([reads[i] for i in at.tolist()], -2)
        rows = a.shape[1]
        shape = (len(at), rows + 1)
        # Of the last two anti-diagonals: the cost at each row, and where its path began in the reading.
        before, last = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        began, begins = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        best, first, end = np.full(len(at), FAR, np.int32), np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)

        def step(d: int, i0: int, i1: int, x: np.ndarray, y: np.ndarray) -> None:
            nonlocal before, last, began, begins
            now, from_ = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
            now[:, 0] = 0 if anywhere else 2 * d
            from_[:, 0] = d if anywhere else 0
            if d <= rows:
                now[:, d] = 2 * d
                from_[:, d] = 0
            if i0 < i1:
                # In this order, and only for a lower cost: the diagonal, a character of the claim skipped, one of the reading.
                c, s = before[:, i0 - 1 : i1 - 1] + _costs(x, y, cc), began[:, i0 - 1 : i1 - 1]
                for cell, origin in ((last[:, i0 - 1 : i1 - 1], begins[:, i0 - 1 : i1 - 1]), (last[:, i0:i1], begins[:, i0:i1])):
                    less = cell + 2 < c
                    c, s = np.where(less, cell + 2, c), np.where(less, origin, s)
                now[:, i0:i1], from_[:, i0:i1] = c, s
            before, last, began, begins = last, now, begins, from_

        def seen(d: int, own: np.ndarray) -> None:
            if not anywhere:
                own = own[d - k[own] == size[own]]
            c = last[own, k[own]]
            less = c < best[own]
            own = own[less]
            best[own], first[own], end[own] = c[less], begins[own, k[own]], d - k[own]

        _diagonals(a, b, k, size, step, seen)
        cost[at], start[at], stop[at] = best, first, end
    return cost, start, stop


def half_edits(claims: Sequence[str], reads: Sequence[str], cc: int = 1) -> np.ndarray:
    """Half edits between the strings of each pair."""
    return _aligned(claims, reads, cc, anywhere=False)[0]


def infix(claims: Sequence[str], reads: Sequence[str], cc: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half edits of each claim to its best stretch of its reading, and the stretch; the rules are those of ``align.infix``."""
    at = np.array([r.find(c) for c, r in zip(claims, reads, strict=True)], np.int32)
    size = np.array([len(c) for c in claims], np.int32)
    cost, start, stop = np.zeros(len(at), np.int32), np.maximum(at, 0), np.maximum(at, 0) + size
    open_ = np.flatnonzero(at < 0).tolist()
    if open_:
        cost[open_], start[open_], stop[open_] = _aligned([claims[i] for i in open_], [reads[i] for i in open_], cc, anywhere=True)
    return cost, start, stop


def common(reads: Sequence[str], wants: Sequence[str]) -> np.ndarray:
    """The longest common subsequence of each pair; confusable characters count as equal."""
    m, n = np.array([len(s) for s in reads], np.int64), np.array([len(s) for s in wants], np.int64)
    out = np.zeros(len(reads), np.int32)
    for at in blocks(m, n):
        a, k = codes([reads[i] for i in at.tolist()], -1)
        b, size = codes([wants[i] for i in at.tolist()], -2)
        shape = (len(at), a.shape[1] + 1)
        before, last = np.zeros(shape, np.int32), np.zeros(shape, np.int32)

        def step(d: int, i0: int, i1: int, x: np.ndarray, y: np.ndarray) -> None:
            nonlocal before, last
            now = np.zeros(shape, np.int32)
            if i0 < i1:
                met = _costs(x, y, 0) == 0
                now[:, i0:i1] = np.where(met, before[:, i0 - 1 : i1 - 1] + 1, np.maximum(last[:, i0 - 1 : i1 - 1], last[:, i0:i1]))
            before, last = last, now

        def seen(d: int, own: np.ndarray) -> None:
            own = own[d - k[own] == size[own]]
            out[at[own]] = last[own, k[own]]

        _diagonals(a, b, k, size, step, seen)
    return out


def least_edits(claims: Sequence[str], reads: Sequence[str], anywhere: np.ndarray) -> np.ndarray:
    """A lower bound of the half edits of each pair, to the reading or, where ``anywhere``, to any stretch of it.

    Twice the edits between the folded strings, for which one 64-bit number holds a column of the table; 0 for claims of more characters.
    """
    out = np.zeros(len(claims), np.int64)
    m = np.array([len(s) for s in claims], np.int64)
    n = np.array([len(s) for s in reads], np.int64)
    short = np.flatnonzero((m > 0) & (m <= 64))
    for lo in range(0, len(short), 1 << 13):
        at = short[np.argsort(n[short], kind="stable")][lo : lo + (1 << 13)]
        a, k = codes([claims[i] for i in at.tolist()], -1)
        b, size = codes([reads[i] for i in at.tolist()], -2)
        known, place = np.unique(a, return_inverse=True)
        place = place.reshape(a.shape)
        met = np.zeros((len(at), len(known) + 1), np.uint64)
        row = np.arange(len(at))
        for i in range(a.shape[1]):
            own = np.flatnonzero(i < k)
            met[own, place[own, i]] |= np.uint64(1 << i)
        where = np.minimum(np.searchsorted(known, b), len(known) - 1)
        where = np.where(known[where] == b, where, len(known))
        one = np.uint64(1)
        full = np.where(k == 64, ~np.uint64(0), (one << (k % 64).astype(np.uint64)) - one)
        top = (k - 1).astype(np.uint64)
        grow = np.where(anywhere[at], 0, 1).astype(np.uint64)
        plus, minus, score = full.copy(), np.zeros(len(at), np.uint64), k.copy()
        best = k.copy()
        for j in range(b.shape[1]):
            live = j < size
            eq = met[row, where[:, j]]
            v = eq | minus
            h = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (~(h | plus) & full), plus & h
            score = np.where(live, score + ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64), score)
            best = np.where(live, np.minimum(best, score), best)
            up, down = ((up << one) | grow) & full, (down << one) & full
            plus, minus = np.where(live, down | (~(v | up) & full), plus), np.where(live, up & v, minus)
        out[at] = 2 * np.where(anywhere[at], best, score)
    return out


WORDS_AT_ONCE = 1 << 21  # 64-bit numbers that say where each character stands in the claims of a block


def infix_edits(claims: Sequence[str], reads: Sequence[str]) -> np.ndarray:
    """Edits of each claim to its best stretch of its reading, all substitutions alike: a column of the table is a row of 64-bit numbers, one for 64 characters of the claim."""
    out = np.array([len(c) for c in claims], np.int64)
    words = (out + 63) // 64
    n = np.array([len(r) for r in reads], np.int64)
    one, last = np.uint64(1), np.uint64(63)
    for w in np.unique(words[(words > 0) & (n > 0)]).tolist():
        own = np.flatnonzero((words == w) & (n > 0))
        own = own[np.argsort(n[own], kind="stable")]
        known = np.unique(np.frombuffer("".join({claims[i] for i in own.tolist()}).encode("utf-32-le", "surrogatepass"), np.int32))
        step = min(1 << 13, max(1, WORDS_AT_ONCE // ((len(known) + 1) * w)))
        for lo in range(0, len(own), step):
            at = own[lo : lo + step]
            a, k = codes([claims[i] for i in at.tolist()], -1)
            b, size = codes([reads[i] for i in at.tolist()], -2)
            row, place = np.arange(len(at)), np.searchsorted(known, a)
            met = np.zeros((w, len(known) + 1, len(at)), np.uint64)
            for i in range(a.shape[1]):
                some = np.flatnonzero(i < k)
                met[i // 64, place[some, i], some] |= one << np.uint64(i % 64)
            where = np.minimum(np.searchsorted(known, b), len(known) - 1)
            where = np.where(known[where] == b, where, len(known))
            top = ((k - 1) % 64).astype(np.uint64)
            plus, minus = np.full((w, len(at)), ~np.uint64(0)), np.zeros((w, len(at)), np.uint64)
            score, best = k.copy(), k.copy()
            for j in range(b.shape[1]):
                # What crosses into the lowest bit: a cell of the row above the claim costs nothing.
                more, less = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                for x in range(w):
                    eq, p, m = met[x, where[:, j], row], plus[x], minus[x]
                    v = eq | m
                    eq |= less
                    h = (((eq & p) + p) ^ p) | eq
                    up, down = m | ~(h | p), p & h
                    high = top if x == w - 1 else last
                    up_out, down_out = (up >> high) & one, (down >> high) & one
                    up, down = (up << one) | more, (down << one) | less
                    plus[x], minus[x] = down | ~(v | up), up & v
                    more, less = up_out, down_out
                score += more.astype(np.int64) - less.astype(np.int64)
                best = np.where(j < size, np.minimum(best, score), best)
            out[at] = best
    return out
