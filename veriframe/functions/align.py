"""Alignment kernels over normalized strings, in half edits.

A substitution of confusable characters costs ``cc`` half edits (0 to 2), any other edit 2.
The kernels keep one row of the table and are called once per pair inside Arrow batches.
"""

from __future__ import annotations

from functools import lru_cache

# Characters that readers confuse.
CONFUSABLE = ("O0", "D0", "Q0", "I1", "L1", "GC", "S5", "B8", "Z2", "UV")
ALIKE = frozenset(CONFUSABLE) | frozenset(p[::-1] for p in CONFUSABLE)


def substitution(a: str, b: str, cc: int) -> int:
    return 0 if a == b else cc if a + b in ALIKE else 2


# Confusable characters folded to one of their class.
_FOLD = str.maketrans("ODQILGSBZV", "00011C582U")


@lru_cache(1 << 16)
def _places(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_edits(claim: str, read: str, anywhere: bool) -> int:
    """A lower bound of the half edits to the reading, or to any stretch of it: twice the edits between the folded strings, bit-parallel."""
    a, b = claim.translate(_FOLD), read.translate(_FOLD)
    m = len(a)
    if not m:
        return 0 if anywhere else 2 * len(b)
    places = _places(a)
    full, top, grow = (1 << m) - 1, 1 << (m - 1), 0 if anywhere else 1
    plus, minus, score, best = full, 0, m, m
    for c in b:
        eq = places.get(c, 0)
        v = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (~(h | plus) & full), plus & h
        score += (up & top > 0) - (down & top > 0)
        up, down = (up << 1 | grow) & full, (down << 1) & full
        plus, minus = down | (~(v | up) & full), up & v
        if score < best:
            best = score
    return 2 * (best if anywhere else score)


def half_edits(claim: str, read: str, cc: int = 1, budget: int = -1) -> int:
    """Half edits between the strings; past a budget of 0 or more, the budget plus 1."""
    row = [2 * j for j in range(len(read) + 1)]
    for i, x in enumerate(claim, 1):
        diagonal, row[0] = row[0], 2 * i
        least = min(diagonal, row[0]) if not read else diagonal
        for j, y in enumerate(read, 1):
            up = row[j]
            row[j] = min(diagonal + substitution(x, y, cc), up + 2, row[j - 1] + 2)
            diagonal = up
            if row[j] < least:
                least = row[j]
        if 0 <= budget < min(least, row[0]):
            return budget + 1
    return row[-1]


def distance(claim: str, read: str, cc: int = 1) -> float:
    """Half edits as a share of the claim's own length; 1 for an empty claim."""
    return half_edits(claim, read, cc) / (2 * len(claim)) if claim else 1.0


def infix(claim: str, read: str, cc: int = 1) -> tuple[int, int, int]:
    """Half edits of the claim to its best stretch of the reading, and the stretch.

    Of equal paths the diagonal is taken first, then skipping a character of the claim, then one
    of the reading; of equal ends the first.
    """
    if not claim:
        return 0, 0, 0
    at = read.find(claim)
    if at >= 0:
        return 0, at, at + len(claim)
    cost, start = [0] * (len(read) + 1), list(range(len(read) + 1))
    for i, x in enumerate(claim, 1):
        c_diag, s_diag = cost[0], start[0]
        cost[0], start[0] = 2 * i, 0
        for j, y in enumerate(read, 1):
            c_up, s_up = cost[j], start[j]
            best, begin = c_diag + substitution(x, y, cc), s_diag
            if c_up + 2 < best:
                best, begin = c_up + 2, s_up
            if cost[j - 1] + 2 < best:
                best, begin = cost[j - 1] + 2, start[j - 1]
            cost[j], start[j] = best, begin
            c_diag, s_diag = c_up, s_up
    end = min(range(len(cost)), key=lambda j: (cost[j], j))
    return cost[end], start[end], end


def infix_distance(claim: str, read: str, cc: int = 1) -> float:
    return infix(claim, read, cc)[0] / (2 * len(claim)) if claim else 1.0


def common(read: str, want: str) -> int:
    """The longest common subsequence; confusable characters count as equal."""
    row = [0] * (len(want) + 1)
    for x in read:
        diagonal = 0
        for j, y in enumerate(want, 1):
            up = row[j]
            row[j] = diagonal + 1 if x == y or x + y in ALIKE else max(up, row[j - 1])
            diagonal = up
    return row[-1]


def agreement(read: str, want: str) -> tuple[float, float]:
    """The common subsequence as a share of the reading and of what was wanted."""
    if not read or not want:
        return 0.0, 0.0
    n = common(read, want)
    return n / len(read), n / len(want)


def prefix_distance(read: str, want: str, cc: int = 1) -> float:
    """The distance of a growing chain to the beginning of what is wanted."""
    if not read:
        return 1.0
    cut = read[: len(want)]
    return distance(cut, want[: len(cut) + 8], cc)


def ends_meet(claim: str, span: str, cc: int = 1) -> bool:
    """Whether the span begins and ends with the claim's own characters."""
    return bool(claim) and bool(span) and substitution(claim[0], span[0], cc) < 2 and substitution(claim[-1], span[-1], cc) < 2


def delimited(text: str, norm: str, offsets: list[int], start: int, stop: int) -> bool:
    """Whether a stretch of a normalized reading is delimited on both sides.

    The edge of the reading, an ASCII digit next to the stretch, or a dropped character other than
    white space between the neighbours delimit; white space alone does not.
    """
    return _free(text, norm, offsets, start - 1, start, start - 1) and _free(text, norm, offsets, stop - 1, stop, stop)


def _free(text: str, norm: str, offsets: list[int], left: int, right: int, neighbour: int) -> bool:
    if not 0 <= neighbour < len(norm) or "0" <= norm[neighbour] <= "9" or left < 0 or right >= len(offsets):
        return True
    gap = text[offsets[left] + 1 : offsets[right]]
    return any(not c.isspace() for c in gap)
