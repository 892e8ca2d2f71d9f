"""Spellings meet the readings of their labels, in buckets of labels.

A list of spellings that many claims share comes once to a bucket, however many claims of the bucket have it, and equal readings
are judged once. A spelling that allows so many edits is cut into one piece more, of which one is left as it is by any
reading within the budget (confusable characters are folded first, so they cost no piece); pieces and the stretches of
readings meet as numbers within the task, so they are never written anywhere. Only the best pairs of a claim leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from veriframe.functions import align

SPELLING, LINK, READING = 0, 1, 2  # kinds of rows, in the order in which a bucket needs them
COLUMNS = {SPELLING: ("spellings", "set"), LINK: ("links", "label"), READING: ("readings", "label")}
CLAIMS = 1 << 15  # of a bucket
READINGS = 1 << 15  # that are judged at once
PAIRS = 1 << 16  # that are aligned at once
STEPS = 1 << 22  # pieces that are looked up at once
ROLES = ("is_exact", "is_own", "is_near", "is_other")

_FOLD = np.arange(128, dtype=np.uint32)
for _a, _b in align._FOLD.items():
    _FOLD[_a] = ord(_b) if isinstance(_b, str) else _b
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TOP = np.uint64(44)
# Characters that the bound by classes counts.
_CLASSES = "0123456789ACEFHJKMNPRTUWXY"
_CLASS = np.full(129, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[ord(_c)] = _i

Match = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


def expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches that begin at ``first``: which one each element belongs to, and where it is."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def numbered(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the distinct rows."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        known, k = np.unique(c, return_inverse=True)
        out = np.unique(out * max(1, len(known)) + k, return_inverse=True)[1]
    return out


def held(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is one of ``known``, which are in order, and its place there."""
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    return (known[at] == keys) if len(known) else np.zeros(len(keys), bool), at


def places(column: pa.ChunkedArray, of: pa.Array) -> np.ndarray:
    """The place of each value in ``of``, -1 for others."""
    return pc.fill_null(pc.index_in(column, value_set=of), -1).to_numpy().astype(np.int64)


def distinct(column: pa.ChunkedArray) -> pa.Array:
    return pc.unique(column).drop_null()


class Folded:
    """Strings with confusable characters folded, end to end."""

    def __init__(self, strings: list[str]) -> None:
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = np.where(codes < 128, _FOLD[np.minimum(codes, 127)], codes)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def stretches(self, q: int) -> np.ndarray:
        """A number for the ``q`` characters from each place on."""
        n = max(0, len(self.codes) - q + 1)
        h = np.full(n, q, np.uint64)
        for j in range(q):
            h = h * _BASE + self.codes[j : j + n]
        h ^= h >> np.uint64(29)
        return h * _MIX

    def classes(self) -> np.ndarray:
        """How many characters of each class each string has."""
        of = _CLASS[np.minimum(self.codes, 128)]
        k = len(_CLASSES) + 1
        owner = np.repeat(np.arange(len(self.size)), self.size)
        return np.bincount(owner * k + of, minlength=len(self.size) * k).reshape(-1, k)[:, :-1].astype(np.int16)


def sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(keys.astype(np.uint64) * _MIX >> _TOP).astype(np.int64)] = True
    return out


def passes(keys: np.ndarray, by: np.ndarray) -> np.ndarray:
    return by[(keys.astype(np.uint64) * _MIX >> _TOP).astype(np.int64)]


def best(group: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Places of the rows that are first of their group by ``ranks``, all that are equal."""
    if not len(group):
        return np.zeros(0, np.int64)
    order = np.lexsort((*ranks[::-1], group))
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    same = np.ones(len(order), bool)
    for r in ranks:
        same &= r[order] == r[first]
    return order[same]


class Bucket:
    """Spellings and claims of a bucket, and the index of pieces."""

    def __init__(self, spellings: pa.Table, links: pa.Table, match: Match, margin: float) -> None:
        self.match, self.margin, self.spellings, self.links = match, margin, spellings.combine_chunks(), links.combine_chunks()
        sets = distinct(links["set"])
        of_link, of_row = places(links["set"], sets), places(spellings["set"], sets)
        order = np.argsort(of_row, kind="stable")
        first = np.searchsorted(of_row[order], np.arange(len(sets)))
        count = np.searchsorted(of_row[order], np.arange(len(sets)), "right") - first
        number = lambda c: links[c].to_numpy().astype(np.float64)
        radius, reach, want, tolerance = (number(c) for c in ("radius", "reach", "want", "tolerance"))
        # A group has one list of spellings and one radius; of values that aren't claimed also one filed value.
        self.group = numbered(of_link, radius, want, tolerance)
        one = np.unique(self.group, return_index=True)[1]
        self.radius = radius[one]
        group, at = expanded(first[of_link[one]], count[of_link[one]])
        row = order[at]
        value = spellings["value"].to_numpy().astype(np.float64)
        other = ~np.isnan(want[one])
        keep = ~other[group] | (np.abs(value[row] - want[one][group]) > tolerance[one][group])
        self.g, self.row = group[keep], row[keep]
        self.of_link, self.other_link = of_link, ~np.isnan(want)

        norms, self.form = spellings["norm"].to_pylist(), spellings["form"].to_numpy().astype(np.int64)
        folded = Folded(norms)
        self.norms, self.claimed, self.cand = norms, spellings["claimed"].to_numpy(zero_copy_only=False).astype(bool), spellings["cand_idx"].to_numpy().astype(np.int64)
        self.classes = folded.classes()
        self.n = folded.size[self.row]
        self.reach = reach[one][self.g]
        self.budget = np.floor(self.reach * 2 * self.n + 1e-9).astype(np.int64)
        self.numbers = distinct(spellings["num"])
        self.num = places(spellings["num"], self.numbers)
        self.bare = self.num == (self.numbers.to_pylist().index("") if "" in self.numbers.to_pylist() else -2)
        self.link_num = places(links["num"], self.numbers)
        # Entries of one text, one form and one budget are one for the alignment.
        texts = pc.index_in(spellings["norm"], value_set=distinct(spellings["norm"])).to_numpy().astype(np.int64)
        self.alike = numbered(texts[self.row], self.form[self.row], self.budget)
        self.speaker = np.unique(self.alike, return_index=True)[1]

        pieces = self.budget // 2 + 1
        q = self.n // pieces
        self.lengths = [int(x) for x in np.unique(q[q > 0])]
        hashes, entries = [], []
        for x in self.lengths:
            own = np.flatnonzero(q == x)
            i, k = expanded(np.zeros(len(own), np.int64), pieces[own])
            e = own[i]
            hashes.append(folded.stretches(x)[folded.first[self.row[e]] + k * self.n[e] // pieces[e]])
            entries.append(e)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        e = np.concatenate(entries) if entries else np.zeros(0, np.int64)
        self.known, piece = np.unique(h, return_inverse=True)
        self.groups = len(one)
        # (piece, group) in order, and the entries of each; a piece that a spelling has twice counts once.
        every = max(1, len(self.g))
        key = np.unique((piece * self.groups + self.g[e]) * every + e)
        self.keys, self.key_first, self.key_count = np.unique(key // every, return_index=True, return_counts=True)
        self.key_entry = key % every
        self.of_pieces, self.of_keys = sieve(self.known), sieve(self.keys)
        free = np.flatnonzero(q == 0)
        self.free = free[np.argsort(self.g[free], kind="stable")]
        self.free_first = np.searchsorted(self.g[self.free], np.arange(self.groups))
        self.free_count = np.searchsorted(self.g[self.free], np.arange(self.groups), "right") - self.free_first

        self.labels = distinct(links["label"])
        own = places(links["label"], self.labels)
        self.by_label = np.argsort(own, kind="stable")
        self.label_first = np.searchsorted(own[self.by_label], np.arange(len(self.labels)))
        self.label_count = np.searchsorted(own[self.by_label], np.arange(len(self.labels)), "right") - self.label_first
        claims = distinct(links["claim"])
        self.claim = own * max(1, len(claims)) + places(links["claim"], claims)
        self.filed = dict(zip(self.claim[~self.other_link].tolist(), of_link[~self.other_link].tolist(), strict=True))
        self.first, self.count, self.order = first, count, order
        self.shapes: dict[int, dict[int, tuple[int, list[str]]]] = {}
        self.judged: dict[tuple[int, int, str], tuple[bool, int | None]] = {}

    def met(self, readings: Folded, of_group: np.ndarray, of_reading: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pair, entry): entries of the pair's group of which the pair's reading holds a piece."""
        total = len(readings.size)
        found = []
        for x in self.lengths:
            h = readings.stretches(x)
            owner = np.repeat(np.arange(total), readings.size)[: len(h)]
            inside = np.arange(len(h)) + x <= (readings.first + readings.size)[owner]
            some = np.flatnonzero(inside & passes(h, self.of_pieces))
            there, at = held(h[some], self.known)
            found.append(owner[some][there] * len(self.known) + at[there])
        met = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        reading, piece = met // max(1, len(self.known)), met % max(1, len(self.known))
        first = np.searchsorted(reading, np.arange(total))
        count = np.searchsorted(reading, np.arange(total), "right") - first
        ends = np.cumsum(count[of_reading])
        lo = 0
        while lo < len(of_reading):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEPS, "right")))
            pair, at = expanded(first[of_reading[lo:hi]], count[of_reading[lo:hi]])
            pair += lo
            key = piece[at] * self.groups + of_group[pair]
            some = np.flatnonzero(passes(key, self.of_keys))
            there, place = held(key[some], self.keys)
            pair, place = pair[some][there], place[there]
            # A pair that is cut here may come twice, which changes nothing.
            at = np.cumsum(self.key_count[place])
            cuts = np.unique(np.searchsorted(at, np.arange(0, int(at[-1]) + STEPS, STEPS))) if len(at) else []
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=False):
                i, e = expanded(self.key_first[place[a:b]], self.key_count[place[a:b]])
                both = np.unique(pair[a:b][i] * len(self.g) + self.key_entry[e])
                yield both // len(self.g), both % len(self.g)
            lo = hi
        for lo in range(0, len(of_group) if len(self.free) else 0, PAIRS):
            i, e = expanded(self.free_first[of_group[lo : lo + PAIRS]], self.free_count[of_group[lo : lo + PAIRS]])
            yield lo + i, self.free[e]

    def shape(self, i: int, row: int) -> tuple[bool, int | None]:
        """Whether a value's figure is part of one of the filed value's in the same form, or holds it; and the shortest of these."""
        of_set, form, num = self.filed.get(int(self.claim[i]), -1), int(self.form[row]), self.spellings["num"][row].as_py()
        if of_set < 0:
            return False, None
        key = (of_set, form, num)
        if key not in self.judged:
            if of_set not in self.shapes:
                forms: dict[int, tuple[int, list[str]]] = {}
                for r in self.order[self.first[of_set] : self.first[of_set] + self.count[of_set]].tolist():
                    if self.claimed[r]:
                        least, nums = forms.get(int(self.form[r]), (1 << 30, []))
                        forms[int(self.form[r])] = (min(least, len(self.norms[r])), [*nums, self.spellings["num"][r].as_py()])
                self.shapes[of_set] = forms
            least, nums = self.shapes[of_set].get(form, (None, []))
            self.judged[key] = (num != "" and any(x != "" and (num in x or x in num) for x in nums), least)
        return self.judged[key]

    def verdict_rows(self, readings: pa.Table, names: list[str]) -> pa.Table | None:
        """The best pairs of each claim and role among ``readings``."""
        label = places(readings["label"], self.labels)
        readings = readings.filter(pa.array(label >= 0)).combine_chunks()
        label = label[label >= 0]
        if not len(label):
            return None
        ints = lambda c: readings[c].to_numpy().astype(np.int64)
        text = pc.index_in(readings["text"], value_set=distinct(readings["text"])).to_numpy().astype(np.int64)
        uid = numbered(text, ints("parts"), ints("widest"))
        one = np.unique(uid, return_index=True)[1]
        texts, norms = readings["text"].take(one).to_pylist(), readings["norm"].take(one).to_pylist()
        parts, widest = ints("parts")[one], ints("widest")[one]
        folded = Folded(norms)
        size, classes = folded.size, folded.classes()
        lists = readings["nums"].take(one).combine_chunks()
        k = max(1, len(self.numbers))
        figure = places(pc.list_flatten(lists), self.numbers)
        figures = np.unique((pc.list_parent_indices(lists).to_numpy().astype(np.int64) * k + figure)[figure >= 0])

        reading, at = expanded(self.label_first[label], self.label_count[label])
        link = self.by_label[at]
        other = self.other_link[link]
        keep = ~other | ((self.link_num[link] >= 0) & held(uid[reading] * k + self.link_num[link], figures)[0])
        reading, link = reading[keep], link[keep]
        pairs, pair_of = np.unique(self.group[link] * len(one) + uid[reading], return_inverse=True)
        of_group, of_reading = pairs // len(one), pairs % len(one)

        rows: list[tuple[np.ndarray, ...]] = []
        for pair, entry in self.met(folded, of_group, of_reading):
            r, n = of_reading[pair], self.n[entry]
            slack = self.reach[entry] * n
            inside = (self.form[self.row[entry]] >= 0) | ((n < size[r]) & (size[r] <= 3 * n + 24) & ((parts[r] == 1) | (n > widest[r])))
            ok = np.flatnonzero((size[r] >= n * (1 - self.reach[entry])) & (inside | (size[r] <= n + slack)))
            pair, entry, r = pair[ok], entry[ok], r[ok]
            for lo in range(0, len(pair), PAIRS):
                p, e, x = pair[lo : lo + PAIRS], entry[lo : lo + PAIRS], r[lo : lo + PAIRS]
                lacking = np.maximum(self.classes[self.row[e]] - classes[x], 0).sum(axis=1)
                ok = np.flatnonzero(2 * lacking <= self.budget[e])
                p, e, x = p[ok], e[ok], x[ok]
                alike, back = np.unique(self.alike[e] * len(one) + x, return_inverse=True)
                s, y = self.speaker[alike // len(one)], alike % len(one)
                own, ys = self.row[s].tolist(), y.tolist()
                cost, start, stop = self.match([self.norms[i] for i in own], self.form[self.row[s]], [texts[i] for i in ys], [norms[i] for i in ys], parts[y], widest[y], self.budget[s])
                dist = cost / (2.0 * self.n[s])
                cost, start, stop, dist = cost[back], start[back], stop[back], dist[back]
                ok = np.flatnonzero(dist <= self.reach[e])
                rows.append((p[ok], e[ok], dist[ok], start[ok], stop[ok]))
        if not rows:
            return None
        pair, entry, dist, start, stop = (np.concatenate(c) for c in zip(*rows, strict=True))
        row, radius = self.row[entry], self.radius[self.g[entry]]
        holds = self.bare[row] | held(of_reading[pair] * k + self.num[row], figures)[0]
        claimed = self.claimed[row]
        roles = [claimed & holds & (dist <= radius), claimed & (dist <= radius + self.margin), claimed & holds & (dist <= 2 * radius), ~claimed & holds & (dist <= radius)]
        ranks = [dist, -self.n[entry], stop - start, self.cand[row]]

        def leading(group: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Of rows that show the results ``at``: those that are best in a role."""
            out = np.zeros(len(at), bool)
            for role in roles:
                own = np.flatnonzero(role[at])
                out[own[best(group[own], [r[at[own]] for r in ranks])]] = True
            return np.flatnonzero(out)

        # The best of a list of spellings for a reading, then of a claim over its readings.
        top = leading(pair, np.arange(len(pair)))
        top = top[np.argsort(pair[top], kind="stable")]
        first = np.searchsorted(pair[top], pair_of)
        i, at = expanded(first, np.searchsorted(pair[top], pair_of, "right") - first)
        reading, link, at = reading[i], link[i], top[at]
        last = leading(self.claim[link], at)
        reading, link, at = reading[last], link[last], at[last]
        if not len(at):
            return None
        row = row[at]
        shapes = [self.shape(int(i), int(r)) if o else (False, None) for i, r, o in zip(link, row, roles[3][at].tolist(), strict=True)]
        of = {"label": self.links["label"].take(link), "claim": self.links["claim"].take(link), "cand_idx": self.spellings["cand_idx"].take(row), "ctext": self.spellings["text"].take(row), "len": pa.array(self.n[entry[at]].astype(np.int32))}
        of |= {c: self.spellings[c].take(row) for c in ("name", "num", "form")}
        of |= {c: readings[c].take(reading) for c in ("path", "box", "text", "confidence", "parts")}
        of |= {"dist": pa.array(dist[at]), "start": pa.array(start[at].astype(np.int32)), "stop": pa.array(stop[at].astype(np.int32))}
        of |= {c: pa.array(r[at]) for c, r in zip(ROLES, roles, strict=True)}
        of |= {"dropped": pa.array([s[0] for s in shapes], pa.bool_()), "shortest": pa.array([s[1] for s in shapes], pa.int32())}
        return pa.table([of[c] for c in names], names)


def unpacked(rows: pa.Table, column: str, key: str) -> pa.Table:
    """A row for each element of the arrays of structs in ``column``, with ``key``."""
    lists = pa.concat_arrays(rows[column].chunks)
    fields = lists.type.value_type
    return pa.table([rows[key].take(pc.list_parent_indices(lists)), *pc.list_flatten(lists).flatten()], [key, *[fields.field(i).name for i in range(fields.num_fields)]])


def meeting(match: Match, margin: float, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (bucket, kind, and set and spellings, label and links, or label and readings) in order of bucket and kind: the best pairs, with columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        waiting: dict[int, list[pa.Table]] = {SPELLING: [], LINK: [], READING: []}

        def judged() -> Iterator[pa.RecordBatch]:
            nonlocal index
            if waiting[SPELLING] and waiting[LINK] and waiting[READING]:
                if index is None:
                    index = Bucket(pa.concat_tables(waiting[SPELLING]), pa.concat_tables(waiting[LINK]), match, margin)
                every = pa.concat_tables(waiting[READING])
                for lo in range(0, every.num_rows, READINGS):
                    out = index.verdict_rows(every.slice(lo, READINGS), names)
                    if out is not None:
                        yield from out.to_batches(max_chunksize=10000)
            waiting[READING].clear()

        for b in batches:
            t = pa.Table.from_batches([b])
            key = t["bucket"].to_numpy().astype(np.int64) * 4 + t["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                bucket, kind = divmod(int(key[lo]), 4)
                if bucket != now:
                    yield from judged()
                    now, index = bucket, None
                    waiting[SPELLING].clear()
                    waiting[LINK].clear()
                waiting[kind].append(unpacked(t.slice(lo, hi - lo), *COLUMNS[kind]))
                if kind == READING and sum(x.num_rows for x in waiting[READING]) >= READINGS:
                    yield from judged()
        yield from judged()

    return run
