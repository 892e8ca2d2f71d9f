"""Language-model scoring with Brown class bigrams.

Every training token is counted and every training word has a class; the numbers of classes and of
words that found them grow with the vocabulary. First the most frequent words are types of their
own, all other words belong to one of ``ENDINGS`` types by a hash of their last bytes, and exchange
clustering moves types between classes while the mutual information of adjacent classes grows. Then
each other word is exchanged alone against these classes: the classes beside it are counted, and it
moves to where the likelihood of its neighbours is largest. All words are done in parallel. The class of an ending
stays for words that training didn't see. The probability of a text is the product, over its tokens, of
the smoothed transition between classes and the smoothed emission of the word by its class.

A word's emission needs its count and class, and the vocabulary grows with the corpus. At most ``HEAD`` of
the most frequent words are broadcast; other tokens are sent by word to the table of counts and classes, and what they
add is summed per text. As predecessors, words outside the broadcast table have the class of their ending.
No word outside the broadcast table is more frequent than those inside, so none is a hot key.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import byte_texts, chunks, materialise, release, small_batches

HEAD = 1 << 18
LEVELS = 64  # of frequency in each doubling
ENDINGS = 384
END = ENDINGS  # the type of the end of a text; the types of the words of their own follow
END_WORD = "\n"  # no word holds white space
CLASSES, OWN = 32, 12  # at least so many classes, and so many words of their own for each
SWEEPS = 12
COUNTED_AT_ONCE = 250_000
ENTRIES_AT_ONCE = 1 << 11  # so that their gains stay in the cache
NEIGHBOUR_WORDS = 3 << 19  # of texts whose neighbours are added up before they are sent
NEIGHBOUR_ROWS = 1 << 16  # of a batch of these
BIGRAMS_AT_ONCE = 1 << 21
TRANSITION_PRIOR = 5.0
STAY = 1.0  # of the logarithm of the number of classes
UNIGRAM = 0.1  # weight of the class without its predecessor


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def classes_of(distinct: int) -> int:
    """The number of classes for so many different words: their cube root."""
    return max(CLASSES, round(distinct ** (1 / 3)))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, kind, c) of all tokens, the end among them; kind is the type by the word's ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        ends = 0

        def flush() -> pa.RecordBatch:
            words = list(seen)
            kind = [ending(w) for w in words]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(kind, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "kind", "c"])
            seen.clear()
            return out

        for b in chunks(batches):
            for t in byte_texts(b):
                seen.update(t.lower().split())
                ends += 1
            if len(seen) > COUNTED_AT_ONCE:
                yield flush()
        if seen:
            yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END_WORD]), pa.array([END], pa.int32()), pa.array([ends], pa.int64())], names=["word", "kind", "c"])

    return docs.mapInArrow(run, "word string, kind int, c long").groupBy("word", "kind").agg(F.sum("c").alias("c"))


class Encoder(dict):
    """Words to ids: those of the table, and -1 - ending for others, of which some are kept."""

    def __init__(self, table: dict[bytes, int]):
        super().__init__(table)
        self.table, self.most = table, len(table) + COUNTED_AT_ONCE

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
            self.update(self.table)
        self[word] = x = -1 - ending(word)
        return x


def encode(given: DataFrame, words: list[bytes]) -> DataFrame:
    """(key, doc_id, t, ids, outside) of each text: its words as places in ``words``, -1 - ending for others, and these others, a space between.

    The passes that follow read ids, so texts are cut into words twice: for the counts and here.
    """
    shared = given.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Encoder({w: k for k, w in enumerate(shared.value)})
        key = TaskContext.get().partitionId() << 36
        for b in chunks(batches):
            ids, outside = [], []
            for t in byte_texts(b):
                w = t.lower().split()
                at = np.fromiter(map(known.__getitem__, w), np.int32, len(w))
                ids.append(at.tobytes())
                outside.append(b" ".join([w[j] for j in np.flatnonzero(at < 0).tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + len(ids))), b.column(0), b.column(2), pa.array(ids, pa.binary()), pa.array(outside, pa.binary())], names=["key", "doc_id", "t", "ids", "outside"])
            key += len(ids)

    return materialise(given.select("doc_id", "text", "t").mapInArrow(run, "key long, doc_id long, t boolean, ids binary, outside binary"))


def by_id(head: np.ndarray, endings: np.ndarray, end: int) -> np.ndarray:
    """A table that ids of words, their number for an end, and negative ids of endings are places of."""
    return np.concatenate((head, [end], endings[::-1]))


def texts_of(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a column, an ``end`` after each, and how many words each has."""
    rows = column.to_pylist()
    one = np.array([end], np.int32).tobytes()
    return np.frombuffer(one.join([*rows, b""]), np.int32), np.array([len(x) // 4 for x in rows], np.int64)


def count_bigrams(texts: DataFrame, kinds: np.ndarray, types: int, end: int) -> np.ndarray:
    """Adjacent types (``kinds`` of the ids) of all encoded texts; a text begins after an end."""
    shared = texts.sparkSession.sparkContext.broadcast(kinds.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = shared.value
        total = np.zeros(types * types, np.int64)
        codes: list[np.ndarray] = []

        def add() -> None:
            if codes:  # the table is large, so it is not passed over for each batch
                np.add(total, np.bincount(np.concatenate(codes), minlength=types * types), out=total)
                codes.clear()

        for b in batches:
            if not b.num_rows:
                continue
            a = np.concatenate(([END], kinds[texts_of(b.column(0), end)[0]]))
            codes.append(a[:-1] * types + a[1:])
            if sum(map(len, codes)) >= BIGRAMS_AT_ONCE:
                add()
        add()
        release()
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    found = texts.select("ids").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(types * types, np.int64)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(types, types)


def count_neighbours(texts: DataFrame, words: list[bytes], kinds: np.ndarray, cls: np.ndarray, classes: int) -> DataFrame:
    """(word, codes, ns) for words that are no types: how often a class (code) stands before, or (code - classes) after it."""
    shared = texts.sparkSession.sparkContext.broadcast((words, kinds < ENDINGS, cls[kinds].astype(np.int64), int(cls[END])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, loose, class_of, end_class = shared.value
        end = len(words)
        head = pa.array(words, pa.binary())
        local: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, list[int]]] = []

        def added_up() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([x for x, _ in held]).astype(np.int64)
            c = np.concatenate(([end_class], class_of[ids]))
            inner = np.flatnonzero(loose[ids])
            ids[ids < 0] = end + 1 + np.array([k for _, x in held for k in x], np.int64)
            a = ids[inner] * (2 * classes)
            pair, n = np.unique(np.concatenate((a + c[inner], a + classes + c[inner + 2])), return_counts=True)
            if len(pair):
                at = pair // (2 * classes)
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                named = pa.concat_arrays([head, pa.array([END_WORD.encode()], pa.binary()), pa.array(list(local), pa.binary())])
                word = named.take(pa.array(at[first])).cast(pa.string())
                off = pa.array(np.append(first, len(at)).astype(np.int32))
                code, count = pa.array((pair % (2 * classes)).astype(np.int32)), pa.array(n.astype(np.int32))
                out = pa.RecordBatch.from_arrays([word, pa.ListArray.from_arrays(off, code), pa.ListArray.from_arrays(off, count)], names=["word", "codes", "ns"])
                for lo in range(0, out.num_rows, NEIGHBOUR_ROWS):
                    yield out.slice(lo, NEIGHBOUR_ROWS)

        for b in batches:
            if not b.num_rows:
                continue
            held.append((texts_of(b.column(0), end)[0], [local.setdefault(w, len(local)) for x in b.column(1).to_pylist() for w in x.split()]))
            if sum(len(x) for x, _ in held) >= NEIGHBOUR_WORDS:
                yield from added_up()
                local.clear()
                held.clear()
        if held:
            yield from added_up()
        release()

    return texts.select("ids", "outside").mapInArrow(run, "word string, codes array<int>, ns array<int>")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of neighbours in slices of about ``ENTRIES_AT_ONCE`` entries, each of which is weighed for every class."""
    for b in batches:
        ends = np.cumsum(pa.compute.list_value_length(b.column(1)).to_numpy())
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ENTRIES_AT_ONCE, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def assign(neighbours: DataFrame, big: np.ndarray, cls: np.ndarray) -> DataFrame:
    """(word, k, c): each word's class by exchange against fixed classes with the transitions ``big``, and its count.

    A word leaves the class of its ending if it gains more than naming another class costs.
    """
    classes = len(big)
    log = np.log(big + 0.1 / classes)
    size = np.log(big.sum(0) + 0.5)
    # Before the word: the transition into its class and its emission. After it: the transition out of its class.
    gain = np.concatenate((log - size, log.T - np.log(big.sum(1) + 0.5)))
    stay = STAY * np.log(classes)
    shared = neighbours.sparkSession.sparkContext.broadcast((gain, cls[:ENDINGS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, by_ending = shared.value
        last, best, count = None, np.zeros(classes), 0
        room = np.empty((ENTRIES_AT_ONCE, classes))

        def rows(words: list, total: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            total[np.arange(len(words)), by_ending[[ending(w.encode()) for w in words]]] += stay
            k = total.argmax(1)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(k.astype(np.int32)), pa.array(c.astype(np.int64))], names=["word", "k", "c"])

        for b in pieces(batches):
            run_ends = pa.compute.run_end_encode(b.column(0), run_end_type=pa.int32())
            words = run_ends.values.to_pylist()
            ends = run_ends.run_ends.to_numpy()
            first = np.concatenate(([0], ends[:-1]))
            code, n = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy().astype(np.int64)
            # Rows of a word follow each other, and so do their entries.
            first = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(b.column(1)).to_numpy())))[first]
            weighed = room[: len(code)] if len(code) <= len(room) else np.empty((len(code), classes))
            np.take(gain, code, axis=0, out=weighed, mode="clip")
            weighed *= n[:, None]
            total = np.add.reduceat(weighed, first)
            c = np.add.reduceat(np.where(code < classes, n, 0), first)
            if words[0] == last:
                total[0] += best
                c[0] += count
            elif last is not None:
                yield rows([last], best[None], np.array([count]))
            if len(words) > 1:
                yield rows(words[:-1], total[:-1], c[:-1])
            last, best, count = words[-1], total[-1], int(c[-1])
        if last is not None:
            yield rows([last], best[None], np.array([count]))

    parts = int(neighbours.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return neighbours.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(run, "word string, k int, c long")


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each type: each in turn moves to where the mutual information of adjacent classes is largest."""
    n = n.astype(np.float64)
    types = len(n)
    order = np.argsort(-n.sum(1), kind="stable")
    c = np.zeros(types, np.int64)
    c[order] = np.arange(types) % classes
    one = np.zeros((types, classes))
    one[np.arange(types), c] = 1
    big = one.T @ n @ one
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            if not n[w].any() and not n[:, w].any():
                continue
            a, s = int(c[w]), n[w, w]
            r = np.bincount(c, n[w], classes)
            left = np.bincount(c, n[:, w], classes)
            r[a] -= s
            left[a] -= s
            big[a] -= r
            big[:, a] -= left
            big[a, a] -= s
            # With w in class b: its row, its column, and where they cross.
            rows, cols = big + r, big.T + left
            gain = (_g(rows) - _g(big)).sum(1) + (_g(cols) - _g(big.T)).sum(1)
            d = np.arange(classes)
            diag = big[d, d]
            gain += _g(diag + r + left + s) - _g(diag + r) - _g(diag + left) + _g(diag)
            out, into = big.sum(1), big.sum(0)
            gain -= _g(out + r.sum() + s + left) - _g(out) + _g(into + left.sum() + s + r) - _g(into)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            c[w] = b
            big[b] += r
            big[:, b] += left
            big[b, b] += s
        if not moved:
            break
    return c


def steps_of(path: bytes, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes before and at each token of the table; a text begins after an end."""
    p = np.frombuffer(path, np.int16).astype(np.int64)
    before = np.concatenate(([end], np.where(p < 0, p + (1 << 15), p)[:-1]))
    return before[p >= 0], p[p >= 0]


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    ``train`` says which rows are learnt from. Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased
    (A-Z) text, then one end. Null and empty texts are an end alone; repeated rows are counted and
    scored each; texts of any length are read whole; rows without an id are scored too. Without a
    training row every count is 0.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), train.alias("t"))
    learnt = given.filter(F.coalesce("t", F.lit(False))).select("text")
    counts = materialise(count_words(learnt))
    tokens, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == END_WORD, F.col("c"))), F.lit(0))).first()
    # The head by level of frequency: as many levels from the top as hold at most HEAD words.
    level = F.floor(F.log2("c") * LEVELS).cast("int")
    inside, cut = 0, 1 << 30
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if inside + r.n > HEAD:
            break
        inside, cut = inside + r.n, r.level
    n_classes = classes_of(distinct)
    own: dict[bytes, int] = {}
    head = counts.filter(level >= cut).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, c = [w.encode() for w in head["word"].to_pylist()], head["c"].to_numpy()
    for w in head["word"].slice(0, OWN * n_classes + 1).to_pylist():
        if w != END_WORD and len(own) < OWN * n_classes:
            own[w.encode()] = END + 1 + len(own)
    texts = encode(given, words)
    training, end = texts.filter(F.coalesce("t", F.lit(False))), len(words)
    kinds = by_id(np.array([own[w] if w in own else END if w == END_WORD.encode() else ending(w) for w in words], np.int64), np.arange(ENDINGS), END)
    pairs = count_bigrams(training, kinds, END + 1 + len(own), end)
    cls = exchange(pairs, n_classes)
    one = np.zeros((len(pairs), n_classes))
    one[np.arange(len(pairs)), cls] = 1
    seed_class = {w: int(cls[k]) for w, k in own.items()} | {END_WORD.encode(): int(cls[END])}
    alone = materialise(assign(count_neighbours(training, words, kinds, cls, n_classes), one.T @ pairs @ one, cls))
    class_of_word = alone.filter(level >= cut).select("word", "k").toArrow()
    seed_class.update(zip((w.encode() for w in class_of_word["word"].to_pylist()), class_of_word["k"].to_pylist(), strict=True))
    class_of = np.array([seed_class[w] for w in words], np.int64)
    size, kinds_of = np.zeros(n_classes), np.zeros(n_classes)
    for r in alone.filter(level < cut).groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        size[r.k], kinds_of[r.k] = r.c, r.n
    size += np.bincount(class_of, c, n_classes)
    kinds_of += np.bincount(class_of, minlength=n_classes)
    if ends and END_WORD not in head["word"].to_pylist():
        size[cls[END]] += ends
        kinds_of[cls[END]] += 1
    log_c = by_id(np.log10(c + 0.5), np.zeros(ENDINGS), float(np.log10(ends + 0.5)))
    tables = spark.sparkContext.broadcast((log_c, by_id(class_of, cls[:ENDINGS], int(cls[END])).astype(np.int64)))
    end_known, end_class = int(ends > 0), int(cls[END])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with the classes of its tokens (of the ending, less 2**15, outside the table), and one for each predecessor and token outside."""
        log_c, class_of = tables.value
        names = ["key", "doc_id", "learn", "word", "m", "n_tokens", "n_known", "s", "before", "path"]
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys, learn = b.column(0).to_numpy(), np.array([bool(x) for x in b.column(2).to_pylist()])
            ids, sizes = texts_of(b.column(3), end)
            starts = np.concatenate(([0], np.cumsum(sizes + 1)))
            k = class_of[ids]
            out = np.flatnonzero(ids < 0)
            before = np.concatenate(([end_class], k))[out]
            text = np.repeat(np.arange(n), sizes + 1)[out]
            k[out] -= 1 << 15
            path = k.astype(np.int16).tobytes()
            known = sizes - np.bincount(text, minlength=n) + end_known
            none = lambda value, kind, size: pa.array(np.full(size, value), kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), b.column(1), pa.array(learn, pa.bool_()), pa.array([f" {x}" for x in keys.tolist()], pa.string()), none(0, pa.int32(), n), pa.array((sizes + 1).astype(np.int32)), pa.array(known.astype(np.int32)), pa.array(np.add.reduceat(log_c[ids], starts[:-1])), none(-1, pa.int32(), n), pa.array([path[2 * x : 2 * y] for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())],
                names=names,
            )
            if len(out):
                local: dict[bytes, int] = {}
                word = np.array([local.setdefault(w, len(local)) for x in b.column(4).to_pylist() for w in x.split()], np.int64)
                code, times = np.unique((text * len(local) + word) * n_classes + before, return_counts=True)
                text, word, more = code // n_classes // len(local), code // n_classes % len(local), len(code)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[text]), pa.nulls(more, pa.int64()), pa.array(learn[text]), pa.array(list(local), pa.binary()).take(pa.array(word)).cast(pa.string()), pa.array(times.astype(np.int32)), none(0, pa.int32(), more), none(0, pa.int32(), more), none(0.0, pa.float64(), more), pa.array((code % n_classes).astype(np.int32)), pa.nulls(more, pa.binary())],
                    names=names,
                )

    parts = materialise(texts.mapInArrow(paths, "key long, doc_id long, learn boolean, word string, m int, n_tokens int, n_known int, s double, before int, path binary"))
    whole_texts = parts.filter("m = 0")
    outside = parts.filter("m > 0").select("key", "learn", "word", "m", "before")
    rare = alone.filter(level < cut)
    met = outside.join(rare, "word", "left") if inside < distinct else outside.withColumn("k", F.lit(None).cast("int")).withColumn("c", F.lit(None).cast("long"))
    # A word that training didn't see has the class of its ending.
    by_ending = F.array(*[F.lit(int(x)) for x in cls[:ENDINGS]])
    met = materialise(met.withColumn("k", F.coalesce("k", F.get(by_ending, (F.crc32(F.expr("substr(cast(word as binary), -3)")) % ENDINGS).cast("int")))))

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes * n_classes, np.int64)
        for b in batches:
            for p in b.column(0).to_pylist():
                before, after = steps_of(p, int(cls[END]))
                total += np.bincount(before * n_classes + after, minlength=n_classes * n_classes)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    inner = whole_texts.filter("learn").select("path").mapInArrow(transitions, "pair int, n long")
    outer = met.filter("learn").select((F.col("before") * n_classes + F.col("k")).alias("pair"), F.col("m").cast("long").alias("n"))
    big = np.zeros(n_classes * n_classes)
    for r in inner.unionByName(outer).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        big[r.pair] = r.n
    big = big.reshape(n_classes, n_classes)
    share = (size + 0.5) / (size.sum() + 0.5 * n_classes)
    follow = (big + TRANSITION_PRIOR * share) / (big.sum(1, keepdims=True) + TRANSITION_PRIOR)
    step = np.log10((1 - UNIGRAM) * follow + UNIGRAM * share) - np.log10(size + 0.5 * (kinds_of + 1))
    whole = float(np.log10(tokens + 0.5 * (distinct + 1)))
    model = spark.sparkContext.broadcast(step)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = model.value
        for b in batches:
            rest = [float(step[steps_of(p, int(cls[END]))].sum()) for p in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(5), pa.array(rest, pa.float64())], names=["key", "doc_id", "n_tokens", "n_known", "s", "rest"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = model.value
        for b in batches:
            rest = step[b.column(1).to_numpy(), b.column(2).to_numpy()] * b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), b.column(5), pa.array(rest)], names=["key", "n_known", "s", "rest"])

    texts = whole_texts.select("key", "doc_id", "n_tokens", "n_known", "path", "s").mapInArrow(walk, "key long, doc_id long, n_tokens int, n_known int, s double, rest double")
    more = met.select("key", "before", "k", "m", F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0).alias("n_known"), (F.col("m") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)).alias("s")).mapInArrow(single, "key long, n_known int, s double, rest double")
    both = texts.unionByName(more, allowMissingColumns=True)
    summed = both.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("s").alias("s"), F.sum("rest").alias("rest"))
    return summed.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("s") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("s") + F.col("rest")).alias("score"))
