"""Distances between normalized strings as column expressions.

With a confusable substitution at one half edit, folding each confusable class to one character
gives a lower bound and the plain Levenshtein distance an upper bound of the weighted distance:
``2 lev(fold a, fold b) <= half edits <= 2 lev(a, b)``. Both run in generated code; where they
agree, which is nearly always, no alignment table is filled. Only the rest goes to Arrow functions, which fill
the tables of a whole batch at once (``batch.py``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from veriframe.functions import align, batch, text


def lower_bound(claim: Column, read: Column) -> Column:
    return 2 * F.levenshtein(text.class_fold(claim), text.class_fold(read))


def upper_bound(claim: Column, read: Column) -> Column:
    return 2 * F.levenshtein(claim, read)


def _exact(cc: int):
    @pandas_udf(IntegerType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield _of_both(a, b, lambda x, y: [batch.half_edits(x, y, cc)], ["cost"])["cost"]

    return run


def _of_both(a: pd.Series, b: pd.Series, kernel: Callable, names: list[str], kind: str = "Int32") -> pd.DataFrame:
    """What the kernel gives for the pairs of which both sides are there; null for the others."""
    there = (a.notna() & b.notna()).to_numpy()
    found = kernel(a[there].tolist(), b[there].tolist())
    out = pd.DataFrame({k: pd.array([None] * len(a), kind) for k in names})
    for k, x in zip(names, found, strict=True):
        out.loc[there, k] = x
    return out


def half_edits(claim: Column, read: Column, cc: int = 1) -> Column:
    """The weighted edit distance in half edits."""
    if cc == 2:
        return upper_bound(claim, read)
    if cc == 0:
        return _exact(0)(claim, read)
    low, high = lower_bound(claim, read), upper_bound(claim, read)
    # The function sees null, and does nothing, where the bounds agree.
    open_ = low < high
    rest = _exact(cc)(F.when(open_, claim), F.when(open_, read))
    return F.coalesce(rest, high).cast("int")


def distance(claim: Column, read: Column, cc: int = 1) -> Column:
    """Half edits as a share of the claim's own length; 1 for an empty claim."""
    return F.when(F.length(claim) == 0, F.lit(1.0)).otherwise(half_edits(claim, read, cc) / (2.0 * F.length(claim)))


INFIX = "struct<cost:int,start:int,stop:int>"


def infix(claim: Column, read: Column, cc: int = 1) -> Column:
    """The best stretch of the reading: its cost in half edits, start and stop. An exact hit costs no alignment."""
    at = F.position(claim, read)

    @pandas_udf(INFIX)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield _of_both(a, b, lambda x, y: batch.infix(x, y, cc), ["cost", "start", "stop"])

    hit = F.struct(F.lit(0).alias("cost"), (at - 1).cast("int").alias("start"), (at - 1 + F.length(claim)).cast("int").alias("stop"))
    missed = run(F.when(at == 0, claim), F.when(at == 0, read))
    return F.when(at > 0, hit).otherwise(missed)


@pandas_udf(StructType([StructField("agreement", DoubleType()), StructField("coverage", DoubleType())]))
def agreement(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The longest common subsequence as a share of the reading and of what was wanted; null counts as empty."""
    for a, b in batches:
        a, b = a.fillna(""), b.fillna("")
        n = batch.common(a.tolist(), b.tolist())
        some = np.minimum(a.str.len(), b.str.len()).to_numpy() > 0
        share = lambda x, some=some, n=n: np.where(some, n / np.maximum(x.str.len().to_numpy(), 1), 0.0)
        yield pd.DataFrame({"agreement": share(a), "coverage": share(b)})


@pandas_udf(DoubleType())
def prefix_distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The distance of a growing chain to the beginning of what is wanted; null counts as empty."""
    for a, b in batches:
        wants = b.fillna("").tolist()
        cuts = [x[: len(y)] for x, y in zip(a.fillna("").tolist(), wants, strict=True)]
        cost = batch.half_edits(cuts, [y[: len(x) + 8] for x, y in zip(cuts, wants, strict=True)], 1)
        size = np.array([len(x) for x in cuts], np.int64)
        yield pd.Series(np.where(size > 0, cost / (2.0 * np.maximum(size, 1)), 1.0))


def ends_meet(claim: Column, span: Column) -> Column:
    """The first and last characters are equal or confusable."""
    pairs = F.array(*[F.lit(p) for p in sorted(align.ALIKE)])
    same = lambda x, y: (x == y) | F.array_contains(pairs, F.concat(x, y))
    return (F.length(claim) > 0) & (F.length(span) > 0) & same(F.left(claim, F.lit(1)), F.left(span, F.lit(1))) & same(F.right(claim, F.lit(1)), F.right(span, F.lit(1)))
