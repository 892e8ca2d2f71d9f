"""Verdicts against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veriframe.staging import staged


def want(claim: Column, carried: Column, error: Column, abv: Column, net_ml: Column, class_: Column) -> Column:
    """``correct``, ``wrong`` or ``missing``: what the printed label implies for a claim.

    ``carried`` is a map from claims to ``=`` (as filed) or what is printed instead.
    """
    here = carried[claim]
    err = F.coalesce(error, F.lit(""))
    missing = ((claim == "abv") & (F.coalesce(abv, F.lit(0.0)) == 0)) | ((claim == "net") & (F.coalesce(net_ml, F.lit(0.0)) == 0)) | ((claim == "class") & (F.coalesce(class_, F.lit("")) == ""))
    wrong = claim.isin("abv", "net", "class", "brand") & (err == F.concat(F.lit("wrong_"), claim))
    return F.when(here.isNotNull() & (here != "="), "missing").when(missing, "missing").when(wrong, "wrong").otherwise("correct")


def tally(scored: DataFrame, *keys: str | Column) -> DataFrame:
    """Counts of each group from columns ``status`` and ``want``, in one pass.

    A mismatch on a correct label asserts a wrong value, so it counts as a false positive.
    """
    s, w = F.col("status"), F.col("want")
    verified, review, mismatch = s == "VERIFIED", s == "REVIEW", s == "MISMATCH"
    quiet = ~(verified | review | mismatch)
    right = w == "correct"
    n = lambda c, name: F.count_if(c).alias(name)
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"),
        n(verified & right, "tp"),
        n((verified & ~right) | (mismatch & right), "fp"),
        n((review | quiet) & right, "fn"),
        n(review, "review"),
        n(mismatch & (w == "wrong"), "mismatch_hit"),
        n(~mismatch & (w == "wrong"), "mismatch_miss"),
        n(quiet & (w == "missing"), "absent_hit"),
    )


def with_rates(tallied: DataFrame) -> DataFrame:
    """Adds precision and recall, 0 where there is nothing to divide by."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))
    return tallied.withColumn("precision", rate("tp", "fp")).withColumn("recall", rate("tp", "fn"))


def by_label(scored: DataFrame) -> DataFrame:
    """Of each label whether any claim mismatches and whether all verify, then their sums."""
    each = scored.groupBy("label").agg(F.bool_or(F.col("status") == "MISMATCH").alias("any_mismatch"), F.bool_and(F.col("status") == "VERIFIED").alias("all_verified"))
    return each.agg(F.count("*").alias("labels"), F.count_if("any_mismatch").alias("with_mismatch"), F.count_if("all_verified").alias("all_verified"))


def by_convention(scored: DataFrame, conventions: dict[str, Column]) -> DataFrame:
    """Tallies of overlapping groups: a label counts in every convention that it follows, or in ``none of these``."""
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in conventions.items()]), lambda x: x.isNotNull())
    groups = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none of these")))
    return tally(scored.withColumn("convention", F.explode(groups)), "convention")


def brand_group(claim: Column, face: Column, warning_face: Column) -> Column:
    """The tally of a claim: brands in a display face, whose family's first word differs, are counted apart."""
    first = lambda c: F.element_at(F.split(c, " "), 1)
    return F.when((claim == "brand") & (first(face) != first(warning_face)), F.lit("brand (display)")).otherwise(claim)


BUCKETS = 4096
FEW = 10_000


def quantile(values: DataFrame, value: str, p: float, *keys: str, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """The value at place ``min(n - 1, floor(p n))`` (from 0) of the ascending values of each group, exactly; ``value`` is a number, nulls are left out.

    Selection by histograms: the values of a group that are still in question, between a least and a largest, are counted in
    ``buckets`` of equal width, and the bucket that holds the place is looked into next, with its own least and largest
    value. A group is done when these are equal, or by a sort of the ``few`` values that are left. Counts are
    pre-aggregated, so no task holds a group, and a round needs the values of open groups only. Of no rows there is no quantile.
    """
    group = F.struct(*keys) if keys else F.lit(0)
    rows = values.select(group.alias("g"), F.col(value).alias("v")).filter("v is not null")
    # NaN is the largest number; it stands in a bucket of its own.
    is_nan = F.isnan(F.col("v").cast("double"))
    facts = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
    # Whole numbers are subtracted as such, since doubles can't tell large ones apart.
    whole = {"tinyint": 20, "smallint": 20, "int": 20, "bigint": 20}.get(rows.schema["v"].dataType.simpleString())
    number = lambda c: c.cast(f"decimal({whole},0)") if whole else c
    apart = lambda x, y: (number(x) - number(y)).cast("double")
    # Of each open group: the place among the values from lo to hi, and how many these are.
    open_ = staged(facts.select("g", place.alias("k"), "n", "lo", "hi"))
    done: list[DataFrame] = []
    while True:
        done.append(open_.filter("lo <=> hi").select("g", F.col("lo").alias("quantile")))
        left = rows.alias("r").join(open_.filter("not lo <=> hi").alias("o"), F.col("r.g").eqNullSafe(F.col("o.g"))).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select("o.*", "v")
        small = left.filter(F.col("n") <= few).groupBy("g", "k").agg(F.array_sort(F.collect_list("v")).alias("vs"))
        done.append(small.select("g", F.col("vs")[F.col("k").cast("int")].alias("quantile")))
        left = left.filter(F.col("n") > few)
        # Every step of the arithmetic keeps the order of values, so buckets are in order too. An infinite width leaves ends apart.
        width = apart(F.col("hi"), F.col("lo"))
        share = F.try_divide(apart(F.col("v"), F.col("lo")), width)
        plain = F.when(F.isnan(width) | (width > 1.7e308), F.when(F.col("v") <= F.col("lo"), 0).when(F.col("v") < 0, 1).when(F.col("v") < F.col("hi"), 2).otherwise(3))
        bucket = F.when(is_nan, buckets).when(plain.isNotNull(), plain).when(F.col("v") == F.col("hi"), buckets - 1).otherwise(F.least(F.floor(share * (buckets - 1)), F.lit(buckets - 2))).cast("int")
        counted = left.withColumn("b", bucket).groupBy("g", "k", "b").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = counted.withColumn("before", before).filter((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("c")))
        open_ = staged(counted.select("g", (F.col("k") - F.col("before")).alias("k"), F.col("c").alias("n"), "lo", "hi"))
        if not open_.limit(1).count():
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*[F.col(f"g.`{c}`").alias(c) for c in keys], "quantile")


def median_of_three(runs_: DataFrame, value: str, *keys: str) -> DataFrame:
    """The middle one of three runs of each group."""
    return runs_.groupBy(*keys).agg(F.element_at(F.array_sort(F.collect_list(value)), 2).alias("median"))


def half(n: Column, which: str) -> Column:
    """Half A has the even numbers, half B the odd ones."""
    return n % 2 == (0 if which.upper() == "A" else 1)


def leaked(families: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Families that the evaluation partition doesn't name; an unknown family counts."""
    return families.select("family").distinct().join(evaluation.select("family").distinct(), "family", "left_anti").orderBy("family")
