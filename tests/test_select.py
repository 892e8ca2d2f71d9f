"""Selection by histograms and budgets by prefix sums against plain ones."""

import math
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veriframe.operators import evaluate, guards


@pytest.mark.parametrize(("buckets", "few"), [(4096, 10_000), (5, 0), (3, 4)])
def test_quantiles(spark, buckets, few):
    rng = random.Random(3)
    groups = {
        "even": [rng.random() for _ in range(300)], "wide": [10.0 ** rng.randint(-300, 300) * rng.choice((1, -1)) for _ in range(60)], "same": [4.0] * 50, "one": [7.5],
        "ties": [float(rng.randint(0, 3)) for _ in range(200)], "ends": [-math.inf, -1.7e308, -1.0, 0.0, 1.7e308, math.inf], "nan": [1.0, math.nan, 2.0, math.nan],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(None, 3.0), (None, 5.0), ("nulls", None), ("even", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r["quantile"] for r in evaluate.quantile(df, "v", p, "k", buckets=buckets, few=few).collect()}
        place = lambda n, p=p: min(n - 1, int(n * p))
        want = {k: sorted(vs, key=lambda x: (math.isnan(x), x))[place(len(vs))] for k, vs in groups.items()} | {None: [3.0, 5.0][place(2)]}
        assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}


def test_quantile_of_long_numbers_and_of_nothing(spark):
    big = [2**62 + k for k in range(50)]
    df = spark.createDataFrame([(v,) for v in big], "v long")
    assert evaluate.quantile(df, "v", 0.5, few=100).first()[0] == sorted(big)[25]
    assert evaluate.quantile(df.union(df.select(-F.col("v") - 1)), "v", 0.75, few=3, buckets=16).first()[0] == sorted(big)[25]
    assert evaluate.quantile(df.filter("v < 0"), "v", 0.5).count() == 0
    money = df.select((F.col("v") / 1000).cast("decimal(20,2)").alias("v"))
    assert evaluate.quantile(money, "v", 0.0).first()[0] == min(r.v for r in money.collect())


def test_budget_in_levels(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for day in range(3):
        first = datetime(2024, 2, 28 + day % 2, tzinfo=UTC) + timedelta(days=31 * (day // 2))
        own = []
        for _ in range(400):
            at = first + timedelta(microseconds=rng.choice((rng.randrange(86_400_000_000), rng.randrange(3_000_000), 500_000)))
            own.append((at, len(rows) + len(own), rng.choice((0.0, 0.25, 0.1, 1.5))))
        rows += own
        spent = 0
        for at, request, cost in sorted(own):
            ok = spent < 40_000_000_000
            spent += ok * round(cost * 1_000_000_000)
            want[request] = (at.date(), ok)
    rows.append((None, 9999, 1.0))
    df = spark.createDataFrame(rows, "ts timestamp, request long, cost double").repartition(4)
    for stretches in ((60_000_000, 10_000), (3_600_000_000,), ()):
        got = {r.request: (r.key, r.admitted) for r in guards.daily_budget(df, 40.0, stretches).collect()}
        assert got == want | {9999: (None, False)}
    assert guards.daily_budget(df, 0).filter("not admitted").count() == 0 and guards.daily_budget(df.limit(0), 5.0).count() == 0


def test_costs_that_are_none(spark):
    rows = [(datetime(2024, 1, 1, 0, 0, k, tzinfo=UTC), k, c) for k, c in enumerate((-5.0, None, 2.0, 1.0, 1.0))]
    got = {r.request: r.admitted for r in guards.daily_budget(spark.createDataFrame(rows, "ts timestamp, request long, cost double"), 3.0).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_a_caller_of_many_requests(spark):
    log = spark.range(50_000).select(F.lit("one").alias("key"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id") / 10)).alias("ts"), F.col("id").alias("request"))
    got = guards.token_bucket(log.union(log.limit(3).select(F.lit(None).cast("string"), "ts", "request")), 1.0, 5.0)
    assert got.filter("key = 'one' and admitted").count() == 5000 + 4 and got.filter("key is null and not admitted").count() == 3
