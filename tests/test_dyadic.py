from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from depthspark.operators import dyadic
from tests.conftest import rows

DAY = 864_000   # ticks of 100 ms


def members(number: int) -> range:
    k, h = divmod(number, dyadic.HEIGHTS)
    return range(k << h, (k + 1) << h)


def test_buckets_cover_an_interval_once(spark):
    rng = random.Random(1)
    data = [(a, a + rng.choice([0, 1, 2, 3, 5, 100, 1000, -4])) for a in [-3, 0, 1, 7, 64, *[rng.randrange(-5000, 5000) for _ in range(300)]]]
    df = spark.createDataFrame(data, "a bigint, b bigint")
    for a, b, found in df.select("a", "b", dyadic.buckets(F.col("a"), F.col("b"))).collect():
        assert sorted(x for n in found for x in members(n)) == list(range(a, b))


def test_a_day_is_a_few_rows(spark):
    df = spark.range(0, 50_000, 371).select(F.col("id").alias("a"), (F.col("id") + DAY).alias("b"))
    most, least = df.select(F.size(dyadic.buckets(F.col("a"), F.col("b"))).alias("n")).agg(F.max("n"), F.min("n")).first()
    assert most <= 40 and least >= 1
    assert spark.range(1).select(F.size(dyadic.above(F.lit(12345), 20)).alias("n")).first().n == 21


def test_points_lie_in_one_bucket_of_an_interval(spark):
    rng = random.Random(2)
    for _ in range(20):
        a = rng.randrange(-1000, 1000)
        b = a + rng.randrange(1, 700)
        points = [rng.randrange(a - 50, b + 50) for _ in range(30)]
        df = spark.createDataFrame([(a, b, p) for p in points], "a bigint, b bigint, p bigint")
        got = df.select("p", F.size(F.array_intersect(dyadic.buckets(F.col("a"), F.col("b")), dyadic.above(F.col("p"), 12))).alias("n"))
        assert all(n == (a <= p < b) for p, n in got.collect())


@pytest.mark.parametrize(("unit", "most"), [(1, None), (7, 3), (100, 1 << 24)])
def test_join_equals_every_pair(spark, unit, most):
    rng = random.Random(unit)
    points = [(i, rng.choice("ab"), rng.randrange(-200, 2000)) for i in range(150)] + [(900 + i, "a", 500) for i in range(20)]
    intervals = [(i, rng.choice("ab"), (s := rng.randrange(-300, 1900)), rng.choice([None, s, s + 1, s + rng.randrange(2000)])) for i in range(40)]
    p = spark.createDataFrame(points, "p int, k string, at bigint")
    q = spark.createDataFrame(intervals, "q int, k string, s bigint, e bigint")
    for keys in ([], ["k"]):
        left = p if keys else p.drop("k")
        right = q if keys else q.drop("k")
        got = rows(dyadic.dyadic_join(left, right, keys, "at", "s", "e", unit, 2000, most), "p", "q")
        assert got == sorted((i, j) for i, k, at in points for j, m, s, e in intervals
                             if (not keys or k == m) and s <= at and (at <= 2000 if e is None else at < e))


def test_a_hot_bucket_is_dealt_out(spark):
    points = spark.range(2000).select(F.col("id").alias("p"), (F.col("id") % 4096).alias("at"))
    intervals = spark.range(50).select(F.col("id").alias("q"), F.lit(0).cast("bigint").alias("s"), F.lit(4096).cast("bigint").alias("e"))
    joined = dyadic.dyadic_join(points, intervals, [], "at", "s", "e", most_pairs=5000)
    assert joined.count() == 100_000 and "__parts" in joined._jdf.queryExecution().analyzed().toString()
    parts = F.pmod(F.xxhash64("p", "at"), F.lit(20))
    assert points.groupBy(parts).count().agg(F.max("count")).first()[0] < 200


def test_nothing_joins_nothing(spark):
    p, q = spark.createDataFrame([], "p int, at bigint"), spark.createDataFrame([], "q int, s bigint, e bigint")
    some = spark.createDataFrame([(1, 5)], "p int, at bigint")
    assert dyadic.dyadic_join(p, q, [], "at", "s", "e").count() == dyadic.dyadic_join(some, q, [], "at", "s", "e", most_pairs=9).count() == 0
