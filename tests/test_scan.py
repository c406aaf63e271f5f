"""Blocked scans against the plain window, with blocks that cut through everything."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from depthspark.operators import scan
from depthspark.operators.intervals import interval_join
from tests.conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    rng, out = random.Random(7), []
    for key, n in (("hot", 600), ("warm", 40), ("one", 1)):
        places = rng.sample(range(-2000, 2000), n)
        out += [(key, o, rng.choice([None, *range(9)]), rng.random()) for o in places]
    return spark.createDataFrame(out, "k string, o bigint, v int, w double").cache()


@pytest.mark.parametrize("width", [1, 7, 100, 100_000])
def test_previous(data, width):
    w = Window.partitionBy("k").orderBy("o")
    plain = data.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_o", F.lag("o").over(w))
    assert rows(scan.previous(data, ["k"], ["o"], ["v", "o"], width)) == rows(plain)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("width", [1, 13, 100_000])
def test_running(data, width, inclusive):
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    plain = data.select("*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.max("v").over(w).alias("hi"),
                        F.min("v").over(w).alias("lo"), F.last("v", ignorenulls=True).over(w).alias("l"))
    ours = scan.running(data, ["k"], ["o"], width, inclusive, s=("sum", "v"), n=("count", "v"), hi=("max", "v"),
                        lo=("min", "v"), l=("last", "v"))
    assert rows(ours) == rows(plain)


def test_row_numbers(data):
    plain = data.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    assert rows(scan.row_numbers(data, ["k"], ["o"], "n", 50)) == rows(plain)


@pytest.mark.parametrize("width", [1, 9, 150, 100_000])
def test_numbered_since(data, width):
    marked = data.withColumn("m", F.when(F.col("v") == 3, F.col("o")))
    w = Window.partitionBy("k").orderBy("o")
    plain = marked.withColumn("last", F.last("m", ignorenulls=True).over(w))
    plain = plain.withColumn("n", F.row_number().over(Window.partitionBy("k", "last").orderBy("o")))
    assert rows(scan.numbered_since(marked, ["k"], ["o"], "m", "last", "n", width)) == rows(plain)


def test_a_scan_reads_and_shuffles_its_input_once(spark, folder):
    spark.range(5000).selectExpr("id % 3 AS k", "id AS o", "id * 2 AS v").write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t")
    once = scan.previous(df, ["k"], ["o"], ["v"], 100)
    twice = scan.running(once, ["k"], ["o"], 100, s=("sum", "prev_v"))
    twice.collect()
    final = twice._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1
    assert "ReusedExchange" in final


def test_best_rows_prune_before_the_shuffle(data):
    plan = scan.best_rows(data, ["k"], [F.desc("w")], 3, "n")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_interval_join(spark, width):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.randint(-50, 50)) for _ in range(80)]
    spans = [(i, rng.choice("ab"), s := rng.randint(-60, 50), rng.choice([None, s + rng.randint(0, 30)])) for i in range(60)]
    p = spark.createDataFrame(points, "k string, t bigint")
    s = spark.createDataFrame(spans, "i int, k string, a bigint, b bigint")
    expected = sorted((k, t, i) for k, t in points for i, q, a, b in spans if q == k and a <= t and (b is None or t < b))
    assert rows(interval_join(p, s, ["k"], "t", "a", "b", width, until=50), "k", "t", "i") == expected


def test_a_float_key_is_shuffled_once(spark):
    data = [("A", p, o, v) for v, (p, o) in enumerate([(0.0, 1), (-0.0, 2), (float("nan"), 1), (float("nan"), 9), (None, 1), (1.5, 3), (1.5, 8)])]
    df = spark.createDataFrame(data, "k string, p double, o bigint, v bigint")
    found = scan.previous(df, ["k", "p"], ["o"], ["v"], 4)
    assert found.columns == ["k", "p", "o", "v", "prev_v"]
    assert rows(found, "v", "prev_v") == [(0, None), (1, 0), (2, None), (3, 2), (5, None), (6, 5)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == plan.count("Scan ExistingRDD") and "knownfloatingpointnormalized" not in plan
