"""Intervals as few aligned buckets whose lengths are powers of two.

Bucket ``k`` of height ``h`` holds the whole numbers from ``k * 2**h`` up to ``(k + 1) * 2**h``. An interval of length n is the
union of at most ``2 * log2(n) + 2`` buckets that do not overlap (a day of ticks of 100 ms is at most 40), and a point lies in one
bucket of each height. So point and interval meet in exactly one bucket or in none, and joins and aggregates over intervals
are equi-joins without a filter, however long the intervals are. A bucket is one number, ``k * 64 + h``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthspark.operators.scan import block_of

BUCKET = "__bucket"
HEIGHTS = 64
MOST_PAIRS = 1 << 24
TALL = 10           # buckets of less than 2**TALL units are never dealt out


def _shift(value: Column, height: Column) -> Column:
    return F.call_function("shiftright", value, height)


def height_of(length: Column) -> Column:
    """The height of the largest bucket that fits into an interval of ``length`` (1 or more)."""
    return F.length(F.bin(length)) - 1


def buckets(start: Column, end: Column) -> Column:
    """The buckets that make up ``[start, end)``, as an array; empty where the interval is."""
    start, end = start.cast("bigint"), end.cast("bigint")

    def at(h: Column) -> Column:
        a, b = -_shift(-start, h), _shift(end, h)   # what is left at this height
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("bigint"))
        number = lambda k: k * HEIGHTS + h
        return F.array(F.when((a < b) & (odd(a) == 1), number(a)), F.when((odd(b) == 1) & (a + odd(a) < b), number(b - 1)))

    heights = F.when(end > start, F.sequence(F.lit(0), height_of(end - start)))
    several = F.coalesce(F.array_compact(F.flatten(F.transform(heights, at))), F.array().cast("array<bigint>"))
    return F.when(end == start + 1, F.array(start * HEIGHTS)).otherwise(several)


def above(point: Column, top: Column | int, low: int = 0) -> Column:
    """The buckets of heights ``low`` to ``top`` that hold a point."""
    return F.transform(F.sequence(F.lit(low), F.lit(top) if isinstance(top, int) else top),
                       lambda h: _shift(point.cast("bigint"), h) * HEIGHTS + h)


def dyadic_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, unit: int = 1,
                until: int | Column | None = None, most_pairs: int | None = None) -> DataFrame:
    """Pairs with ``start <= point < end`` and equal ``keys`` (``keys`` may be empty).

    Numbers are cut to ``unit`` before they are put into buckets. An open interval (null end) needs ``until``, the last point that can
    occur. With ``most_pairs`` a tall bucket that makes more pairs is dealt out: its points by a hash, its intervals to every part.
    Sizes are counted over the tall buckets only, of which there are none where all intervals are short.
    """
    stop = F.col(end) if until is None else F.coalesce(F.col(end), F.lit(until) + 1)
    wanted = intervals.withColumn("__stop", stop).filter(F.col("__stop") > F.col(start))
    wanted = wanted.withColumn("__from", block_of(start, unit)).withColumn("__last", F.col("__stop") - 1)
    wanted = wanted.withColumn("__to", block_of("__last", unit) + 1).drop("__last")
    top = F.coalesce(wanted.select(F.max(height_of(F.col("__to") - F.col("__from")))).scalar(), F.lit(0))
    wanted = wanted.withColumn(BUCKET, F.explode(buckets(F.col("__from"), F.col("__to")))).drop("__from", "__to")
    placed = points.withColumns({"__at": block_of(point, unit), "__top": top})
    on, tall = [*keys, BUCKET], F.col("__top") >= TALL
    if most_pairs:
        counted = (placed.select(*keys, "__at", "__top").filter(tall).withColumn(BUCKET, F.explode(above(F.col("__at"), F.col("__top"), TALL)))
                   .groupBy(*on).agg(F.count("*").alias("__points")))
        sizes = counted.join(wanted.filter(F.col(BUCKET).bitwiseAND(HEIGHTS - 1) >= TALL).groupBy(*on).agg(F.count("*").alias("__intervals")), on)
        parts = F.ceil(F.col("__points") * F.col("__intervals") / F.lit(most_pairs)).cast("int")
        hot = sizes.withColumn("__parts", F.least(parts, F.col("__points").cast("int"))).filter("__parts > 1").select(*on, "__parts")
    # ``above``, but with the heights as rows first: shifts of plain columns are compiled, those inside ``transform`` are not.
    height = F.col("__height")
    placed = (placed.withColumn("__height", F.explode(F.sequence(F.lit(0), F.col("__top"))))
              .withColumn(BUCKET, _shift(F.col("__at"), height) * HEIGHTS + height).drop("__at", "__top", "__height"))
    if most_pairs:
        dealt = F.pmod(F.xxhash64(*points.columns), F.coalesce("__parts", F.lit(1)))
        placed = placed.join(hot, on, "left").withColumn("__part", dealt.cast("int")).drop("__parts")
        every = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
        wanted = wanted.join(hot, on, "left").withColumn("__part", F.explode(every)).drop("__parts")
        on = [*on, "__part"]
    joined = placed.join(wanted, on, "inner")
    if unit > 1:
        joined = joined.filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col("__stop")))
    return joined.drop(BUCKET, "__stop", "__part")
