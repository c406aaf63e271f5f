"""Point-in-interval joins as equi-joins on a bucket column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthspark.operators.scan import block_of

_BUCKET = "__bucket"


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str,
                  width: int, until: int | Column | None = None) -> DataFrame:
    """Pairs with ``start <= point < end`` and equal ``keys`` (``keys`` may be empty).

    Each interval is written once per bucket of ``width`` it touches, so the join is an equi-join that
    spreads over time even when one key is hot; only pairs that share a bucket meet. Choose ``width``
    near the usual interval length. An open interval (null end) needs ``until``, the last point that
    can occur.
    """
    stop = F.col(end) if until is None else F.coalesce(F.col(end), F.lit(until) + 1)
    spread = (intervals
              .withColumn("__stop", stop)
              .filter(F.col("__stop") > F.col(start))
              .withColumn("__last", F.col("__stop") - 1)
              .withColumn(_BUCKET, F.explode(F.sequence(block_of(start, width), block_of("__last", width))))
              .drop("__last"))
    placed = points.withColumn(_BUCKET, block_of(point, width))
    joined = placed.join(spread, [*keys, _BUCKET], "inner")
    return (joined.filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col("__stop")))
            .drop(_BUCKET, "__stop"))
