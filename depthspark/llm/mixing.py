"""Mixing sources to target weights by entropy balancing.

Each document gets a rate: how often the mix takes it. Rates stay as close to 1 as they can (relative entropy) while
each source's taken words meet its target and no rate exceeds ``most``. The solution is an exponential tilt,
``min(most, exp(b * size))`` with one ``b`` per source, found by Newton steps on the convex dual. Rates depend on source
and size alone, so the steps run on counts per (source, size), aggregated once from all documents. Rates are then rounded
into copies: largest sizes first, each size carries its rest of words on to the next, so that a source ends within half a
word count of its smallest document of the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthspark.llm.common import SPACE, store, text_buffers

STEPS = 100
BUCKET = 1_000   # documents of one source and size that are ranked together


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of each text; null has none."""
    data, offsets = text_buffers(column)
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = inside[firsts]
    total = np.concatenate([[0], np.cumsum(start)])
    return total[offsets[1:]] - total[offsets[:-1]]


def with_size(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, tie``; ``tie`` orders rows of one source and size in the same way in every run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(word_counts(batch.column(3)))],
                                             ["doc_id", "source", "tie", "size"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(run, "doc_id long, source string, tie long, size long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources ascend by code point, null last, and get the weights in turn. Their targets share all words by weight,
    each at most ``most`` times what the source has, the rest going to the others by weight. That is a water level: with
    sources ordered by (limit / weight) the ones before some place are at their limit, and the others share the rest.
    One row per source is all that meets here.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    front, back = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    rows = (rows.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(front), F.lit(0.0)))
                            / F.sum("weight").over(back))
            .withColumn("place", F.when(F.col("level") <= F.col("ratio"), F.row_number().over(by_ratio)))
            .withColumn("level", F.min_by("level", "place").over(everything)))
    return rows.select("source", "source_size", F.least(F.col("weight") * F.coalesce("level", F.lit(0.0)), most * F.col("source_size")).alias("target"))


def tilt(size: np.ndarray, count: np.ndarray, target: float, most: float = 3.0, steps: int = STEPS) -> np.ndarray:
    """Rates per size: ``min(most, exp(b * size))`` with sum(count * size * rate) = target.

    Newton on the dual in ``b`` per largest size, kept inside a bracket, so it ends for every target between 0 and all
    that ``most`` allows. At those two ends the rates are 0 and ``most``.
    """
    have = float((size * count).sum())
    if have == 0:
        return np.ones(len(size))
    if target <= 0 or target >= most * have:
        return np.full(len(size), 0.0 if target <= 0 else most)
    z = size / size.max()
    mass = size * count
    low, high, b = -1.0, 1.0, 0.0

    def gap(b: float) -> tuple[float, float]:
        rate = np.exp(np.minimum(b * z, np.log(most)))
        return float((mass * rate).sum()) - target, float((mass * rate * z)[b * z < np.log(most)].sum())

    while gap(low)[0] > 0:
        low *= 2
    while gap(high)[0] < 0:
        high *= 2
    for _ in range(steps):
        off, slope = gap(b)
        if abs(off) <= 1e-9 * have or high - low < 1e-15 * max(1.0, high):
            break
        low, high = (b, high) if off < 0 else (low, b)
        step = b - off / slope if slope > 0 else np.inf
        b = step if low < step < high else (low + high) / 2
    return np.exp(np.minimum(b * z, np.log(most)))


def copies(size: np.ndarray, count: np.ndarray, rate: np.ndarray, most: int = 3) -> np.ndarray:
    """Copies that all documents of a size get together; words that rounding leaves over go to the next smaller size."""
    out, carry = np.zeros(len(size), np.int64), 0.0
    for i in np.argsort(-size):
        if size[i] == 0:
            out[i] = count[i]
            continue
        want = rate[i] * count[i] * size[i] + carry
        out[i] = min(max(round(want / size[i]), 0), most * count[i])
        carry = want - out[i] * size[i]
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """``doc_id, tie, source, size, source_size, target, copies, taken`` per row of ``docs`` (doc_id, text, source).

    Null source is a source of its own, null text has size 0 and is taken once with 0 words. Repeated rows are documents
    of their own; rows that agree in everything may get different numbers of copies. An empty table gives none.
    """
    rows = store(with_size(docs).withColumn("bucket_hash", F.abs(F.hash("tie", "doc_id").cast("long"))), "sizes")
    per_size = rows.groupBy("source", "size").agg(F.count("*").alias("docs"))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = store(source_targets(per_source, weights, most), "targets")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        size, count = group["size"].to_numpy(np.int64), group["docs"].to_numpy(np.int64)
        rate = tilt(size, count, float(group["target"].iloc[0]), most)
        total = copies(size, count, rate, most)
        return group.assign(least=total // count, extra=total % count)

    # A source's rows here are its distinct sizes, bounded by the longest document and not by the number of documents.
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    solved = (per_size.alias("a").join(targets.alias("b"), same).select("a.source", "size", "docs", "source_size", "target")
              .groupBy("source").applyInPandas(solve, "source string, size long, docs long, source_size long, target double, least long, extra long"))
    solved = store(solved, "rates")

    # The first ``extra`` documents of a (source, size) take one copy more. They are ranked in buckets of about BUCKET rows.
    key = [F.col("r.source").eqNullSafe(F.col("s.source")), F.col("r.size") == F.col("s.size")]
    placed = store(rows.alias("r").join(solved.alias("s"), key).select(
        "doc_id", "tie", "r.source", "r.size", "source_size", "target", "least", "extra",
        F.pmod("bucket_hash", F.ceil(F.col("docs") / BUCKET)).alias("bucket")), "placed")
    front = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (placed.where("extra > 0").groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
             .withColumn("ahead", F.coalesce(F.sum("n").over(front), F.lit(0))).select("source", "size", "bucket", "ahead"))
    ranked = placed.where("extra > 0").withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("tie", "doc_id")))
    key = [F.col("r.source").eqNullSafe(F.col("s.source")), F.col("r.size") == F.col("s.size"), F.col("r.bucket") == F.col("s.bucket")]
    columns = ["doc_id", "r.tie", "r.source", "r.size", "source_size", "target"]
    more = ranked.alias("r").join(ahead.alias("s"), key).select(*columns, (F.col("least") + (F.col("rank") + F.col("ahead") <= F.col("extra")).cast("long")).alias("copies"))
    even = placed.alias("r").where("extra = 0").select(*columns, F.col("least").alias("copies"))
    return more.unionByName(even).withColumn("taken", F.col("copies") * F.col("size"))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Rows that agree in id and text share their copies evenly, the first ones getting what is left over.
    """
    total = mixed.groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("tie")]
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *key)
    total = total.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "tie", "copies", "rows")
    place = F.row_number().over(Window.partitionBy("id", "tie").orderBy("id"))
    many = F.floor(F.col("copies") / F.col("rows")) + (F.col("place") <= F.col("copies") % F.col("rows")).cast("long")
    taken = rows.join(total, ["id", "tie"]).withColumn("place", place).withColumn("many", many)
    return taken.where("many > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "many"))).select("row.*")
