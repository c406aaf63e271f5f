"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthspark.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that is not the smallest of its component; ``root`` is that smallest node.

    ``edges`` has long columns ``a, b``, in any order, repeated or not; null ends and loops are ignored. Each round hooks every
    node to its smallest smaller neighbour, follows the hooks to their ends by doubling, and replaces the edges by
    those between the ends. Rounds and doublings are few (logarithmic); each table is written, so a lost executor
    costs one step. A node with very many edges only meets ``min`` (summed in every task first) and joins between
    written tables, which Spark splits where one key is large.
    """
    edges = store(_ordered(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "edges")
    roots = None
    while not edges.isEmpty():
        hooks = store(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            further = store(hooks.join(up, "root", "left").select(
                "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "hooks")
            hooks = further.select("node", "root")
            if further.where("moved").isEmpty():
                break
        ends = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = store(_ordered(edges.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
            F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "edges")
        if roots is not None:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(hooks)
            roots = store(roots, "roots")
        else:
            roots = hooks
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
