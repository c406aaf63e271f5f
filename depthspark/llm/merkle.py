"""A Merkle manifest of a dataset: digests of rows, one tree per group, one tree over the groups, and a checked proof per row.

Rows of a group are numbered by their key with a range exchange, so a group that holds most rows spreads over all tasks. A
superblock is a subtree over ``2 ** HEIGHT`` neighbours. Going up, each superblock is reduced to its top node and the tops are
the nodes of the next round, until a group has one node, its subroot; the subroots are the leaves of the last tree. Going down,
the nodes of a superblock and the outer nodes it needs (the siblings on its way to the root) are cogrouped, and one function
reduces the block once more, joins its inner siblings to the outer ones, and, at the leaves, folds every proof to a root.
A round has 1 / 1,024 of the nodes of the round before, and no group is larger than a superblock.

A way to the root is two texts: ``sides`` tells for every level where the sibling stands (l, r, or - for a node that is alone),
``siblings`` has their digests one behind the other.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthspark.llm.common import store

HEIGHT = 10
DIGEST = 64      # characters of a digest as hex text
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*values: Column) -> Column:
    """SHA-256 over values as text, each with its number of bytes; ``-`` stands for null."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(n: int, height: int) -> int:
    """Levels inside a superblock of a tree of ``n`` nodes: all of them, or those up to the one node that is left."""
    return height if n > 1 << height else (n - 1).bit_length()


def reduce_up(digests: list[str], levels: int) -> list[list[str]]:
    """All levels of a subtree, from the given nodes to its top; two neighbours are hashed together, one without a neighbour alone."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([_hash(below[i] + below[i + 1] if i + 1 < len(below) else below[i]) for i in range(0, len(below), 2)])
    return out


def ways(levels: list[list[str]], sides: str, siblings: str) -> list[tuple[str, str]]:
    """The way to the root of every node of the lowest level, given that of the subtree's top."""
    above = [(sides, siblings)]
    for nodes in levels[-2::-1]:
        here = []
        for i in range(len(nodes)):
            side, found = ("l", nodes[i - 1]) if i & 1 else ("r", nodes[i + 1]) if i + 1 < len(nodes) else ("-", "")
            here.append((side + above[i >> 1][0], found + above[i >> 1][1]))
        above = here
    return above


def fold(leaf: str, sides: str, siblings: str) -> str:
    """The root that a leaf and the siblings on its way give."""
    at = 0
    for side in sides:
        if side == "-":
            leaf = _hash(leaf)
        else:
            other = siblings[at:at + DIGEST]
            at += DIGEST
            leaf = _hash(other + leaf if side == "l" else leaf + other)
    return leaf


def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Stores ``nodes`` (tree, digest, ...) with ``pos``, the place in the tree by ``order``, and ``n``, the tree's number of nodes.

    Sorted ranges are numbered side by side; only one row per range and tree is summed over the tree.
    """
    keys = ["tree", *order]
    spread = nodes.withColumn("spread", F.monotonically_increasing_id())   # equal rows may go to several ranges
    ranges = spread.repartitionByRange(*keys, "spread").sortWithinPartitions(*keys, "spread").drop("spread")
    rows = store(ranges.withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("tree", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("size").over(Window.partitionBy("tree")).alias("n"))
    return rows.join(sizes, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "shift", "at")


def _climb(nodes: DataFrame, height: int, name: str) -> list[DataFrame]:
    """The nodes (tree, pos, n, digest) of every round, up to one node per tree."""
    def top(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n = int(block["n"].iloc[0])
        last = reduce_up(block["digest"].tolist(), _levels(n, height))[-1]
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "pos": [int(block["pos"].iloc[0]) >> height], "n": [-(-n >> height)], "digest": last})

    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        blocks = rounds[-1].select("tree", "pos", "n", "digest").groupBy("tree", F.shiftright("pos", height))
        rounds.append(store(blocks.applyInPandas(top, "tree string, pos long, n long, digest string"), name))
        most = -(-most >> height)
    return rounds


def _descend(rounds: list[DataFrame], outer: DataFrame, height: int, leaves: str = "") -> DataFrame:
    """``tree, pos, sides, siblings, subroot`` of every node of the lowest round, from ``outer`` (tree, block, sides, siblings, subroot).

    With ``leaves`` (the columns to return) the lowest round's proofs are folded as well.
    """
    def inner(block: pd.DataFrame, above: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[str, str]]]:
        block, above = block.sort_values("pos"), above.iloc[0]
        levels = reduce_up(block["digest"].tolist(), _levels(int(block["n"].iloc[0]), height))
        return block, ways(levels, above["sides"], above["siblings"])

    def pass_on(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, found = inner(block, above)
        return pd.DataFrame({"tree": block["tree"], "block": block["pos"], "sides": [s for s, _ in found], "siblings": [s for _, s in found],
                             "subroot": above["subroot"].iloc[0]})

    def finish(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, found = inner(block, above)
        return block.assign(sides=[s for s, _ in found], siblings=[s for _, s in found], subroot=above["subroot"].iloc[0],
                            proof_sha256=[_hash(s) for _, s in found],
                            folded_root=[fold(leaf, *way) for leaf, way in zip(block["presented"], found, strict=True)])[[c.split()[0] for c in leaves.split(", ")]]

    for k, nodes in reversed(list(enumerate(rounds))):
        blocks = nodes.withColumn("block", F.shiftright("pos", height)).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
        outer = blocks.applyInPandas(finish, leaves) if leaves and k == 0 else blocks.applyInPandas(pass_on, "tree string, block long, sides string, siblings string, subroot string")
    return outer


def manifest(rows: DataFrame, height: int = HEIGHT, proofs: bool = True) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of ``rows`` (group, key, leaf, presented), and with
    ``proofs`` also ``sides`` and ``siblings``.

    ``leaf`` is the digest the manifest is made of and ``presented`` the one whose proof is folded. Groups ascend bytewise, null
    first; in a group rows ascend by key (null first), then leaf. Rows that are equal in both are separate leaves. An empty table
    gives no rows. Nodes of every round are written into the shared folder.
    """
    spark = rows.sparkSession
    named = rows.select(F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit("")).alias("tree"), F.col("key").cast("long").alias("key"),
                        F.col("leaf").alias("digest"), "presented")
    rounds = _climb(numbered(named, ["key", "digest"], "leaves"), height, "nodes")
    # One tree over the groups; its lowest round is where the groups' trees end.
    over = _climb(numbered(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"], "subroots"), height, "nodes")
    top = over[-1].first()
    kinds = "key long, digest string, subroot string, proof_sha256 string, folded_root string" + (", sides string, siblings string" if proofs else "")
    if top is None:
        return spark.createDataFrame([], kinds).select("key", F.col("digest").alias("leaf"), "subroot", F.lit("").alias("root"), "proof_sha256", "folded_root",
                                                       F.lit(True).alias("verified"), *(["sides", "siblings"] if proofs else []))
    root = top["digest"]
    none = F.lit("")
    start = over[-1].select("tree", F.col("pos").alias("block"), none.alias("sides"), none.alias("siblings"), none.alias("subroot"))
    to_root = _descend(over[:-1], start, height)
    # A subroot's way, by group; the block that holds all of a group's last round but one is block 0.
    outer = (over[0].select("pos", "group", F.col("digest").alias("own")).join(to_root.select(F.col("block").alias("pos"), "sides", "siblings"), "pos")
             .select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("block"), "sides", "siblings", F.col("own").alias("subroot")))
    outer = store(outer, "outer")
    return (_descend(rounds[:max(1, len(rounds) - 1)], outer, height, kinds)
            .select("key", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
                    (F.col("folded_root") == root).alias("verified"), *(["sides", "siblings"] if proofs else [])))


def text_of(columns: tuple[str, ...] = COLUMNS) -> list[Column]:
    return [F.col(f"`{c}`").cast("string") for c in columns]


def tampered_manifest(docs: DataFrame, tampered: Column, by: int = 1, height: int = HEIGHT, proofs: bool = False) -> DataFrame:
    """The manifest of documents per language, in which the rows where ``tampered`` holds are presented with ``n_chars`` raised by ``by``.

    Nulls in any column are digested as such, a null ``n_chars`` stays null, and a null ``tampered`` is no. Texts of any length are
    digested where they are read; only digests are moved. Columns other than ``COLUMNS`` are ignored.
    """
    values = text_of()
    raised = [v if c != "n_chars" else (F.col("n_chars").cast("decimal(20,0)") + by).cast("string") for c, v in zip(COLUMNS, values, strict=True)]
    rows = docs.select(F.col("lang").cast("string").alias("group"), F.col("doc_id").alias("key"), digest_of(*values).alias("leaf"),
                       F.when(tampered & F.col("n_chars").isNotNull(), digest_of(*raised)).alias("changed"))
    return manifest(rows.select("group", "key", "leaf", F.coalesce("changed", "leaf").alias("presented")), height, proofs).withColumnRenamed("key", "doc_id")
