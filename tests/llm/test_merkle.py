"""The manifest against trees built level by level in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from depthspark.llm import merkle
from tests.llm.data import crc, edge_rows, prose, table


def digest(*values) -> str:
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """The root, and for each leaf the siblings to it with their sides."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            other = p ^ 1
            ways[i].append((None, "") if other >= len(level) else ("l" if p & 1 else "r", level[other]))
        level = [h("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
        at = [p >> 1 for p in at]
    return level[0], ways


def plain_fold(leaf, way):
    for side, other in way:
        leaf = h(leaf if side is None else other + leaf if side == "l" else leaf + other)
    return leaf


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> the contract's rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, digest(*r)))
        trees[g] = (own, *plain_tree([digest(*r) for r in own]))
    if not order:
        return []
    root, outer = plain_tree([trees[g][1] for g in order])
    out = []
    for g, above in zip(order, outer, strict=True):
        own, subroot, ways = trees[g]
        for r, way in zip(own, ways, strict=True):
            shown = list(r)
            if r[0] is not None and crc(r[0], 7) == 0 and r[3] is not None:
                shown[3] += 1
            folded = plain_fold(digest(*shown), way + above)
            out.append((r[0], digest(*r), subroot, root, h("".join(s for _, s in way + above)), folded, folded == root))
    return out


def contract(spark, rows, height):
    return [tuple(r) for r in merkle.tampered_manifest(table(spark, rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, height=height).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def as_leaf(r):
    doc_id, text, lang, source, n_chars = (*r, None, None, None)[:5]
    return doc_id, source, lang, n_chars, text


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_matches_plain_trees(spark, height):
    rng = random.Random(height)
    rows = [(i, prose(i, 3), rng.choice(["en", "en", "en", "de", None, "", "é", "𐀀", "～"]), "s", rng.choice([None, 1, 12, (1 << 63) - 1])) for i in range(75)]
    rows += [(7, prose(7, 3), "en", "s", 3)] * 3 + [*((*r, *[None] * (5 - len(r))) for r in edge_rows())] + [(500, "a", "fr", None, 1)]
    got, want = contract(spark, rows, height), plain_manifest([as_leaf(r) for r in rows])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[-1] for r in got} == {True, False}


def test_one_leaf_one_group_and_nothing(spark):
    for rows in ([], [(1, "a", "en", "s", 2)], [(i, "a", "en", "s", 2) for i in range(5)], [(7, "x", l, "s", 2) for l in ("a", "b", None)]):
        assert sorted(contract(spark, rows, 2), key=str) == sorted(plain_manifest([as_leaf(r) for r in rows]), key=str)


def test_proofs_fold_to_the_root_and_changed_rows_do_not(spark):
    rows = [(i, prose(i, 4), "en" if i % 3 else "de", "s", i) for i in range(60)]
    found = merkle.tampered_manifest(table(spark, rows), F.col("doc_id") == 11, height=3, proofs=True).collect()
    for r in found:
        assert merkle.fold(r.leaf, r.sides, r.siblings) == r.root
        assert len(r.siblings) == merkle.DIGEST * sum(s != "-" for s in r.sides)
        assert r.verified == (r.doc_id != 11)
