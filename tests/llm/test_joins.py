"""Shingle join, vector index and components against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from depthspark.llm import multi_index, ngram_join
from depthspark.llm.components import components
from tests.llm.data import edge_rows, prose, table, words


def smallest(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(5, 5), (None, 7), (8, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if n is not None}
    want = smallest([e for e in edges if None not in e], nodes)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_components(rows):
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(r[1])) else set() for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = smallest(links, range(len(rows)))
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids and sets[i] else r[0]))
    return sorted(out, key=str)


def edited(seed: int, text: str, edits: int) -> str:
    rng, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10 ** 9)}"
    return " ".join(w)


def near_rows():
    """A drifting chain, a star of near copies that mostly do not link with each other, a shared passage, and copies."""
    base, passage = prose(21, 120), prose(22, 60)
    chain = [base]
    for i in range(12):
        chain.append(edited(50 + i, chain[-1], 2))
    star = [edited(100 + i, prose(23, 140), 1 + i % 5) for i in range(40)]
    texts = [*chain, *star, *(prose(200 + i, 30 + 10 * i) + " " + passage for i in range(12)), *[prose(24, 50)] * 6, *(prose(25, 12 + i) for i in range(8))]
    return [(1000 + 7 * i % 997, t, "en", "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("salt_rows, block", [(100_000, 2_048), (3, 4)])
def test_ngram_components_match_brute_force(spark, monkeypatch, salt_rows, block):
    monkeypatch.setattr(ngram_join, "SALT_ROWS", salt_rows)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_rows() + edge_rows()
    got = ngram_join.ngram_components(table(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)


def test_only_the_exhaustive_step(spark, monkeypatch):
    """Without any pair from the heads, the step across components alone has to find every component."""
    monkeypatch.setattr(ngram_join, "head_pairs", lambda live: live.sparkSession.createDataFrame([], "a long, b long"))
    rows = near_rows()
    got = ngram_join.ngram_components(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)


def test_ngram_components_of_nothing(spark):
    assert ngram_join.ngram_components(table(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_components(table(spark, [(4, None), (3, " ")])).orderBy("doc_id").collect()] == [(3, 0, 3), (4, 0, 4)]


def test_reaches_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(500):
        x = np.unique(rng.integers(0, 60, rng.integers(1, 50)))
        y = np.unique(np.concatenate([rng.choice(x, rng.integers(0, len(x) + 1), replace=False), rng.integers(0, 60, rng.integers(0, 8))])) if rng.random() < 0.8 else np.unique(rng.integers(0, 60, 30))
        if len(y):
            both = len(np.intersect1d(x, y))
            assert ngram_join.reaches(x, y) == (100 * both >= 75 * (len(x) + len(y) - both))


def test_one_of_each(spark):
    rows = near_rows() + edge_rows()
    docs = table(spark, rows)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    heads = {r[0] for r in plain_components(rows) if r[0] == r[2] and r[0] is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(heads)


def test_traversal_is_in_order():
    rng = np.random.default_rng(2)
    grid = multi_index.Grid(rng.standard_normal((300, 8)), 9)
    grid.occupied = rng.random(81) < 0.6
    x = rng.standard_normal((40, 8))
    a, b = grid.distances(x)
    for row, cells in enumerate(grid.visits(x, 200)):
        cost = a[row][:, None] + b[row]
        assert sorted(cells) == np.flatnonzero(grid.occupied).tolist()
        along = [cost[c // 9, c % 9] for c in cells]
        assert along == sorted(along)


@pytest.mark.parametrize("members, visitors, recall", [(2_048, 4_096, 0.98), (7, 11, 0.98), (7, 11, 1.0)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, members, visitors, recall):
    monkeypatch.setattr(multi_index, "MEMBERS", members)
    monkeypatch.setattr(multi_index, "VISITORS", visitors)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    x = np.vstack([centres[i % 30] + 0.28 * rng.standard_normal(16) for i in range(240)] + [rng.standard_normal((300, 16))] + [np.tile(centres[0], (60, 1))])
    x = x.astype(np.float32).astype(np.float64)
    rows = [(1000 - i, v.tolist(), 0, "x", 1, 2, 3) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0], [2.0, 0.0], (1e30 * centres[0]).astype(np.float32).tolist(), [3.0] * 3]
    rows += [(2000 + i, v, None, None, None, None, None) for i, v in enumerate(odd)]
    got = {r.vec_id: r for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, raw string, node int, n int, cell int"), recall=recall).collect()}
    unit = {i: np.array(v, np.float32).astype(np.float64) for i, v, *_ in rows if v and None not in v and np.isfinite(np.array(v, np.float64)).all() and np.any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    degree = {i: 0 for i, *_ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert all(r.n_links <= degree[i] for i, r in got.items()) and len(got) == len(rows)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(degree.values())
    if recall == 1:
        assert {i: r.n_links for i, r in got.items()} == degree
    root = smallest(links, [i for i, *_ in rows])
    assert sum(r.component_id == root[i] for i, r in got.items()) >= (1 if recall == 1 else 0.97) * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all((got[2000 + i].n_links, got[2000 + i].component_id) == (0, 2000 + i) for i in (0, 1, 2, 3, 4, 5, 9)) and got[2006].n_links == 1


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert multi_index.near_duplicates(empty).count() == 0
    assert multi_index.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).count() == 2
