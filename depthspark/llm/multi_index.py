"""Near-duplicate vectors by cosine, found with an inverted multi-index.

Each vector (of length one) is cut into halves, and each half has its own codebook of ``k`` centres. The pairs of centres are a
grid of ``k * k`` cells; the index holds every vector in its cell. A vector visits the occupied cells nearest to it in order
of the sum of its two squared distances, by multi-sequence traversal, and is compared with the vectors there in double
precision. How many cells are visited is measured: vectors of a sample are compared with all rows, and the number of
cells is the smallest by which ``recall`` of their links is found. With a recall of 1 nothing is measured: a vector visits
all cells that can hold a linked one, by the distances of its halves to the centres and the radii of their cells.

Codebooks and that measurement come from bounded samples (``SAMPLE``, ``QUERIES``); everything else covers all rows. Equal
vectors are one node with a count. Of two nodes the one in the lower cell visits the other, so a link is counted once, for
both. Large cells are dealt out in blocks of members and visitors; a block sends sums of links and a spanning forest
of its links, never its pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthspark.llm.common import store
from depthspark.llm.components import components

SAMPLE, QUERIES = 20_000, 2_000
LEAST_CELLS, MOST_CENTRES = 16, 1_024
PER_CELL = 64
MEMBERS, VISITORS = 2_048, 4_096


class Grid:
    """Codebooks of both halves, the occupied cells, and how many of them a vector visits."""

    def __init__(self, sample: np.ndarray, k: int):
        half = sample.shape[1] // 2
        self.half, self.k, self.cells = half, k, LEAST_CELLS
        self.reach, self.radii = None, None
        self.books = [_centres(sample[:, :half], k, 1), _centres(sample[:, half:], k, 2)]
        self.occupied = np.ones(k * k, bool)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_squared(part, book) for part, book in zip((x[:, :self.half], x[:, self.half:]), self.books, strict=True))

    def own(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)

    def visits(self, x: np.ndarray, number: int | None = None) -> list[list[int]]:
        """Nearest occupied cells of each vector, nearest first; with ``reach`` all that may hold a vector within that squared distance."""
        both = self.distances(x)
        if self.reach is not None:
            both = [np.maximum(0, np.sqrt(d) - r) ** 2 for d, r in zip(both, self.radii, strict=True)]
        orders = [np.argsort(d, axis=1, kind="stable") for d in both]
        ranked = [np.take_along_axis(d, o, axis=1).tolist() for d, o in zip(both, orders, strict=True)]
        return [self._traverse(*row, number or self.cells) for row in zip(*(o.tolist() for o in orders), *ranked, strict=True)]

    def _traverse(self, first: list[int], second: list[int], a: list[float], b: list[float], number: int) -> list[int]:
        """Cells (i, j) of the sorted halves leave the queue in order of a[i] + b[j]; (i, j) opens (i + 1, j) and (i, j + 1)
        once both neighbours before those are done."""
        out, queue, done = [], [(a[0] + b[0], 0, 0)], [0] * (len(a) + 1)   # done[i]: cells taken in line i
        while queue and (len(out) < number if self.reach is None else queue[0][0] <= self.reach):
            _, i, j = heapq.heappop(queue)
            cell = first[i] * self.k + second[j]
            if self.occupied[cell]:
                out.append(cell)
            done[i] = j + 1
            if i + 1 < len(a) and (j == 0 or done[i + 1] == j):
                heapq.heappush(queue, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(queue, (a[i] + b[j + 1], i, j + 1))
        return out


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def _centres(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds from random distinct rows."""
    rows = np.unique(x, axis=0)
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = _squared(x, centres).argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return np.vstack([centres, np.full((k - len(centres), x.shape[1]), 1e3)]) if len(centres) < k else centres


def _unit(column: pa.Array, dimension: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dimension)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, dimension, raw``: the components in double precision as bytes, null where the vector links with nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dimension, raw = [], []
            for x in batch.column(1).to_pylist():
                ok = x and None not in x
                x = np.array(x, np.float64) + 0.0 if ok else None   # + 0.0: one zero for both signs
                norm = np.linalg.norm(x / max(np.abs(x).max(), 1e-300)) if ok else 0.0
                ok = ok and np.isfinite(x).all() and norm > 0
                dimension.append(len(x) if ok else 0)
                raw.append((x / np.abs(x).max()).tobytes() if ok and not 1e-100 < np.abs(x).max() < 1e100 else x.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dimension, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "dimension", "raw"])

    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return ready.mapInArrow(run, "vec_id long, dimension int, raw binary")


def build(nodes: DataFrame, dimension: int, number: int, least: float, recall: float) -> tuple[Grid, DataFrame]:
    """The grid with its measured number of cells, and ``node, n, raw, cell`` of all nodes."""
    spark = nodes.sparkSession
    k = max(1, min(MOST_CENTRES, math.ceil(math.sqrt(number / PER_CELL))))
    some = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("raw").toArrow()["raw"].combine_chunks()
    sample = _unit(some, dimension)
    grid = Grid(sample, k)
    shared = spark.sparkContext.broadcast(grid)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.own(_unit(batch.column(2), dimension)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], ["node", "n", "raw", "cell"])

    placed = store(nodes.select("node", "n", "raw").mapInArrow(place, "node long, n long, raw binary, cell long"), "cells")
    # At most k * k rows, and k is bounded.
    grid.occupied = np.zeros(k * k, bool)
    grid.occupied[placed.select("cell").distinct().toPandas()["cell"]] = True
    if recall >= 1:
        _within_reach(grid, placed, dimension, 2 * (1 - least))
        return grid, placed

    queries = spark.sparkContext.broadcast(sample[:QUERIES])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first in range(0, batch.num_rows, 1024):
                near = _unit(batch.column(0).slice(first, 1024), dimension) @ queries.value.T
                i, q = np.nonzero((near >= least) & (near < 1 - 1e-12))
                cells = batch.column(1).slice(first, 1024).to_numpy()[i]
                pairs, n = np.unique(np.stack([q, cells]), axis=1, return_counts=True)
                rows.append((pairs[0], pairs[1], n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows]) if rows else [], pa.int64()) for k in range(3)], ["query", "cell", "n"])

    # Sums per query and cell: at most QUERIES * k * k rows, in practice a few per query.
    true = placed.select("raw", "cell").mapInArrow(links, "query long, cell long, n long").groupBy("query", "cell").agg(F.sum("n").alias("n")).toPandas()
    if len(true):
        linked = np.unique(true["query"].to_numpy())
        rank = {(int(q), c): r for q, cells in zip(linked, grid.visits(sample[linked], int(grid.occupied.sum())), strict=True) for r, c in enumerate(cells)}
        true["rank"] = [rank[q, c] for q, c in zip(true["query"].tolist(), true["cell"].tolist(), strict=True)]
        true["share"] = true["n"] / true.groupby("query")["n"].transform("sum") / len(linked)
        for weight in (true["share"], true["n"] / true["n"].sum()):
            order = np.argsort(true["rank"].to_numpy(), kind="stable")
            at = int(np.searchsorted(np.cumsum(weight.to_numpy()[order]), recall))
            grid.cells = max(grid.cells, int(true["rank"].to_numpy()[order[min(at, len(order) - 1)]]) + 1)
    return grid, placed


def _within_reach(grid: Grid, placed: DataFrame, dimension: int, reach: float) -> None:
    """Lets the grid find every vector within ``reach``: a half is no nearer to a vector of a cell than to the cell's centre less the cell's radius."""
    shared = placed.sparkSession.sparkContext.broadcast(grid)

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radii = np.zeros((2, grid.k))
        for batch in batches:
            if batch.num_rows:
                cells = batch.column(1).to_numpy()
                for side, (d, own) in enumerate(zip(shared.value.distances(_unit(batch.column(0), dimension)), (cells // grid.k, cells % grid.k), strict=True)):
                    np.maximum.at(radii[side], own, np.sqrt(d[np.arange(len(own)), own]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * grid.k)), pa.array(radii.reshape(-1))], ["at", "radius"])

    # One number for each centre.
    found = placed.select("raw", "cell").mapInArrow(widest, "at long, radius double").groupBy("at").agg(F.max("radius").alias("radius")).toPandas()
    radii = np.zeros(2 * grid.k)
    radii[found["at"]] = found["radius"]
    grid.reach, grid.radii = reach + 1e-6, radii.reshape(2, -1) + 1e-6   # rounding decides nothing


def compare(grid: Grid, placed: DataFrame, dimension: int, least: float) -> DataFrame:
    """Per block of a cell: ``node, links`` sums, and ``a, b`` edges of a spanning forest of the links found."""
    shared = placed.sparkSession.sparkContext.broadcast(grid)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.visits(_unit(batch.column(2), dimension)) if batch.num_rows else []
            own = batch.column(3).to_pylist()
            ahead = [[c for c in row if c > mine] + [mine] for row, mine in zip(cells, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ahead, pa.list_(pa.int64()))], ["node", "n", "raw", "cell", "visits"])

    visiting = store(placed.mapInArrow(visit, "node long, n long, raw binary, cell long, visits array<long>"), "visits")
    visitors = visiting.select(F.explode("visits").alias("at"), "node", "n", "raw", "cell")
    sizes = (visitors.groupBy("at").agg(F.count("*").alias("visitors"))
             .join(placed.groupBy(F.col("cell").alias("at")).agg(F.count("*").alias("members")), "at")
             .select("at", F.ceil(F.col("members") / MEMBERS).alias("m"), F.ceil(F.col("visitors") / VISITORS).alias("v")))
    sizes = store(sizes, "blocks")
    spread = lambda rows, own, other, name: rows.join(sizes, "at").select(
        "at", F.pmod(F.xxhash64("node"), F.col(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other),
        "node", "n", "raw", "cell", F.lit(name).alias("visitor"))
    members = spread(placed.select(F.col("cell").alias("at"), "node", "n", "raw", "cell"), "m", "v", False)
    both = members.unionByName(spread(visitors, "v", "m", True))

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flag = table["visitor"].to_numpy()
        node, n, cell = (table[c].to_numpy() for c in ("node", "n", "cell"))
        x = _unit(table["raw"].combine_chunks(), dimension)
        m, v = np.flatnonzero(~flag), np.flatnonzero(flag)
        links_m, links_v, edges = np.zeros(len(m), np.int64), np.zeros(len(v), np.int64), []
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while parent.get(i, i) != i:
                parent[i] = parent.get(parent[i], parent[i])
                i = parent[i]
            return i

        for first in range(0, len(v), 512):
            part = v[first:first + 512]
            hit = (x[part] @ x[m].T >= least) & ((cell[part][:, None] < cell[m]) | (node[part][:, None] < node[m]))
            links_v[first:first + 512] = hit @ n[m]
            links_m += n[part] @ hit
            for i, j in zip(*np.nonzero(hit), strict=True):
                a, b = int(node[part[i]]), int(node[m[j]])
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    edges.append((a, b))
        used_m, used_v = np.flatnonzero(links_m), np.flatnonzero(links_v)
        found = np.concatenate([node[m[used_m]], node[v[used_v]]]), np.concatenate([links_m[used_m], links_v[used_v]])
        kinds = [("node", found[0]), ("links", found[1]), ("a", None), ("b", None)]
        sums = pa.table({k: pa.array(c, pa.int64()) if c is not None else pa.nulls(len(found[0]), pa.int64()) for k, c in kinds})
        ends = np.array(edges, np.int64).reshape(-1, 2)
        forest = pa.table({"node": pa.nulls(len(ends), pa.int64()), "links": pa.nulls(len(ends), pa.int64()), "a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})
        return pa.concat_tables([sums, forest])

    return both.groupBy("at", "m", "v").applyInArrow(meet, "node long, links long, a long, b long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, recall: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept, node`` per row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Vectors that are null, empty, zero, or hold null or non-finite components have no link and their own id. Vectors of different
    lengths never link; each length has its own index. Repeated rows are vectors of their own that link with each
    other. A row without an id is counted but is never the smallest id. An empty table gives none.
    """
    rows = store(vector_rows(vectors).withColumn("node", F.when(F.col("raw").isNotNull(), F.xxhash64("dimension", "raw"))), "vectors")
    nodes = store(rows.where("raw is not null").groupBy("dimension", "raw").agg(F.first("node").alias("node"), F.count("*").alias("n")), "nodes")
    found = None
    for dimension, number in sorted((r[0], r[1]) for r in nodes.groupBy("dimension").count().collect()):
        grid, placed = build(nodes.where(F.col("dimension") == dimension), dimension, number, least, recall)
        part = compare(grid, placed, dimension, least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), "node")
    found = store(found, "found")
    roots = components(found.where("a is not null"))
    links = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "n").join(links, "node", "left").join(roots, "node", "left").select(
        "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "node").alias("root"))
    named = store(rows.select("vec_id", "node").join(store(named, "named"), "node", "left"), "rooted")
    smallest = store(named.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("smallest")), "smallest")
    out = named.join(smallest, "root", "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id"), "node")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "node")
