"""Documents linked by the Jaccard similarity of their sets of five-word shingles, 0.75 or more.

Rare-first prefix filtering: all shingles are ordered by how often they occur (rarest first, ties by hash). Two sets
that reach the threshold share a shingle among the first quarter of each, so only those are posted and joined. Length,
positional and suffix filters and a count of common prefix shingles rule pairs out, and each remaining pair is verified
once on whole sets.

Steps, each over all documents:

1. One pass over the texts gives each document its set's size and 64-bit hash. Equal sets are one node from there on, so
   copies cost nothing. The same pass counts shingles in ``BUCKETS`` hashed buckets, the order of rarity. Any
   common order keeps the join exact; the counts only decide how many candidates there are.
2. Prefix shingles are posted; those with two nodes or more stay. Shingles whose bucket is far above the mean are
   spread over several tasks.
3. In each shingle one node is the head: the one with most live postings, which in a group of near copies is the one
   nearest to all. Pairs (node, head) are verified, and linked nodes grouped into components.
4. Shingles with nodes of several components are left. Their remaining pairs across components are taken in blocks,
   counted over all common prefix shingles, filtered, and verified. Pairs inside a component need no check, as their link
   changes no component. So no link between different texts is lost, and a large group never becomes all its pairs.

Sets are fetched for the nodes of candidate pairs only, found in one more pass with a bit filter of at most ``2**MOST_BITS``
bits; beyond some ten million such nodes the filter lets other sets pass too, which costs shuffle but changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthspark.llm.common import Words, mix, slices, store
from depthspark.llm.components import components

WORDS = 5
PERCENT = 75
BUCKET_BITS = 20
CHUNK_BITS = 10        # buckets that are summed up together
TASKS_AT_ONCE = 1_000  # tasks whose counts of a chunk are added in one group
LOW = np.uint64((1 << 48) - 1)
SALT_ROWS = 100_000    # postings of one hot shingle in a task
BLOCK = 2_048          # members of one shingle that a probe meets at once
MOST_BITS = 26


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Smallest intersection with which sets of these sizes reach the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _node(shingles: np.ndarray) -> int:
    return int(mix(np.array([mix(shingles).sum() ^ np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = batch.column(column)
    for start, end in slices(texts):
        for i, found in enumerate(Words(texts.slice(start, end - start)).shingles(WORDS)):
            yield start + i, found


def sets_and_buckets(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id, n, node``; per task more rows with its counts of buckets, one per chunk that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << BUCKET_BITS, np.int64), set()
        for batch in batches:
            n, nodes, fresh = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, []
            for i, found in _sets(batch, 1):
                if len(found):
                    n[i], nodes[i] = len(found), _node(found)
                    if nodes[i] not in seen:
                        seen.add(nodes[i])
                        fresh.append((found >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            if fresh:
                counts += np.bincount(np.concatenate(fresh), minlength=1 << BUCKET_BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(nodes, pa.int64()), pa.nulls(batch.num_rows, pa.int64()),
                                              pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.binary())], names)
        chunks = counts.reshape(-1, 1 << CHUNK_BITS)
        used = np.flatnonzero(chunks.any(axis=1))
        nothing, task = pa.nulls(len(used), pa.int64()), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([nothing, pa.array(np.full(len(used), -1)), nothing, pa.array(used), pa.array(np.full(len(used), task)),
                                          pa.array([chunks[c].tobytes() for c in used], pa.binary())], names)

    names = ["doc_id", "n", "node", "chunk", "task", "counts"]
    return _ready(docs).mapInArrow(run, "doc_id long, n long, node long, chunk long, task long, counts binary")


def _ready(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def rarity(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Level of each bucket (15 bits, rising with its count) and in how many parts its shingles are dealt out."""
    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << CHUNK_BITS, np.int64)
        for counts in group["counts"]:
            total += np.frombuffer(counts.as_buffer(), np.int64)
        return pa.table({"chunk": group["chunk"][:1], "task": pa.array([0]), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = rows.where("n < 0").select("chunk", F.floor(F.col("task") / TASKS_AT_ONCE).alias("task"), "counts")
    for keys in (("chunk", "task"), ("chunk",)):   # first some tasks together, then all
        parts = parts.groupBy(*keys).applyInArrow(add, "chunk long, task long, counts binary")
    counts = np.zeros((1 << BUCKET_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.int64)
    for chunk, _, found in parts.toPandas().itertuples(index=False):
        counts[chunk] = np.frombuffer(found, np.int64)
    counts = counts.reshape(-1)
    level = np.minimum(1024 * np.log2(1.0 + counts), 32767).astype(np.uint64) << np.uint64(48)
    deal = np.where(counts > 4 * counts.mean(), counts // SALT_ROWS + 1, 1)
    return level, deal


def ordered_keys(shingles: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The shingles as positive numbers whose order is rarest first; 48 bits of the hash stay in them."""
    bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return np.sort(level[bucket] | (shingles & LOW)).view(np.int64)


def postings(docs: DataFrame, level, deal) -> DataFrame:
    """``key, salt, node, n, pos`` of the prefix shingles; equal sets are posted once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys, nodes, sizes, places, salts = [], [], [], [], []
            for _, found in _sets(batch, 1):
                n = len(found)
                node = _node(found) if n else None
                if n and node not in seen:
                    seen.add(node)
                    bucket = (found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                    key = level.value[bucket] | (found & LOW)
                    first = np.argsort(key)[:prefix_length(n)]
                    keys.append(key[first].view(np.int64))
                    parts = deal.value[bucket[first]]
                    salts.append(np.where(parts > 1, 1 + node % parts, 0))   # 0: not dealt out
                    nodes.append(np.full(len(first), node))
                    sizes.append(np.full(len(first), n, np.int32))
                    places.append(np.arange(len(first), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, salts, nodes, sizes, places)], ["key", "salt", "node", "n", "pos"])

    return _ready(docs).mapInArrow(run, "key long, salt long, node long, n int, pos int")


def live_postings(posted: DataFrame) -> DataFrame:
    """Postings of shingles that two nodes or more have, and all of those that were dealt out."""
    same = Window.partitionBy("key", "salt")
    marked = posted.select("*", F.min("node").over(same).alias("low"), F.max("node").over(same).alias("high"))
    return marked.where("low <> high or salt > 0").select("key", "node", "n", "pos")


def _may_reach(n: str, m: str, percent: int = PERCENT):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def head_pairs(live: DataFrame) -> DataFrame:
    """``a, b``: each node with the heads of its shingles, where length and place allow a link."""
    weight = live.groupBy("node").agg(F.count("*").alias("weight"))
    heads = (live.join(weight, "node").groupBy("key")
             .agg(F.max(F.struct("weight", "node", "n", "pos")).alias("head")))
    found = live.join(store(heads, "heads"), "key").select("node", "n", "pos", F.col("head.node").alias("head"), F.col("head.n").alias("m"), F.col("head.pos").alias("at"))
    most = F.least("pos", "at") + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    return found.where(F.col("node") != F.col("head")).where(_may_reach("n", "m") & _enough(most, "n", "m")).select(
        F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def _enough(overlap, n: str, m: str):
    return (100 + PERCENT) * overlap >= PERCENT * (F.col(n) + F.col(m))


def sharing_enough(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs whose common prefix shingles still allow a link.

    With ``k`` of them, the last at places ``x, y``: behind it no shingle is in both prefixes. If the prefix of ``a`` ends
    first, what follows in it is in neither part of ``b``, so only the part of ``a`` behind its prefix and that of ``b``
    behind ``y`` can be common; and the other way round.
    """
    x = live.select(F.col("node").alias("a"), "key", "n", F.col("pos").alias("x"))
    y = live.select(F.col("node").alias("b"), "key", F.col("n").alias("m"), F.col("pos").alias("y"))
    shared = (pairs.join(x, "a").join(y, ["b", "key"]).groupBy("a", "b")
              .agg(F.count("*").alias("k"), F.max("x").alias("x"), F.max("y").alias("y"), F.max("n").alias("n"), F.max("m").alias("m")))
    behind = lambda c: F.floor((PERCENT * F.col(c) + 99) / 100) - 1
    rest = F.greatest(F.least(behind("n"), F.col("m") - 1 - F.col("y")), F.least(behind("m"), F.col("n") - 1 - F.col("x")))
    return shared.where(_enough(F.col("k") + rest, "n", "m")).select("a", "b")


def bit_filter(nodes: DataFrame) -> np.ndarray:
    """Bits at three places per node, as bytes; its size follows the number of nodes up to ``2**MOST_BITS`` bits."""
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(16 * max(1, nodes.count())))))
    place = [F.shiftright(F.col("node"), 21 * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(3)]
    words = (nodes.select(F.explode(F.array(*place)).alias("p")).groupBy(F.shiftright("p", 5).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("bits")).toPandas())
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words["word"]] = words["bits"].astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def fetch_sets(docs: DataFrame, level, wanted) -> DataFrame:
    """``node, keys`` (sorted 64-bit numbers) of the nodes that pass the filter, once per node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mask = set(), len(wanted.value) - 1
        for batch in batches:
            nodes, keys = [], []
            for _, found in _sets(batch, 1):
                if len(found):
                    node = _node(found)
                    if node not in seen and all(wanted.value[(node >> 21 * k) & mask] for k in range(3)):
                        seen.add(node)
                        nodes.append(node)
                        keys.append(ordered_keys(found, level.value).tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.binary())], ["node", "keys"])

    return _ready(docs).mapInArrow(run, "node long, keys binary")


def reaches(x: np.ndarray, y: np.ndarray, percent: int = PERCENT, depth: int = 3) -> bool:
    """Whether two sorted sets reach the threshold. The suffix filter comes first: cut one set at its middle and the
    other at the same value; each part shares at most what the smaller side holds."""
    need = least_overlap(len(x), len(y), percent)

    def bound(a: np.ndarray, b: np.ndarray, left: int) -> int:
        if not left or not len(a) or not len(b):
            return min(len(a), len(b))
        half = len(a) // 2
        at = int(np.searchsorted(b, a[half]))
        return bound(a[:half], b[:at], left - 1) + bound(a[half:], b[at:], left - 1)

    if bound(x, y, depth) < need:
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum()) >= need


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose whole sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [reaches(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64))
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(c), F.col("keys").alias(f"keys_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "keys_a", "keys_b")
    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, level) -> DataFrame:
    """The linked pairs; the sets of their nodes are read from the texts."""
    if pairs.isEmpty():
        return pairs
    nodes = store(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(nodes))
    sets = fetch_sets(docs, level, wanted).join(nodes, "node", "left_semi").groupBy("node").agg(F.any_value("keys").alias("keys"))
    return verify(pairs, store(sets, "keys"))


def cross_pairs(live: DataFrame, roots: DataFrame) -> DataFrame:
    """``a, b``: pairs of nodes in different components whose common prefix shingles still allow a link.

    In each shingle with several components a member probes those of larger components (by nodes, then name), in blocks. So a pair
    is probed from the same side in all its shingles; the blocks of one probe are added up over them, and each pair is
    judged once, on all shingles it shares.
    """
    named = live.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    named = store(named, "named")
    nodes = store(named.groupBy("root").agg(F.countDistinct("node").alias("size")), "roots")
    keys = named.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    keys = store(keys.select("key", "members"), "mixed")
    parts = max(1, -(-(keys.agg(F.max("members")).first()[0] or 0) // BLOCK))
    mixed = store(named.join(keys, "key").join(nodes, "root").select(
        "key", "node", "n", F.struct("size", "root").alias("rank"), F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")), "members")
    blocks = mixed.groupBy("key", "part").agg(F.collect_list(F.struct("node", "n", "rank")).alias("block"), F.max("rank").alias("top"))
    probes = mixed.select("key", F.col("node").alias("probe"), F.col("n").alias("m"), F.col("rank").alias("own"))
    fits = lambda x: (x["rank"] > F.col("own")) & (100 * F.least(x["n"], F.col("m")) >= PERCENT * F.greatest(x["n"], F.col("m")))
    met = probes.join(blocks, "key").where("top > own").select("probe", "m", "part", F.filter("block", fits).alias("found")).where(F.size("found") > 0)
    met = met.select("probe", "m", "part", F.transform("found", lambda x: x["node"]).alias("nodes"), F.transform("found", lambda x: x["n"]).alias("sizes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None   # rows of the last probe, which the next batch may go on with
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            probe, part = held["probe"].to_numpy(), held["part"].to_numpy()
            done = int(np.flatnonzero((probe != probe[-1]) | (part != part[-1]))[-1]) + 1 if len(probe) and (probe[0] != probe[-1] or part[0] != part[-1]) else 0
            if done:
                yield from _reaching(held.slice(0, done).combine_chunks())
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield from _reaching(held.combine_chunks())

    return met.repartition("probe", "part").sortWithinPartitions("probe", "part").mapInArrow(count, "a long, b long").distinct()


def _reaching(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of whole groups of (probe, part): the pairs whose common prefix shingles, one per row, still allow a link."""
    lists = rows["nodes"].combine_chunks()
    node, m = lists.flatten().to_numpy(), rows["sizes"].combine_chunks().flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
    probe, n = rows["probe"].to_numpy()[owner], rows["m"].to_numpy().astype(np.int64)[owner]
    order = np.lexsort((node, probe))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(probe[order]) != 0) | (np.diff(node[order]) != 0)])) if len(order) else np.zeros(0, int)
    shared = np.diff(np.append(first, len(order)))
    probe, node, n, m = (x[order][first] for x in (probe, node, n, m))
    # Beyond the shared prefix shingles, at most the rest behind one of the two prefixes can be common.
    behind = lambda size: -(-PERCENT * size // 100) - 1
    keep = (100 + PERCENT) * (shared + np.maximum(behind(n), behind(m))) >= PERCENT * (n + m)
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node, probe)[keep]), pa.array(np.maximum(node, probe)[keep])], ["a", "b"])


def ngram_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs`` (doc_id, text; other columns are ignored).

    ``component_id`` is the smallest ``doc_id`` that links reach, the row itself included. Rows without words or text have
    no shingles and their own id. Repeated rows are linked with each other and give repeated rows; a null ``doc_id`` is never
    the smallest. An empty table gives none.
    """
    spark = docs.sparkSession
    rows = store(sets_and_buckets(docs), "sets")
    level, deal = (spark.sparkContext.broadcast(x) for x in rarity(rows))
    live = store(live_postings(postings(docs, level, deal)).distinct(), "live")
    tried = store(head_pairs(live), "pairs")
    pairs = store(sharing_enough(tried, live), "pairs")
    edges = store(verified(pairs, docs, level), "edges")
    roots = components(edges)
    more = store(cross_pairs(live, roots).join(tried, ["a", "b"], "left_anti"), "pairs")
    roots = components(edges.unionByName(verified(more, docs, level)))

    named = store(rows.where("n >= 0").join(roots, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root")), "rooted")
    least = store(named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return named.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one document of each component stays: the one with the smallest id.

    Of rows with one id the first by text stays. Rows without an id cannot be told apart in a component and all stay.
    """
    heads = ngram_components(docs).where("doc_id = component_id").select(F.col("doc_id").alias("head")).distinct()
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("head"), F.col("text").cast("string").alias("text"), row)
    first = F.row_number().over(Window.partitionBy("head").orderBy("text"))
    kept = rows.join(heads, "head", "left_semi").withColumn("first", first).where("first = 1")
    return kept.select("row.*").unionByName(rows.where("head is null").select("row.*"))
