"""Test items that leaked into training documents: BM25 retrieval with block-max WAND, then checked overlap.

The items are an inverted index, and every passage of every document is a query. A posting's weight is the BM25 weight
of the word in the item, divided by the item's whole score, so 1 means that all of an item's words are there and one
threshold serves items of all lengths. Passages are pairs of neighbouring stretches of words, each as long as the longest item
of the index, so an item lies whole in one of them.

Three bounds, each exact: the sum of the words' largest weights in the index, then that of their largest weights per block of
items (both for a whole slice of documents at once), then the walk over the postings of what is left (``Index.walk``), which
scores an item only if the block maxima of its lists reach the threshold. Retrieved items are verified. Where an item has an
answer, enough of the five-word runs of its question and of the short runs of its answer must stand in the passage. An item
that is one text needs enough of the runs of the whole text, or one verbatim stretch of half its words, wherever that lies;
its weights are raised in retrieval so far that every such stretch reaches the threshold.

The index is broadcast in parts of about ``PART_WORDS`` words of items, ``PARTS_AT_ONCE`` to a pass over the documents, so its size
does not follow the benchmark's. Weights and passages come from all items, so the parts change no result.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from depthspark.llm.common import Words, constants, mix, slices, store

BLOCKS = 64             # blocks of items that have their own maxima
PART_WORDS = 1 << 18
PARTS_AT_ONCE = 4
LEAST_STRETCH = 64
SLICE = 1 << 20         # bytes of text whose block bounds are held at once
K1, B = 1.2, 0.75
_STEP = constants(8, 17)


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words; of all words together where there are fewer."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out += words[k:len(out) + k] * _STEP[k]
    return np.unique(mix(out))


def _runs_in_order(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, one per place; of all words together where there are fewer."""
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    for k in range(size):
        out += words[k:len(out) + k] * _STEP[k]
    return mix(out)


def _half(n: int) -> int:
    return -(-n // 2)


def _least_half(text: np.ndarray, words: np.ndarray, weight: np.ndarray) -> float:
    """The least weight of the distinct words of any stretch of half the text."""
    at, size = np.searchsorted(words, text), _half(len(text))
    held, total, least = np.zeros(len(words), int), 0.0, np.inf
    for k, t in enumerate(at.tolist()):
        held[t] += 1
        total += weight[t] if held[t] == 1 else 0.0
        if k >= size:
            gone = at[k - size]
            held[gone] -= 1
            total -= weight[gone] if held[gone] == 0 else 0.0
        if k >= size - 1:
            least = min(least, total)
    return max(float(least), 1e-6)


class Statistics:
    """What the weights need to know of all items, whichever part an item is in; ``terms`` (ascending) are those of one part."""

    def __init__(self, items: int, words: int, longest: int, terms: np.ndarray, frequencies: np.ndarray):
        self.items, self.words, self.longest, self.terms, self.frequencies = items, words, longest, terms, frequencies

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.frequencies[np.searchsorted(self.terms, terms)]


class Index:
    """Inverted index over ``items``: (id, hashes of the words of the question, those of the answer)."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], question_run: int = 5, answer_run: int = 3, threshold: float = 0.5,
                 among: Statistics | None = None):
        self.threshold, self.question, self.answer = threshold, 0.5, 0.5
        self.ids = [i for i, _, _ in items]
        self.runs = [(runs(q, question_run), runs(a, answer_run), question_run, min(answer_run, len(a)), min(question_run, len(q))) for _, q, a in items]
        texts = [np.concatenate([q, a]) for _, q, a in items]
        self.in_order = [None if len(a) else _runs_in_order(q, question_run) for _, q, a in items]
        self.raised = np.ones(len(items))
        self.per_block = max(1, -(-len(items) // BLOCKS))
        lengths = np.array([len(t) for t in texts], float)
        counted = [np.unique(t, return_counts=True) for t in texts]
        self.terms, df = np.unique(np.concatenate([u for u, _ in counted]) if counted else np.zeros(0, np.uint64), return_counts=True)
        among = among or Statistics(len(items), int(lengths.sum()), int(lengths.max(initial=0)), self.terms, df)
        mean, df = max(1.0, among.words / max(1, among.items)), among.of(self.terms)
        self.stretch = max(LEAST_STRETCH, among.longest)
        idf = np.log(1 + (among.items - df + 0.5) / (df + 0.5))
        found: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.block_max = np.zeros((len(self.terms), BLOCKS), np.float32)
        for i, (words, tf) in enumerate(counted):
            at = np.searchsorted(self.terms, words)
            weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / mean))
            weight = weight / weight.sum() if len(weight) else weight
            if self.in_order[i] is not None:
                self.raised[i] = max(1.0, threshold / _least_half(texts[i], words, weight) * 1.0001)   # the bounds are sums of single precision
                weight = weight * self.raised[i]
            for t, w in zip(at.tolist(), weight.tolist(), strict=True):
                found[t].append((i, w))
            block = i // self.per_block
            self.block_max[at, block] = np.maximum(self.block_max[at, block], np.nextafter(weight.astype(np.float32), np.float32(2)))
        self.postings = [([i for i, _ in p], [w for _, w in p]) for p in found]
        self.top = self.block_max.max(axis=1) if len(self.terms) else np.zeros(0, np.float32)

    @classmethod
    def of(cls, parts: dict) -> Index:
        """An index that was built in a task, from its attributes."""
        index = cls.__new__(cls)
        vars(index).update(parts)
        return index

    def walk(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items whose score reaches the threshold, by block-max WAND over the postings of the (distinct) terms."""
        lists = [[self.postings[t][0], self.postings[t][1], 0, t] for t in terms]
        out = []
        while lists:
            lists.sort(key=lambda x: x[0][x[2]])
            total, pivot = 0.0, None
            for k, x in enumerate(lists):
                total += float(self.top[x[3]])
                if total >= threshold:
                    pivot = k
                    break
            if pivot is None:
                break
            item = lists[pivot][0][lists[pivot][2]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]] == item:
                pivot += 1
            block = item // self.per_block
            if sum(float(self.block_max[x[3], block]) for x in lists[:pivot + 1]) < threshold:
                # Nothing up to the end of this block, or to the next list's item, can reach it.
                to = (block + 1) * self.per_block
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0][lists[pivot + 1][2]])
                to = max(to, item + 1)
                moved = lists[:pivot + 1]
            elif lists[0][0][lists[0][2]] == item:
                score = sum(x[1][x[2]] for x in lists[:pivot + 1])
                if score >= threshold:
                    out.append((item, score))
                to, moved = item + 1, lists[:pivot + 1]
            else:
                to, moved = item, [x for x in lists[:pivot] if x[0][x[2]] < item]
            for x in moved:
                x[2] = bisect.bisect_left(x[0], to, x[2])
            lists = [x for x in lists if x[2] < len(x[0])]
        return out

    def search(self, words: Words, threshold: float) -> Iterator[tuple[int, int, int, list[tuple[int, float]]]]:
        """Document, first and last word of the passage, and the items found, over all passages of a slice."""
        if not len(self.terms) or not len(words.hashes):
            return
        at = np.minimum(np.searchsorted(self.terms, words.hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == words.hashes)
        lengths = np.diff(words.bounds)
        stretches = -(-lengths // self.stretch)
        first = np.concatenate([[0], np.cumsum(stretches)])        # stretches of document i: first[i]..first[i+1]
        document = np.repeat(np.arange(len(lengths)), lengths)[hit]
        stretch = first[document] + (hit - words.bounds[document]) // self.stretch
        pairs = np.unique(stretch * len(self.terms) + at[hit])
        if not len(pairs):
            return
        stretch, term = pairs // len(self.terms), pairs % len(self.terms)
        bound = np.bincount(stretch, self.top[term].astype(float), int(first[-1]) + 1)
        follows = np.zeros(int(first[-1]) + 1, bool)               # whether the next stretch is of the same document
        follows[:-1] = True
        follows[first[1:][stretches > 0] - 1] = False
        bound = bound[:-1] + np.where(follows[:-1], bound[1:], 0)
        starts = np.flatnonzero(np.diff(stretch, prepend=-1))
        blocks = np.zeros((int(first[-1]) + 1, BLOCKS), np.float32)
        blocks[stretch[starts]] = np.add.reduceat(self.block_max[term], starts, axis=0)
        blocks = blocks[:-1] + np.where(follows[:-1, None], blocks[1:], 0)
        for s in np.flatnonzero((bound >= threshold) & (blocks.max(axis=1) >= threshold * (1 - 1e-6))):
            mine = term[np.searchsorted(stretch, s):np.searchsorted(stretch, s + (2 if follows[s] else 1))]
            if len(mine) and self.block_max[np.unique(mine)].sum(axis=0).max() >= threshold:
                found = self.walk(np.unique(mine).tolist(), threshold)
                if found:
                    doc = int(np.searchsorted(first, s, "right")) - 1
                    start = int(words.bounds[doc]) + (int(s) - int(first[doc])) * self.stretch
                    yield doc, start, min(start + 2 * self.stretch, int(words.bounds[doc + 1])), found

    def overlap(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the runs of the item's question and answer that stand in the words; 1 where there is nothing to find."""
        question, answer, _, answer_run, question_run = self.runs[item]
        share = lambda wanted, size: float(np.isin(wanted, runs(words, size)).mean()) if len(wanted) and len(words) >= size else float(not len(wanted))
        return share(question, question_run), share(answer, answer_run)

    def half_stands(self, item: int, words: np.ndarray) -> bool:
        """Whether a verbatim stretch of half the words of an item that is one text stands in the words."""
        wanted, question_run = self.in_order[item], self.runs[item][4]
        need = max(1, _half(len(wanted) + question_run - 1) - question_run + 1)
        there = np.isin(wanted, runs(words, question_run)) if len(words) >= question_run else np.zeros(len(wanted), bool)
        gaps = np.flatnonzero(np.concatenate([[True], ~there, [True]]))
        return int(np.diff(gaps).max()) - 1 >= need

    def hits(self, words: Words) -> Iterator[tuple[int, tuple[int, float, float, float]]]:
        """Document of the slice and (item id, score, overlaps) of every retrieved item that is verified, passage by passage."""
        for doc, a, b, found in self.search(words, self.threshold):
            for item, score in found:
                q, s = self.overlap(item, words.hashes[a:b])
                if (q >= self.question and s >= self.answer) or (self.in_order[item] is not None and self.half_stands(item, words.hashes[a:b])):
                    yield doc, (self.ids[item], score / self.raised[item], q, s)


def all_hits(indexes: list[Index], texts: pa.Array) -> Iterator[tuple[int, tuple[int, float, float, float]]]:
    """Row and hit over several indexes; the words of a slice are found once for all of them."""
    for start, end in slices(texts, SLICE):
        words = Words(texts.slice(start, end - start))
        for index in indexes:
            for doc, hit in index.hits(words):
                yield start + doc, hit


def split_item(text: str | None, answer_share: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of question and answer of an item that is one text: its last quarter of words counts as the answer."""
    hashes = Words(pa.array([text or ""])).hashes
    cut = len(hashes) - int(np.ceil(answer_share * len(hashes)))
    return hashes[:cut], hashes[cut:]


def _words_of(items: DataFrame, answer_share: float | None) -> DataFrame:
    """``item, question, answer, n``: the word hashes of every item that has words, as bytes."""
    own = "answer" in items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, questions, answers, sizes = [], [], [], []
            for item, text, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                question, answer = split_item(text, 0.0 if own or answer_share is None else answer_share)
                if own:
                    answer = split_item(told, 0.0)[0]
                if len(question) + len(answer):
                    ids.append(item)
                    questions.append(question.tobytes())
                    answers.append(answer.tobytes())
                    sizes.append(len(question) + len(answer))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(questions, pa.binary()), pa.array(answers, pa.binary()), pa.array(sizes, pa.int64())],
                                             ["item", "question", "answer", "n"])

    columns = [F.col("item_id").cast("long"), F.col("text").cast("string"), (F.col("answer") if own else F.lit(None)).cast("string").alias("answer")]
    return items.select(*columns).mapInArrow(run, "item long, question binary, answer binary, n long")


def indexes(items: DataFrame, part_words: int = PART_WORDS, answer_share: float | None = 0.25, threshold: float = 0.5, question: float = 0.5,
            answer: float = 0.5) -> Iterator[list[Index]]:
    """Indexes over parts of the items (item_id, text), at most ``PARTS_AT_ONCE`` of them in memory. Items without words are left out.

    The answer is the column ``answer`` where the items have one, else the last ``answer_share`` of the text's words, or with None
    there is none and the text is verified as a whole. Number, length and document frequencies are those of all items, so an item
    has the same weights and passages in whatever part it is. Parts are dealt by a hash, about ``part_words`` words each, and built in tasks; the
    driver gets finished parts only, a few at a time.
    """
    ready = store(_words_of(items, answer_share), "items")
    count, words, longest = ready.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    if not count:
        return
    parts = -(-int(words) // part_words)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.frombuffer(q + a, np.uint64)) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), list(map(len, found)))),
                                              pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["part", "word"])

    dealt = ready.withColumn("part", F.pmod(F.xxhash64("item", "question", "answer"), F.lit(parts)))
    has = dealt.select("part", "question", "answer").mapInArrow(distinct, "part long, word long")
    frequencies = has.groupBy("part", "word").agg(F.count("*").alias("here"))
    total = frequencies.groupBy("word").agg(F.sum("here").alias("n"))

    def build(own: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["item", "question", "answer"])
        word = terms["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(word)
        among = Statistics(int(count), int(words), int(longest), word[order], terms["n"].to_numpy(np.int64)[order])
        rows = [(None if pd.isna(i) else int(i), np.frombuffer(q, np.uint64), np.frombuffer(a, np.uint64)) for i, q, a in zip(own["item"], own["question"], own["answer"], strict=True)]
        index = Index(rows, threshold=threshold, among=among)
        index.question, index.answer = question, answer
        return pd.DataFrame({"part": [int(own["part"].iloc[0])], "index": [pickle.dumps(vars(index))]})

    built = store(dealt.groupBy("part").cogroup(frequencies.join(total, "word").groupBy("part")).applyInPandas(build, "part long, index binary"), "indexes")
    for first in range(0, parts, PARTS_AT_ONCE):
        rows = built.where(F.col("part").between(first, first + PARTS_AT_ONCE - 1)).orderBy("part").collect()
        if rows:
            yield [Index.of(pickle.loads(r["index"])) for r in rows]


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5,
          answer_share: float | None = 0.25) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: the best passage per document and item that leaked.

    See ``indexes`` for ``answer_share``. Texts of any length are cut into passages. Of passages with one score the one with the larger overlaps is told. Null and empty texts and items match nothing; a null id is kept as null. Repeated documents with one id are one group. An
    empty table on either side gives no rows.
    """
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def searcher(some):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(batch.column(0)[row].as_py(), *hit) for row, hit in all_hits(some.value, batch.column(1))]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                                 ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
        return run

    for some in indexes(items, PART_WORDS, answer_share, threshold, question, answer):
        found = ready.mapInArrow(searcher(spark.sparkContext.broadcast(some)), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.5, answer: float = 0.5,
                  answer_share: float | None = 0.25) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item leaked. Nothing is shuffled; each index part is one pass more.

    Rows with null or empty text stay, and all rows if there are no items.
    """
    spark, schema = docs.sparkSession, docs.schema

    def cleaner(some):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in all_hits(some.value, batch.column(0))]] = False
                yield pa.RecordBatch.from_arrays([batch.column(1)], ["row"]).filter(pa.array(keep))
        return run

    for some in indexes(items, PART_WORDS, answer_share, threshold, question, answer):
        ready = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
        docs = ready.mapInArrow(cleaner(spark.sparkContext.broadcast(some)), StructType([StructField("row", schema)])).select("row.*")
    return docs
