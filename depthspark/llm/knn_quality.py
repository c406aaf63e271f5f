"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are the byte trigrams of the whole text, hashed to ``TERMS`` places, and the ``SHAPES`` shapes of words (capitals, marks,
length, same as the word before). A document's row is log(1 + count) times the inverse document frequency, which is
counted over all documents, beside the roots of its shapes' shares; both parts have one length. The singular vectors of the rows of a labelled sample span
the latent space; the sample's vectors and labels are broadcast. Every document's cosines with all of them are computed in
blocks, and its ``neighbours`` nearest (all that tie with the last) vote with their label, weighted by a power of their
similarity and by how many labelled documents of its class each stands for.

The sample is the only part that does not follow the data: at most ``per_class`` labelled documents of each class, those with
the smallest hash of their id. So the broadcast is at most ``2 * per_class * dimensions`` numbers at every size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from depthspark.llm.common import Words, constants, release_memory, slices, text_buffers

TERMS = 4_096
SHAPES = 64
DIMENSIONS = 64
PER_CLASS = 2_000
NEIGHBOURS = 25
POWER = 8
BLOCK = 512
_BYTES = [(constants(256, 21 + k) >> np.uint64(32)).astype(np.uint32) for k in range(3)]


_UPPER, _MARK = np.zeros(256, np.int32), np.zeros(256, np.int32)
_UPPER[65:91] = 1
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def word_shapes(words: Words) -> np.ndarray:
    """Shape of each word, 0 to 63: same as the word before, capitals only, marks (none, one, more, only), length."""
    length = words.ends - words.starts
    upper, marks = (np.concatenate([[0], np.cumsum(table[words.data])]) for table in (_UPPER, _MARK))
    upper, marks = upper[words.ends] - upper[words.starts], marks[words.ends] - marks[words.starts]
    same = np.zeros(len(length), np.int64)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    same[words.bounds[:-1][words.bounds[:-1] < len(same)]] = 0
    capitals = (upper >= 2) & (upper + marks >= length - length // 3)
    return ((same * 2 + capitals) * 4 + np.where(marks == length, 3, np.minimum(marks, 2))) * 4 + np.digitize(length, [2, 5, 10])


def term_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of counts of terms and shapes, in blocks: place of the first row, and counts (float32) of up to ``BLOCK`` rows."""
    for start, end in slices(column):
        data, offsets = text_buffers(column.slice(start, end - start))
        words = Words(column.slice(start, end - start))
        shapes = word_shapes(words)
        terms = np.zeros(0, np.uint32)
        if len(data) > 2:
            terms = (_BYTES[0][data[:-2]] + _BYTES[1][data[1:-1]] + _BYTES[2][data[2:]]) * np.uint32(0x9E3779B1) >> np.uint32(20)
        for first in range(0, end - start, BLOCK):
            last = min(first + BLOCK, end - start)
            rows = np.zeros((last - first, TERMS + SHAPES), np.float32)
            for i in range(first, last):
                a, b = offsets[i], offsets[i + 1] - 2
                if b > a:
                    rows[i - first, :TERMS] = np.bincount(terms[a:b], minlength=TERMS)
                    rows[i - first, TERMS:] = np.bincount(shapes[words.bounds[i]:words.bounds[i + 1]], minlength=SHAPES)
            yield start + first, rows


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents; one row of sums per term and task moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, counts in term_counts(batch.column(0)):
                found += (counts[:, :TERMS] > 0).sum(axis=0)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(found[used], rows))], ["term", "n"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out, (term, n) = np.zeros(TERMS, np.int64), (sums[c].to_numpy() for c in ("term", "n"))
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


class Sample:
    """Counts of the sampled documents, each row compressed; iterating gives them as float32 in blocks of rows."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __iter__(self) -> Iterator[np.ndarray]:
        for first in range(0, len(self), BLOCK):
            raw = b"".join(map(zlib.decompress, self.packed[first:first + BLOCK]))
            yield np.frombuffer(raw, np.uint32).reshape(-1, TERMS + SHAPES).astype(np.float32)


class Voters:
    """Broadcast model: term weights, latent space, and the sample's vectors with labels and weights.

    ``rows`` are the sample's counts, as an array or a ``Sample``. They are weighted anew in each pass over them, so that the
    driver never holds the whole sample as numbers.
    """

    def __init__(self, idf: np.ndarray, rows: np.ndarray | Sample, labels: np.ndarray, per_label: dict[int, int],
                 dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, power: int = POWER):
        self.idf, self.neighbours, self.power = idf.astype(np.float32), neighbours, power
        total = sum(per_label.values())
        self.prior = per_label.get(1, 0) / total if total else 0.5
        self.labels = labels.astype(np.float32)
        self.weights = np.array([per_label[y] / max(1, int((labels == y).sum())) for y in labels.tolist()], np.float32)
        blocks = rows if isinstance(rows, Sample) else [rows[first:first + BLOCK] for first in range(0, len(rows), BLOCK)]
        weighted = lambda: map(self._weighted, blocks)
        self.space = _singular_vectors(weighted, min(dimensions, len(rows), TERMS + SHAPES)) if len(rows) else np.zeros((TERMS + SHAPES, 1), np.float32)
        self.vectors = _unit(np.vstack([np.zeros((0, self.space.shape[1]), np.float32), *(x @ self.space for x in weighted())]))

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        terms, shapes = counts[:, :TERMS], counts[:, TERMS:]
        return _unit(np.hstack([_unit(np.log1p(terms) * self.idf), _unit(np.sqrt(shapes))]))

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of the weighted votes for label 1; the share among the labelled where nothing is near."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        near = np.maximum(_unit(self._weighted(counts) @ self.space) @ self.vectors.T, 0)
        k = min(self.neighbours, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, -k, None]
        votes = np.where(near >= last, near, 0) ** self.power * self.weights
        all_votes = votes.sum(axis=1, dtype=np.float64)
        return np.clip(np.where(all_votes > 0, (votes @ self.labels) / np.where(all_votes > 0, all_votes, 1), self.prior), 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _singular_vectors(blocks: Callable[[], Iterable[np.ndarray]], k: int, rounds: int = 4) -> np.ndarray:
    """The ``k`` leading right singular vectors of the rows in all blocks, by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((TERMS + SHAPES, min(TERMS + SHAPES, k + 16))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(sum(x.T @ (x @ q) for x in blocks()))
    _, _, v = np.linalg.svd(np.vstack([x @ q for x in blocks()]), full_matrices=False)
    return (q @ v.T)[:, :k].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, training: Column, per_class: int = PER_CLASS, **shape: int) -> Voters:
    """Voters from ``labels`` (doc_id, quality) where ``training`` holds. A doc_id labelled twice takes its lowest label."""
    known = labels.where(training & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    per_label = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    chosen = [known.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts in term_counts(batch.column(1)):
                packed = [zlib.compress(c.astype(np.uint32).tobytes(), 1) for c in counts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(packed)), batch.column(2).slice(first, len(packed)), pa.array(packed, pa.binary())],
                                                 ["doc_id", "quality", "counts"])

    # At most 2 * per_class rows on the broadcast side.
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found, total = document_frequencies(docs)
    sample = mine.mapInArrow(rows, "doc_id long, quality int, counts binary").toArrow()
    last = {doc: row for row, doc in enumerate(sample["doc_id"].to_pylist())}
    picked = [last[doc] for doc in sorted(last)]
    counts, known_as = Sample([sample["counts"][k].as_py() for k in picked]), sample["quality"].to_numpy()[np.array(picked, int)].astype(int)
    del sample
    voters = Voters(np.log((1 + total) / (1 + found)) + 0.05, counts, known_as, per_label, **shape)
    del counts
    release_memory()
    return voters


def quality_scores(docs: DataFrame, voters: Voters) -> DataFrame:
    """``quality_score, row`` for every row of ``docs`` by its whole text; ``row`` is a struct of all its columns.

    Null and empty texts, and texts of less than three bytes, have no trigrams and score by their shapes alone, or the share of
    label 1 among the labelled documents (0.5 without any) if no labelled document is near. Repeated rows are repeated; an
    empty table gives none.
    """
    model = docs.sparkSession.sparkContext.broadcast(voters)
    ready = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, counts in term_counts(batch.column(0)):
                scores[first:first + len(counts)] = model.value.score(counts)
            yield pa.RecordBatch.from_arrays([pa.array(scores), batch.column(1)], ["quality_score", "row"])

    return ready.mapInArrow(run, StructType([StructField("quality_score", DoubleType()), ready.schema["row"]]))
