"""Token ids of documents in ORC files, in ascending document order.

ORC keeps the ids as run-length encoded integers in stripes, with row indexes (minimum and maximum per row group) and
Bloom filters on ``doc_id``. Files hold ascending, disjoint ranges of ``doc_id``, so a reader takes stripes in parallel
and a look-up opens only the stripes whose statistics and Bloom filter allow the id.

Encoding splits a slice of documents into the model's words (``pretokens``), tells distinct ones apart by hash, and looks those
up in what the worker has met before, which is a sorted array; only words that are new go to the tokenizer's model, one by
one. The ids of all words are then gathered at once, so no Python object is made per word of a text. Texts that spell a special
token go to the tokenizer whole, and so do all texts if the tokenizer is not byte-level.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depthspark.llm.common import slices, store, text_buffers
from depthspark.llm.pretokens import Pretokens, library_classes, ragged
from depthspark.llm.token_counts import load

CACHE = 1_500_000
_encoders: dict[tuple[str, int], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies spell each byte: itself if printable, else the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordIds:
    """Ids of words by hash, in sorted arrays; whoever adds to it starts a new one behind ``most`` words."""

    def __init__(self, most: int):
        self.most = most
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.lengths, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words, and which are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (self.checks[at] == checks)

    def add(self, keys: np.ndarray, checks: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(flat)] = flat
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.checks, self.starts, self.lengths = (np.insert(old, at, new[order]) for old, new in (
            (self.keys, keys), (self.checks, checks), (self.starts, starts), (self.lengths, lengths)))


class Encoder:
    """Ids of texts by a tokenizers model."""

    def __init__(self, model: str, cache: int = CACHE):
        self.tool, self.known = load(model), WordIds(cache)
        rules = json.loads(self.tool.to_str())
        split = rules["pre_tokenizer"] or {}
        self.by_words = (split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
                         and rules["normalizer"] is None and not rules["model"].get("ignore_merges"))
        self.special = [t["content"].encode() for t in rules["added_tokens"]]
        self.letters, self.spell = _byte_letters(), self.tool.model.tokenize
        self.bytes = {letter: b for b, letter in self.letters.items()}
        self.classes: dict[int, np.ndarray] = {}

    def _split(self, text: str) -> list[str]:
        return [bytes(map(self.bytes.get, word)).decode() for word, _ in self.tool.pre_tokenizer.pre_tokenize_str(text)]

    def _classes(self, column: pa.Array) -> np.ndarray:
        """Classes as the tokenizer sees them, up to the last character that the longest sequences of bytes can be."""
        data, _ = text_buffers(column)
        largest = int(data.max()) if len(data) else 0
        upto = 0x110000 if largest >= 0xF0 else 0x10000 if largest >= 0xE0 else 0x800
        if upto not in self.classes:
            self.classes[upto] = library_classes(self._split, upto)
        return self.classes[upto]

    def _spelled(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and the number of each one's."""
        spell, letters = self.spell, self.letters
        ids = [[t.id for t in spell(word.decode("latin-1").translate(letters))] for word in words]
        return np.array(list(itertools.chain.from_iterable(ids)), np.uint32), np.array(list(map(len, ids)), np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a slice of texts, one text behind the other, and the number of each text's."""
        if not self.by_words:
            return _joined([np.array(e.ids, np.uint32) for e in self.tool.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)])
        words = Pretokens(column, self._classes(column))
        keys, checks, first, place = words.distinct()
        at, found = self.known.find(keys, checks)
        if not found.all():
            if len(self.known.keys) + int((~found).sum()) > self.known.most and found.any():
                self.known = WordIds(self.known.most)   # starts anew with the words of this slice
                found[:] = False
            self.known.add(keys[~found], checks[~found], *self._spelled(words.words(first[~found])))
            at, _ = self.known.find(keys, checks)
        starts, lengths = self.known.starts[at], self.known.lengths[at][place]
        flat = self.known.flat[ragged(starts[place], lengths)]
        counts = np.diff(np.concatenate([[0], np.cumsum(lengths)])[words.bounds])
        raw = words.data.tobytes()
        special = {int(np.searchsorted(words.offsets, m.start(), "right")) - 1 for s in self.special for m in re.finditer(re.escape(s), raw)}
        if special:
            texts = np.split(flat, np.cumsum(counts)[:-1])
            for i in special:
                texts[i] = np.array(self.tool.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
            return _joined(texts)
        return flat, counts


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint32), *texts]), np.array(list(map(len, texts)), np.int64)


def encode_slices(model: str, column: pa.Array, cache: int = CACHE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the column: first row, row behind the last, all ids, and the number of ids of each text."""
    if (model, cache) not in _encoders:
        _encoders[model, cache] = Encoder(model, cache)
    for start, end in slices(column, 2 << 20):
        yield start, end, *_encoders[model, cache].encode(column.slice(start, end - start))


def encode(model: str, column: pa.Array, cache: int = CACHE) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For slices of the column: first row, row behind the last, ids of each text."""
    for start, end, flat, counts in encode_slices(model, column, cache):
        yield start, end, np.split(flat, np.cumsum(counts)[:-1])


def write_tokens(docs: DataFrame, path: str, model: str = "byte_bpe_50k.json", end_id: int = 2, cache: int = CACHE) -> None:
    """Writes ``part, row, doc_id, ids`` as ORC; rows ascend by doc_id (null first), then text, over files and in them.

    ``cache`` bounds the words whose ids a worker keeps, which takes some 50 bytes each. A null text counts as empty and holds the end id alone. Repeated rows are all written, other columns are not.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, end, ids, counts in encode_slices(model, batch.column(1), cache):
                n, ends = end - start, np.cumsum(counts + 1)
                flat = np.insert(ids, np.cumsum(counts), end_id).view(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), batch.column(0).slice(start, n),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))],
                    ["part", "row", "doc_id", "ids"])
                row += n

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, "part int, row long, doc_id long, ids array<int>")
     .write.option("orc.stripe.size", str(16 << 20)).option("orc.create.index", "true").option("orc.row.index.stride", "1000")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, row long, doc_id long, ids array<int>").orc(path)


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, ids`` of some documents; the filter reaches the row indexes and Bloom filters of the files."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` is the number of ids in front of the document. Files are summed side by side; only one sum per file
    meets in one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends, flat = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * a:4 * b]) for a, b in itertools.pairwise(ends.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                                             ["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    rows = store(read_tokens(spark, path).mapInArrow(run, "part int, row long, doc_id long, n_tokens long, ids_crc32 long"), "token-digest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.join(parts, "part").withColumn("start", F.col("offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .select("doc_id", "start", "n_tokens", "ids_crc32"))
