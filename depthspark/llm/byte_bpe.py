"""Byte-level BPE by a global shuffle of distinct words, and decoding by the table of token bytes.

Texts are split into the model's words (``pretokens``) in blocks of some MB. A block keeps the numbers of its words by position,
and each of its distinct words is exploded to one row, so a word that is everywhere travels once per block and never makes a hot
key. The rows are shuffled by word and sorted, so equal words stand together and are encoded once, wherever they come from;
their ids go back to (block, number), many in a row. Each block then puts its words' ids in place of their positions. Blocks
are stored bucketed by their number, so this last join moves only ids.

Decoding looks every id up in the table of token bytes, which has as many rows as the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthspark.llm.common import new_path, release_memory, slices
from depthspark.llm.pretokens import PATTERN, Pretokens, ragged
from depthspark.llm.token_counts import _where

BLOCK_BYTES = 16 << 20
PACK_ROWS = 1 << 20     # encoded words that a task holds before it sends them
AT_ONCE = 1 << 20       # numbers, positions or ids that are worked on together
_IDS = "doc_id long, ids array<int>"


@functools.cache
def ranks(model: str) -> dict[bytes, int]:
    """The vocabulary file: one token per line, its bytes in base 64 and its id."""
    with open(_where(model), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def _coder(model: str):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(model), special_tokens={})


@functools.cache
def token_bytes(model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of token bytes: start and length by id, and all bytes one behind the other."""
    table = ranks(model)
    tokens = [b""] * (max(table.values(), default=-1) + 1)
    for token, rank in table.items():
        tokens[rank] = token
    lengths = np.array(list(map(len, tokens)), np.int64)
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(tokens), np.uint8)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on, seven bits a byte, the lowest first; the top bit tells that more follow."""
    return b"".join([_packed(numbers[i:i + AT_ONCE]) for i in range(0, len(numbers), AT_ONCE)])


def _packed(numbers: np.ndarray) -> bytes:
    numbers = numbers.astype(np.uint64)
    sizes = np.ones(len(numbers), np.int64)
    for k in range(1, 9):
        sizes += numbers >= np.uint64(1 << 7 * k)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        more = sizes > k
        out[(ends - sizes)[more] + k] = (numbers[more] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | (sizes[more] > k + 1).astype(np.uint8) << 7
    return out.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    data = np.frombuffer(packed, np.uint8)
    out, first = [np.zeros(0, np.int64)], 0
    while first < len(data):
        upto = first + AT_ONCE
        while upto < len(data) and data[upto - 1] >= 128:   # a number is not cut
            upto += 1
        out.append(_unpacked(data[first:upto]))
        first = upto
    return np.concatenate(out)


def _unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        more = starts + k <= ends
        out[more] |= (data[starts[more] + k] & 127).astype(np.int64) << 7 * k
    return out


class _Block:
    """Documents of one block, gathered slice by slice."""

    def __init__(self):
        self.bytes, self.doc_ids, self.counts, self.places, self.keys, self.words, self.n = 0, [], [], [], [], [], 0

    def add(self, doc_ids: pa.Array, texts: pa.Array) -> None:
        words = Pretokens(texts)
        keys, checks, first, place = words.distinct()
        starts, lengths = words.starts[first], words.starts[first + 1] - words.starts[first] if len(first) else first
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        self.words.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(words.data[ragged(starts, lengths)])]))
        self.keys.append(np.stack([keys, checks], axis=1))
        self.doc_ids.append(doc_ids)
        self.counts.append(np.diff(words.bounds))
        self.places.append((place + self.n).astype(np.int32))
        self.n += len(first)
        self.bytes += len(words.data)

    def row(self, number: int) -> pa.RecordBatch:
        """Words are numbered from the most frequent on, so that most numbers are small."""
        keys, places = np.concatenate(self.keys), np.concatenate(self.places)
        # 16 bytes tell words of different slices apart, as they do within a slice.
        same = pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))]).dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.diff(np.maximum.accumulate(same), prepend=np.int32(-1))) if len(same) else np.zeros(0, np.int64)
        self.keys, self.places = [], []
        places = same[places] if len(places) else places
        order = np.argsort(-np.bincount(places, minlength=len(first)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        words = pa.concat_arrays(self.words).take(pa.array(first[order]))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([
            pa.array([number]), one(pa.concat_arrays(self.doc_ids)), one(pa.array(np.concatenate(self.counts).astype(np.int32))),
            pa.array([pack(rank[places])]), one(words)], ["block", "doc_ids", "counts", "places", "words"])


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, doc_ids, counts, places, words``: blocks of whole documents, stored in buckets by ``block``.

    A block holds texts of ``block_bytes`` together; a longer text is a block by itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for start, end in slices(batch.column(1)):
                block.add(batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start))
                if block.bytes >= block_bytes:
                    yield block.row(number)
                    number, block = number + 1, _Block()
                    release_memory()
        if block.doc_ids:
            yield block.row(number)

    spark, name = docs.sparkSession, f"blocks_{uuid.uuid4().hex}"
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    (ready.mapInArrow(run, "block long, doc_ids array<long>, counts array<int>, places binary, words array<binary>")
     .write.format("parquet").option("path", new_path(spark, "blocks")).option("compression", "zstd")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name))
    return spark.table(name)


def encode_words(words: DataFrame, model: str) -> DataFrame:
    """``block, numbers, sizes, ids`` (packed) from ``block, number, word``: every distinct word is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell, held, rows, last = _coder(model)._encode_single_piece, [], 0, (None, None)

        def flush() -> pa.RecordBatch:
            block, number, sizes = (np.concatenate(x) for x in zip(*(h[:3] for h in held), strict=True))
            flat = np.concatenate([h[3] for h in held])
            starts, order = np.cumsum(sizes) - sizes, np.lexsort([number, block])
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            out = [], [], []
            for part in np.split(order, cuts[1:]):
                out[0].append(pack(np.diff(number[part], prepend=0)))
                out[1].append(pack(sizes[part]))
                out[2].append(pack(flat[ragged(starts[part], sizes[part])]))
            return pa.RecordBatch.from_arrays([pa.array(block[order][cuts]), *(pa.array(x, pa.binary()) for x in out)], ["block", "numbers", "sizes", "ids"])

        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            found = []
            for word in coded.dictionary.to_pylist():
                if word != last[0]:   # the rows are sorted, so only the last word can come again
                    last = (word, spell(word))
                found.append(last[1])
            lengths = np.array(list(map(len, found)), np.int64)
            flat = np.array([i for ids in found for i in ids], np.int64)
            place = coded.indices.to_numpy()
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), lengths[place], flat[ragged((np.cumsum(lengths) - lengths)[place], lengths[place])]))
            rows += batch.num_rows
            if rows >= PACK_ROWS:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, "block long, numbers binary, sizes binary, ids binary")


def _reassemble(block: pa.Table, coded: pa.Table) -> pa.Table:
    """The ids of a block's documents: those of its words in the place of every position."""
    parts = [[unpack(x) for x in coded[c].to_pylist()] for c in ("numbers", "sizes", "ids")]
    number, sizes, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.cumsum(n) for n in parts[0]], *parts[1:]))
    order = np.empty(len(number), np.int64)
    order[number] = np.arange(len(number))
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    counts, place = block["counts"].combine_chunks().flatten().to_numpy(), unpack(block["places"][0].as_py()).astype(np.int32)
    ids, bounds, flat = ids.astype(np.int32), np.concatenate([[0], np.cumsum(counts)]), []
    ends = np.zeros(len(counts) + 1, np.int64)
    done = row = 0
    while row < len(counts):   # some documents at a time
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + AT_ONCE, "right")) - 1)
        own = place[bounds[row]:bounds[to]]
        lengths = sizes[own] if len(own) else np.zeros(0, np.int64)
        flat.append(ids[ragged(starts[own], lengths)] if len(own) else np.zeros(0, np.int32))
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends[row + 1:to + 1] = done + upto[bounds[row + 1:to + 1] - bounds[row]]
        done, row = done + int(upto[-1]), to
    values = pa.array(np.concatenate([np.zeros(0, np.int32), *flat]))
    return pa.Table.from_arrays([block["doc_ids"].combine_chunks().flatten(), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], ["doc_id", "ids"])


def encode(docs: DataFrame, model: str = "byte_bpe_50k.tiktoken", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, ids`` per row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have no ids; a null id is kept. Repeated rows give repeated rows, an empty table gives none. Of equal
    words none is preferred, so there are no ties. Writes the blocks into the shared folder when called.
    """
    stored = blocks(docs, block_bytes)
    words = stored.select("block", F.posexplode("words").alias("number", "word"))
    coded = encode_words(words, model)
    return (stored.select("block", "doc_ids", "counts", "places").groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_reassemble, _IDS))


def decode(coded: DataFrame, model: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, ids, decoded``: the bytes of the ids. Null ids are read as none; an id that no token has raises an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, lengths, data = token_bytes(model)
        for batch in batches:
            ids = batch.column(1)
            ends, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
            row = 0
            while row < len(ids):
                to = max(row + 1, int(np.searchsorted(ends, ends[row] + AT_ONCE, "right")) - 1)
                own = flat[ends[row]:ends[to]]
                sizes = lengths[own]
                bounds = np.concatenate([[0], np.cumsum(sizes)])[ends[row:to + 1] - ends[row]]
                text = pa.Array.from_buffers(pa.large_binary(), to - row, [None, pa.py_buffer(bounds), pa.py_buffer(data[ragged(starts[own], sizes)])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), ids.slice(row, to - row), text.cast(pa.binary())], ["doc_id", "ids", "decoded"])
                row = to

    ready = coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return ready.mapInArrow(run, _IDS + ", decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of rows ``doc_id, ids, decoded``; ids count as little-endian 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = batch.column(1).offsets.to_numpy().tolist(), memoryview(batch.column(1).values.to_numpy().astype("<u4")).cast("B")
            hashed = [hashlib.sha256(flat[4 * a:4 * b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(hashed, pa.string()), batch.column(2)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    hashed = decoded.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return hashed.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
