"""Helpers of the operators in this subpackage: stored intermediate tables, and words and hashes of Arrow text.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. All hashing works on whole Arrow buffers: a
polynomial prefix sum over the bytes gives the hash of every word at once, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 2 << 20   # text handled at once in a task; one longer document is handled alone


# Batches between the JVM and Python are cut by bytes too, so that long texts do not make them large.
RUNTIME = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings that the registered queries and the pipeline set on their session."""
    for name, value in RUNTIME.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode (tests), and an error on a cluster,
    whose executors do not share a folder of one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: a cut that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied in place to a fresh array."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that are the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = constants(256, 11)
_BYTE[65:91] = _BYTE[97:123]
_R = int(constants(1, 12)[0])
_STEP = constants(8, 13)
END_HASH = np.int64(-1)  # stands for the end of a document where one is counted as a token
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        for_both = []
        for base in (_R, pow(_R, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            for_both.append(np.multiply.accumulate(table))
        _powers[size] = tuple(for_both)
    return _powers[size]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0])
    return whole[first:int(offsets[-1])], offsets - first


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text has at most ``limit`` bytes each, or one row that has more."""
    _, offsets = text_buffers(column)
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, rows)
        start = min(end, rows)
    release_memory()


def release_memory() -> None:
    """Gives freed memory back to the machine, as workers live on between stages. Without glibc it does nothing."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words:
    """The words of a slice of documents: byte range, hash (int64) and, per document, its range of words."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffers(column)
        self.data, n = data, len(data)
        inside = ~SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        sums, (_, inverse) = self.sums(), _power_tables(n + 1)
        raw = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        self.hashes = mix(raw ^ (self.ends - self.starts).astype(np.uint64) * _STEP[7])
        self.bounds = np.searchsorted(self.starts, offsets)   # words of document i: bounds[i]..bounds[i+1]

    def sums(self) -> np.ndarray:
        """Prefix sums of the bytes' polynomial: bytes a..b hash to (sums[b] - sums[a]) * inverse power of a."""
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power_tables(len(self.data) + 1)[0][:len(self.data)], out=sums[1:])
        return sums

    def documents(self) -> Iterator[tuple[int, int, int]]:
        for i in range(len(self.bounds) - 1):
            yield i, int(self.bounds[i]), int(self.bounds[i + 1])

    def shingles(self, size: int = 5) -> list[np.ndarray]:
        """Per document the distinct hashes (uint64, ascending) of its runs of ``size`` words.

        A document with fewer words has its whole sequence as the one shingle; without words it has none.
        """
        h = self.hashes
        sums = np.zeros(len(h), np.uint64)
        for k in range(min(size, len(h))):
            sums[:len(h) - k] += h[k:] * _STEP[k]
        full = mix(sums)
        out = []
        for _, a, b in self.documents():
            if b - a >= size:
                out.append(np.unique(full[a:b - size + 1]))
            elif b > a:
                out.append(mix(np.array([(h[a:b] * _STEP[:b - a]).sum() ^ np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
