"""Token counts per document with a public subword model; only lengths leave the task.

Texts are encoded in batches of about equal bytes. A long text is cut at single spaces between two ASCII letters or
digits; the model sees a word start there either way (its pieces never run past a word start, and each part gets
the same leading mark), so the lengths of the parts add up to that of the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 256 << 10
PART_CHARS = 16 << 10
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_loaded: dict[str, object] = {}


def _where(model: str) -> str:
    """A path as it is; a bare file name is one of the installed public files."""
    if "/" in model:
        return model
    import public_tokenizers
    return public_tokenizers.path(model)


def load(model: str):
    """The model, loaded once per worker: tokenizers for .json, sentencepiece for .model."""
    if model not in _loaded:
        if model.endswith(".json"):
            from tokenizers import Tokenizer
            _loaded[model] = Tokenizer.from_file(_where(model))
        else:
            import sentencepiece
            _loaded[model] = sentencepiece.SentencePieceProcessor(model_file=_where(model))
    return _loaded[model]


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """``text`` cut at safe spaces into parts of ``size`` characters or a little more; the spaces are left out."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        out.append(text[start:cut.start()])
        start = cut.end()
    out.append(text[start:])
    return out


def _lengths(model: str, texts: list[str]) -> list[int]:
    tool = load(model)
    if model.endswith(".json"):
        return [len(e.ids) for e in tool.encode_batch(texts, add_special_tokens=False)]
    return [len(ids) for ids in tool.encode(texts, num_threads=1)]


def counts(model: str, texts: list[str | None], batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Tokens of each text. Only the piece model is cut into parts; the other library gets whole texts."""
    total = np.zeros(len(texts), np.int64)
    batch, owners, size = [], [], 0

    def flush() -> None:
        nonlocal batch, owners, size
        if batch:
            np.add.at(total, owners, _lengths(model, batch))
        batch, owners, size = [], [], 0

    for i, text in enumerate(texts):
        for part in [text or ""] if model.endswith(".json") else parts(text or ""):
            if part:
                batch.append(part)
                owners.append(i)
                size += len(part)
                if size >= batch_bytes:
                    flush()
    flush()
    return total


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated rows; an empty table gives none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts(model, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "n_bytes", "n_tokens"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    out = ready.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
