"""Byte-level BPE against the library, text by text."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from depthspark.llm import byte_bpe
from tests.llm.data import edge_rows, prose, table
from tests.llm.test_pretokens import random_texts
from tests.llm.test_text_ops import ODD


def library(model: str = "byte_bpe_50k.tiktoken"):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(model), "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_numbers_packed_in_bytes(monkeypatch, at_once):
    monkeypatch.setattr(byte_bpe, "AT_ONCE", at_once)
    for numbers in ([], [0], [127, 128, 16383, 16384, 1 << 21, (1 << 56) + 5, 1], range(20_000)):
        assert byte_bpe.unpack(byte_bpe.pack(np.array(numbers, np.int64))).tolist() == list(numbers)


@pytest.mark.parametrize(("model", "block_bytes"), [("byte_bpe_50k.tiktoken", 300), ("byte_bpe_50k.tiktoken", 1 << 20), ("byte_bpe_multi_50k.tiktoken", 2000)])
def test_ids_and_bytes_equal_the_library(spark, model, block_bytes):
    rows = edge_rows() + [(100 + i, t) for i, t in enumerate([*ODD, *random_texts(300, 5), "x" * 5000, "é" * 3000])]
    tool = library(model)
    coded = byte_bpe.encode(table(spark, rows).repartition(5), model, block_bytes)
    got = [(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in byte_bpe.decode(coded, model).collect()]
    want = [(r[0], tuple(tool.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_digests(spark):
    rows, tool = edge_rows(), library()
    ids = {r[0]: tool.encode_ordinary(r[1] or "") for r in rows}
    for r in byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(table(spark, rows)))).collect():
        if r.doc_id is not None:
            text = next(x[1] or "" for x in rows if x[0] == r.doc_id)
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
                len(ids[r.doc_id]), hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(table(spark, [])))).count() == 0


def test_every_distinct_word_is_encoded_once(spark):
    words = spark.createDataFrame([(b, n, w.encode()) for b in range(40) for n, w in enumerate([" the", "x", " of"] + [f" w{i}" for i in range(500)])],
                                  "block long, number int, word binary")
    coded = byte_bpe.encode_words(words, "byte_bpe_50k.tiktoken").collect()
    seen: dict[int, dict[int, list[int]]] = {}
    tool = library()
    for r in coded:
        sizes, ids = byte_bpe.unpack(r.sizes), byte_bpe.unpack(r.ids)
        for n, own in zip(np.cumsum(byte_bpe.unpack(r.numbers)).tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert n not in seen.setdefault(r.block, {})
            seen[r.block][n] = own.tolist()
    want = [tool.encode_ordinary(w) for w in [" the", "x", " of"] + [f" w{i}" for i in range(500)]]
    assert all(own == dict(enumerate(want)) for own in seen.values()) and len(seen) == 40


def test_blocks_are_joined_without_moving_them(spark):
    plan = byte_bpe.encode(table(spark, [(1, prose(1, 50))]))._jdf.queryExecution().executedPlan().toString()
    blocks = plan.split("FlatMapCoGroupsInArrow")[1].split("FlatMap")[0]
    assert "Bucketed: true" in plan and blocks.count("hashpartitioning(block") == 1
