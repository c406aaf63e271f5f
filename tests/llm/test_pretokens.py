"""The splitter over arrays against the splitting pattern and the libraries, and ids of words kept by hash."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import regex

from depthspark.llm import token_counts, token_files
from depthspark.llm.pretokens import PATTERN, Pretokens, library_classes, ragged

PIECES = ["a", "b", "'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "1", "²", "é", "日", "!", "(", " ", "　", "\x85", "😀", "́", "'s", "'ll", "L", "e", "l", "v", "\0"]


def random_texts(n: int, seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    return [None, "", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n))]


def matches(words: Pretokens, i: int) -> list[bytes]:
    return words.words(np.arange(words.bounds[i], words.bounds[i + 1]))


def test_matches_equal_the_pattern():
    texts = random_texts(4000)
    words = Pretokens(pa.array(texts))
    for i, text in enumerate(texts):
        assert matches(words, i) == [m.encode() for m in regex.findall(PATTERN, text or "")]
    assert list(Pretokens(pa.array([], pa.string())).bounds) == [0]
    assert list(Pretokens(pa.array([None, ""])).bounds) == [0, 0, 0]


def test_distinct_matches_and_their_places():
    words = Pretokens(pa.array(random_texts(500, 2)))
    keys, checks, first, place = words.distinct()
    every = words.words(np.arange(len(words.starts) - 1))
    assert [words.words(first)[p] for p in place] == every and len(first) == len(set(every)) == len(set(keys.tolist())) == len(set(checks.tolist()))


def test_classes_of_a_library_split_as_it_does():
    coder = token_files.Encoder("byte_bpe_50k.json")
    texts = [f"x{chr(i)}1 {chr(i)}!" for i in (*range(1, 0x3000, 7), *range(0x2E00, 0xD800, 61), *range(0x10000, 0x3FFFF, 97))]
    words = Pretokens(pa.array(texts), library_classes(coder._split))
    for i, text in enumerate(texts):
        assert [m.decode("latin-1").translate(coder.letters) for m in matches(words, i)] == [w for w, _ in coder.tool.pre_tokenizer.pre_tokenize_str(text)]


def test_ids_are_the_same_however_few_words_are_kept():
    tool = token_counts.load("byte_bpe_50k.json")
    texts = [t or "" for t in random_texts(800, 3)] + ["<|endoftext|> a<|endoftext|>", "b <|endoftext|>"]
    for kept in (1, 50, 10_000):
        for _ in range(2):
            got = [ids.tolist() for _, _, part in token_files.encode("byte_bpe_50k.json", pa.array(texts), kept) for ids in part]
            assert got == [tool.encode(t, add_special_tokens=False).ids for t in texts]


def test_ragged():
    values = np.arange(20)
    assert values[ragged(np.array([3, 0, 10, 5]), np.array([2, 0, 3, 1]))].tolist() == [3, 4, 10, 11, 12, 5]
    assert len(ragged(np.zeros(0, int), np.zeros(0, int))) == 0
