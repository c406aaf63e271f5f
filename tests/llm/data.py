"""Small tables for the tests of the llm subpackage."""

from __future__ import annotations

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n int, node string, key string, tie long, copies int"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "ra", "so", "vi") for b in ("da", "fe", "go", "hu", "jin", "pel", "qua", "ster")]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words))


def table(spark, rows):
    """Documents with more columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(*r, *[None] * (5 - len(r)), "x", 1, "y", "z", 2, 3) for r in rows], SCHEMA)


def edge_rows():
    """Nulls in every column, empty, blank, short, very long and repeated rows."""
    long_text = prose(1, 60_000)
    return [(1, prose(2, 80), "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "en", None), (None, prose(3, 30), "en", "b"),
            (5, "one two", "en", "c"), (6, long_text, "en", "c"), (7, prose(2, 80), None, None), (8, prose(2, 80).upper(), "en", "b"),
            (9, prose(5, 40), "en", "a"), (9, prose(5, 40), "en", "a"), (10, "x", "en", "a"), (11, "one two", "de", "a"), (None, None, None, None)]


def crc(doc_id, by: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % by if doc_id is not None else 0


def words(text) -> list[bytes]:
    return (text or "").encode().lower().split()
