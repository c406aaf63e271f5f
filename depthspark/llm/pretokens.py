"""Pre-tokens of byte-level models, found and hashed for a whole slice of documents at once.

The splitting pattern of these models (``PATTERN``) has one match after the other over all of a text, so a text is a row of
classes (white space, letters, numbers, other) and the matches follow from where the class changes:

- a run of letters, numbers or other characters is one match, with the blank before it where there is one;
- of a run of white space the last character stands apart, if something follows: as that blank, or as a match of its own;
- an apostrophe that begins a match and one of seven endings are a match, what is left of the letters is the next.

All of this is array work over the bytes, in which no Python object is made per match. ``\\p{L}`` and ``\\p{N}`` are taken
from the ``regex`` library once per worker, as a table over all code points.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from depthspark.llm.common import _power_tables, constants, mix, text_buffers

# Fixed value: the splitting pattern of byte-level models.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, BLANK = range(4)
# Fixed value: the code points that the libraries take for white space.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BYTES = constants(256, 21)
_LENGTH = constants(2, 25)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(map(chr, points))
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        for run in regex.finditer(name + "+", every):
            first, last = ord(every[run.start()]), ord(every[run.end() - 1])
            out[first:last + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[_WHITE] = BLANK
    return out


def library_classes(split: Callable[[str], list[str]], upto: int = 0x110000) -> np.ndarray:
    """The class of every code point as a library sees it, which may know another version of Unicode; ``split`` gives its matches.

    All characters of one class are one match where the library agrees, and else several, each of one of its classes.
    """
    out = classes().copy()
    for kind in (OTHER, LETTER, NUMBER):
        points = np.flatnonzero(out[:upto] == kind)
        points = points[(points < 0xD800) | (points > 0xDFFF)]
        pieces = split("".join(map(chr, points[points != 39].tolist())))
        for piece in pieces:
            found = split(f"a{piece[0]}!")
            out[np.frombuffer(piece.encode("utf-32-le"), "<u4")] = LETTER if found[0] != "a" else NUMBER if len(found) == 3 else OTHER
    return out


def byte_classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 text belongs to."""
    out = table[:256][data]
    first = np.flatnonzero(data >= 0xC0)
    if len(first):
        lead = data[first].astype(np.uint32)
        more = 1 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & np.array([0, 0x1F, 0x0F, 0x07], np.uint32)[more]
        for k in (1, 2, 3):
            there = more >= k
            code[there] = code[there] << np.uint32(6) | data[first[there] + k] & np.uint32(0x3F)
        kind = table[code]
        out[first] = kind
        for k in (1, 2, 3):
            there = more >= k
            out[first[there] + k] = kind[there]
    return out


class Pretokens:
    """The matches of a slice of documents: match i is bytes ``starts[i]..starts[i + 1]``; of document d they are ``bounds[d]..bounds[d + 1]``."""

    def __init__(self, column: pa.Array, table: np.ndarray | None = None):
        self.data, self.offsets = text_buffers(column)
        data, n = self.data, len(self.data)
        if not n:
            self.starts, self.bounds = np.zeros(1, np.int64), np.zeros(len(self.offsets), np.int64)
            return
        kind = byte_classes(data, classes() if table is None else table)
        border = np.zeros(n + 1, bool)
        border[self.offsets] = True          # where a text begins or ends
        change = border.copy()
        change[1:n] |= kind[1:] != kind[:-1]
        run = np.flatnonzero(change)
        first, end = run[:-1], run[1:]
        begins = np.zeros(n + 1, bool)
        begins[run] = True
        # White space that something follows: its last character begins a match, and a blank takes the next run with it.
        white = (kind[first] == BLANK) & ~border[end]
        last = end[white] - 1
        for _ in range(2):
            last -= (data[last] & 0xC0) == 0x80
        begins[last] = True
        begins[end[white][data[last] == 32]] = False
        self._endings(kind, border, begins)
        self.starts = np.flatnonzero(begins)
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def _endings(self, kind: np.ndarray, border: np.ndarray, begins: np.ndarray) -> None:
        data, n = self.data, len(self.data)
        mark = np.flatnonzero(data == 39)
        mark = mark[begins[mark] & (mark + 1 < n)]
        mark = mark[~border[mark + 1] & (kind[mark + 1] == LETTER)]
        one = data[mark + 1]
        two = data[np.minimum(mark + 2, n - 1)] * ~border[mark + 2]   # 0 where the text has ended; the sign of the end is the last border
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[mark[short | long] + 1] = False
        for ending, size in ((short, 2), (long, 3)):
            begins[mark[ending] + size] = True   # a letter goes on, another run begins there anyway, or the text ends

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of every match."""
        n = len(self.data)
        powers, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * powers[:n], out=sums[1:])
        raw = np.diff(sums[self.starts]) * inverse[self.starts[:-1]]
        return mix(raw ^ np.diff(self.starts).astype(np.uint64) * _LENGTH[0])

    def checks(self) -> np.ndarray:
        """The first and the last eight bytes and the length of every match in one number."""
        padded = np.concatenate([np.zeros(8, np.uint8), self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))   # the eight bytes from each place on
        first, lengths = eight[self.starts[:-1] + 8], np.diff(self.starts)
        beyond = (8 * (8 - np.minimum(lengths, 8))).astype(np.uint64)
        ends = eight[self.starts[1:]] >> beyond
        return mix(first << beyond ^ _LENGTH[1]) ^ ends * _LENGTH[0] ^ lengths.astype(np.uint64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and checks of the distinct matches, where each stands first, and for every match its place among them.

        Matches are told apart by the hash; should the checks show that it is one for several, by both.
        """
        one, two = self.hashes(), self.checks()
        place = pa.array(one).dictionary_encode().indices.to_numpy().astype(np.int64)   # numbered as they come
        first = np.flatnonzero(np.diff(np.maximum.accumulate(place), prepend=-1)) if len(place) else place
        if (two != two[first][place]).any():
            _, first, place = np.unique(np.rec.fromarrays([one, two]), return_index=True, return_inverse=True)
        return one[first], two[first], first, place

    def words(self, which: np.ndarray) -> list[bytes]:
        """The bytes of some matches."""
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[which].tolist(), self.starts[which + 1].tolist(), strict=True)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of several stretches of an array, one behind the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
