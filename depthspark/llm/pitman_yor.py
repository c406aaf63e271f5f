"""Language-model scores from a hierarchical Pitman-Yor model of words in context.

The vocabulary is open. Every training word, and the start of a text, is a context with a restaurant of its own, whose dishes
are all words that followed it in any training document, and the end. All of these share one parent restaurant over words,
whose base is uniform over the words seen and one share for words never seen. So every pair of neighbours in every training
document is a customer, and the probabilities of all words, the unseen one and the end add up to one in every context.

Seats are sampled by Gibbs sweeps: given the parent's probabilities and a restaurant's tables in the sweep before, the
customers of each dish sit down anew, one after the other (those behind the 64th in blocks of 1/32 of who sits already, with
the normal form of the binomial). The tables become the customers of the parent. Predictive probabilities are averaged over
the sweeps after ``burn_in``. Random numbers are hashes of word, context and sweep, so reruns and repeated tasks agree.

Pairs are counted with a shuffle and kept in buckets, whose number follows the tokens; a bucket is a few rows of arrays. A pair
of two of the ``frequent`` most frequent words is dealt by both, as a number of 31 bits at most, so a hot context lies in all
buckets. A pair with one rarer word lies in that word's bucket, a pair of two rarer words in both of theirs. The history of a
frequent word (its tables as a context, its customers and tables in the parent) is broadcast, that of others lies in their
bucket. Each sweep is a job: pairs seen once keep their one table and are not looked at again; buckets tell each other only the
values of words in pairs of two rarer words. In scoring the scores of the ``contexts * contexts`` most frequent pairs of frequent
words are broadcast as a cache; all other pairs of a text are looked up in their buckets, and the answers meet per block of texts.
Cache and buckets give the same score. Only sums per frequent word and tables of fixed size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthspark.llm.common import END_HASH, Words, mix, new_path, slices, store

CONTEXTS = 1_024
FREQUENT = 1 << 17
SWEEPS, BURN_IN = 5, 2
STRENGTH = 1.0
FLUSH_WORDS = 2_000_000
BUCKET_TOKENS = 1 << 21
CHUNK = 1 << 12          # frequent words whose sums travel together
AT_ONCE = 1 << 17        # pairs scored at once

# Rows of buckets. Merged pairs: once, more (two frequent words), sided (one), pairs of two rarer words at the context's and at the
# word's bucket. Then the words whose state may change, their pairs seen more than once, their states, and what buckets tell others.
ONCE, MORE, SIDED, AT_CONTEXT, AT_WORD, MOVING, SIDES, CROSS, STATE, TOLD, SUMS, DOCS, HALF = range(13)
LISTS = "a array<long>, b array<long>, i array<int>, n array<int>, k array<int>, x array<double>, y array<double>"
PART = f"bucket int, kind int, at long, {LISTS}"
_KINDS = {"a": pa.int64(), "b": pa.int64(), "i": pa.int32(), "n": pa.int32(), "k": pa.int32(), "x": pa.float64(), "y": pa.float64()}


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), *more)


def _slices_of_words(column: pa.Array) -> Iterator[tuple[int, Words]]:
    for start, end in slices(column):
        yield start, Words(column.slice(start, end - start))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all tokens; ``word`` is a 64-bit hash and END_HASH counts the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def flush() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["word", "n"])

        for batch in batches:
            ends += batch.num_rows
            for _, words in _slices_of_words(batch.column(0)):
                held.append(words.hashes.view(np.int64))
                size += len(words.hashes)
                if size >= FLUSH_WORDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END_HASH]), pa.array([ends])], ["word", "n"])

    return _texts(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """The words above the least count that at most ``most`` words exceed."""
    counted = words.where(F.col("word") != int(END_HASH))
    next_count = counted.orderBy(F.desc("n")).limit(most + 1).agg(F.min("n"), F.count("*")).first()
    return counted if next_count[1] <= most else counted.where(F.col("n") > next_count[0])


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    return ((mix(key ^ np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)) + np.uint64(1)) * 2.0 ** -53


def seat(customers: np.ndarray, share: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers sat down in turn.

    ``share`` is (strength + discount * tables of the restaurant) * parent's probability. With n seated at t tables, the
    next opens one with chance share / (share + n - discount * t).
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    rows, seated, step = np.flatnonzero(customers > 1), None, 0
    seated = np.ones(len(rows), np.int64)
    while len(rows):
        block = np.minimum(np.where(seated < 64, 1, seated // 32), customers[rows] - seated)
        chance = share[rows] / (share[rows] + seated - discount * tables[rows])
        u, v = _uniform(key[rows], 2 * step + 1), _uniform(key[rows], 2 * step + 2)
        many = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v) * np.sqrt(block * chance * (1 - chance)) + block * chance
        tables[rows] += np.where(block == 1, u <= chance, np.clip(np.rint(many), 0, block)).astype(np.int64)
        seated += block
        left = seated < customers[rows]
        rows, seated, step = rows[left], seated[left], step + 1
    return tables


def _discount(ones: float, twos: float) -> float:
    """From how many counts are one and two, as for absolute discounting; kept off the ends."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos > 0 else 0.5


def _keys(*parts: np.ndarray | int) -> np.ndarray:
    out = np.uint64(0)
    for part in parts:
        out = mix(np.asarray(part, np.int64).reshape(-1).view(np.uint64) ^ out)
    return out


def neighbours(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Context and word of every token as hashes; END_HASH is the end as a word and the start as a context."""
    h = words.hashes.view(np.int64)
    word = np.insert(h, words.bounds[1:], END_HASH)
    context = np.roll(word, 1)
    context[words.bounds[:-1] + np.arange(len(words.bounds) - 1)] = END_HASH
    return context, word


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _keys(word, context)


class Index:
    """Places of numbers in an ascending array of distinct numbers of ``width`` bits, found by their first bits."""

    def __init__(self, keys: np.ndarray, width: int):
        self.keys = keys.astype(np.uint64)
        first_bits = min(width, len(keys).bit_length() + 1)
        self.shift = np.uint64(width - first_bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << first_bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the array and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        wanted = wanted.astype(np.uint64)
        slot = (wanted >> self.shift).astype(np.int64)
        at, end = self.first[slot].astype(np.int64), self.first[slot + 1]
        more = at + 1 < end
        at[at == len(self.keys)] = 0
        found = self.keys[at] == wanted
        rest = np.flatnonzero(~found & more)
        while len(rest):
            at[rest] += 1
            found[rest] = self.keys[at[rest]] == wanted[rest]
            rest = rest[~found[rest] & (at[rest] + 1 < end[rest])]
        return at, found


class Frequent:
    """The sorted hashes of the frequent words and the start or end; the place of one is its rank."""

    def __init__(self, words: np.ndarray):
        self.sorted = np.unique(np.append(words.astype(np.int64), END_HASH))
        self.index = Index(self._unsigned(self.sorted), 64)

    def _unsigned(self, hashes: np.ndarray) -> np.ndarray:
        return hashes.view(np.uint64) ^ np.uint64(1 << 63)

    def at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.index.find(self._unsigned(np.ascontiguousarray(hashes)))

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """-1 where a word is not frequent."""
        at, found = self.at(hashes)
        return np.where(found, at, -1)


class Buckets:
    """Where pairs and rarer words lie.

    The ranks of two frequent words are one number of ``width`` bits. It is mixed reversibly: the first bits are the bucket, and
    the others, 31 at most, stand for the pair there.
    """

    def __init__(self, frequent: Frequent, tokens: int):
        self.bits = max(1, (len(frequent.sorted) - 1).bit_length())
        self.spread = max(0, 2 * self.bits - 31, (tokens // BUCKET_TOKENS).bit_length())
        self.width = max(2 * self.bits, self.spread + 1)
        self.odd, self.half = 0x9E3779B97F4A7C15 % (1 << self.width), (self.width + 1) // 2

    def _times(self, x: np.ndarray, by: int) -> np.ndarray:
        return (x * np.uint64(by)) & np.uint64((1 << self.width) - 1)

    def mixed(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of pairs of ranks, evenly spread."""
        x = self._times((context.astype(np.uint64) << np.uint64(self.bits)) | word.astype(np.uint64), self.odd)
        return self._times(x ^ (x >> np.uint64(self.half)), self.odd)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket, and number in it, of mixed pairs."""
        low = np.uint64(self.width - self.spread)
        return (x >> low).astype(np.int32), (x & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int32)

    def ranks(self, bucket: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        back = pow(self.odd, -1, 1 << self.width)
        x = self._times(number.astype(np.uint64) | np.uint64(bucket << self.width - self.spread), back)
        x = self._times(x ^ (x >> np.uint64(self.half)), back)
        return (x >> np.uint64(self.bits)).astype(np.int64), (x & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes.view(np.uint64) >> np.uint64(1)) >> np.uint64(63 - self.spread)).astype(np.int32)


def _rows(kind: int, bucket: np.ndarray, at: np.ndarray, cuts: np.ndarray, **lists: np.ndarray | pa.Array) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(bucket, np.int32)), pa.array(np.full(len(bucket), kind, np.int32)), pa.array(np.asarray(at, np.int64))]
    for name, element in _KINDS.items():
        if name in lists:
            values = lists[name] if isinstance(lists[name], pa.Array) else pa.array(np.ascontiguousarray(lists[name]))
            columns.append(pa.ListArray.from_arrays(pa.array(np.asarray(cuts, np.int32)), values.cast(element)))
        else:
            columns.append(pa.nulls(len(bucket), pa.list_(element)))
    return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "at", *_KINDS])


def _row(kind: int, bucket: int, at: int = 0, **lists: np.ndarray | pa.Array) -> pa.RecordBatch:
    return _rows(kind, [bucket], [at], [0, len(next(iter(lists.values())))], **lists)


def _dealt(kind: int, by: np.ndarray, at: int | None = 0, **lists: np.ndarray) -> pa.RecordBatch:
    """One row per bucket, or per block of texts where ``at`` is None, with its part of the lists, in their order."""
    order = np.argsort(by.astype(np.int16) if at is not None and by.max(initial=0) < 1 << 15 else by, kind="stable")
    names, first = np.unique(by[order], return_index=True)
    rest = np.zeros(len(names), np.int64)
    return _rows(kind, *((rest, names) if at is None else (names, rest + at)), np.append(first, len(order)), **{k: v[order] for k, v in lists.items()})


def _chunks(bucket: int, sums: np.ndarray) -> pa.RecordBatch:
    """Sums per frequent word, ``CHUNK`` words a row; all lists of one chunk follow each other."""
    each = [sums[:, i:i + CHUNK].reshape(-1) for i in range(0, sums.shape[1], CHUNK)]
    return _rows(SUMS, np.full(len(each), bucket), np.arange(len(each)), np.cumsum([0, *map(len, each)]), a=np.concatenate(each).astype(np.int64))


def _totals(rows: DataFrame, lists: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of all SUMS rows: of the numbers in ``at`` -1 (five at most), and ``lists`` of them per frequent word."""
    def add(key: tuple, table: pa.Table) -> pa.Table:
        values = table["a"].combine_chunks()
        return pa.table({"at": [key[0].as_py()], "a": pa.array([values.flatten().to_numpy().reshape(len(values), -1).sum(axis=0)], pa.list_(pa.int64()))})

    found = rows.where(F.col("kind") == SUMS).select("at", "a").groupBy("at").applyInArrow(add, "at long, a array<long>").toArrow()
    numbers, out = np.zeros(5, np.int64), np.zeros((lists, size), np.int64)
    for at, values in zip(found["at"].to_pylist(), found["a"], strict=True):
        values = values.values.to_numpy()
        if at < 0:
            numbers[:len(values)] = values
        else:
            out[:, at * CHUNK:(at + 1) * CHUNK] = values.reshape(lists, -1)
    return numbers, out


class _Group:
    """The rows of one bucket, or of one block of texts, by kind."""

    def __init__(self, table: pa.Table):
        self.table, self.kinds, self.at = table.combine_chunks(), table["kind"].to_numpy(), table["at"].to_numpy()

    def rows(self, kind: int) -> np.ndarray:
        return np.flatnonzero(self.kinds == kind)

    def get(self, kind: int, *names: str, at: int | None = None) -> list[np.ndarray]:
        """The named lists of all rows of a kind, one after the other; "at" gives the row's for each element of its list ``i``."""
        rows = self.rows(kind)
        if at is not None:
            rows = rows[self.at[rows] == at]
        part, out = self.table.take(pa.array(rows)), []
        for name in names:
            if not len(rows):
                out.append(np.zeros(0, np.int64 if name == "at" else _KINDS[name].to_pandas_dtype()))
            elif name == "at":
                out.append(np.repeat(self.at[rows], part["i"].combine_chunks().value_lengths().to_numpy()))
            else:
                out.append(part[name].combine_chunks().flatten().to_numpy(zero_copy_only=False))
        return out


def _find(among: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in a sorted array and whether it is there."""
    if not len(among):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(among, wanted), len(among) - 1)
    return at, among[at] == wanted


def _keep(rows: DataFrame, name: str) -> DataFrame:
    """Like ``store``, with a folder per kind."""
    path = new_path(rows.sparkSession, name)
    rows.write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(PART).parquet(path).select(*rows.columns)


def _counted(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each key, in ascending order, and the sum of its counts."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, np.int64)
    return order[start], np.add.reduceat(n[order].astype(np.int64), start) if len(key) else np.zeros(0, np.int64)


def _ranks_of(frequent: Frequent, words: Words, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of ``neighbours``."""
    rank = frequent.ranks(word)
    before = np.roll(rank, 1)
    before[words.bounds[:-1] + np.arange(len(words.bounds) - 1)] = frequent.ranks(np.array([END_HASH]))[0]
    return before, rank


def _sided(buckets: Buckets, context: np.ndarray, word: np.ndarray, rc: np.ndarray, rw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs with one rarer word: its bucket, its hash, and the rank of the other, with the last bit set where that is the context."""
    rare = np.where(rc < 0, context, word)
    return buckets.of_words(rare), rare, np.where(rc < 0, rw << 1, rc << 1 | 1).astype(np.int32)


def pair_counts(docs: DataFrame, frequent: Frequent, buckets: Buckets) -> DataFrame:
    """Rows of buckets with the counts of all pairs, and with sums of tables and customers per frequent word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            both, context, word, rc, rw = (np.concatenate(x) for x in zip(*held, strict=True))
            both, n = np.unique(both, return_counts=True)
            bucket, number = buckets.split(both)
            yield _dealt(MORE, bucket, i=number, n=n)
            first, n = _counted(pair_key(context, word), np.ones(len(word), np.int64))
            context, word, rc, rw = context[first], word[first], rc[first], rw[first]
            none = (rc < 0) & (rw < 0)
            one = ~none
            bucket, rare, other = _sided(buckets, context[one], word[one], rc[one], rw[one])
            yield _dealt(SIDED, bucket, a=rare, i=other, n=n[one])
            for kind, home in ((AT_CONTEXT, context[none]), (AT_WORD, word[none])):
                yield _dealt(kind, buckets.of_words(home), a=context[none], b=word[none], n=n[none])

        for batch in batches:
            for _, words in _slices_of_words(batch.column(0)):
                context, word = neighbours(words)
                rc, rw = _ranks_of(frequent, words, word)
                both = (rc >= 0) & (rw >= 0)
                held.append((buckets.mixed(rc[both], rw[both]), *(x[~both] for x in (context, word, rc, rw))))
                size += len(word)
                if size >= FLUSH_WORDS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        bucket, group, size = key[0].as_py(), _Group(table), len(frequent.sorted)
        number, n = group.get(MORE, "i", "n")
        first, n = _counted(number, n)
        number = number[first]
        out = [_row(ONCE, bucket, i=number[n == 1]), _row(MORE, bucket, i=number[n > 1], n=n[n > 1])]
        counts = [n]
        sums = np.zeros((4, size), np.int64)      # tables and customers of pairs seen once, of all pairs
        for some, at in ((n == 1, 0), (n > 0, 2)):
            for k, ranks in enumerate(buckets.ranks(bucket, number[some])):
                sums[at + k] += np.bincount(ranks, minlength=size)
        rare, other, n = group.get(SIDED, "a", "i", "n")
        names, at = np.unique(rare, return_inverse=True)
        first, n = _counted(at.astype(np.int64) << 32 | other, n)
        rare, other = rare[first], other[first]
        out.append(_row(SIDED, bucket, a=rare, i=other, n=n))
        counts.append(n)
        for some, at in ((n == 1, 0), (n > 0, 2)):
            for side in (0, 1):      # the other one is the word, or the context
                sums[at + 1 - side] += np.bincount(other[some & (other & 1 == side)] >> 1, minlength=size)
        sides = [(rare, other & 1, other >> 1, np.zeros(len(rare), np.int64), n, np.zeros(len(rare), bool))]
        for side, kind in enumerate((AT_CONTEXT, AT_WORD)):
            context, word, n = group.get(kind, "a", "b", "n")
            first, n = _counted(pair_key(context, word), n)
            context, word = context[first], word[first]
            out.append(_row(kind, bucket, a=context, b=word, n=n))
            if kind == AT_CONTEXT:
                counts.append(n)
            own, partner = (context, word) if side == 0 else (word, context)
            sides.append((own, np.full(len(own), side), np.full(len(own), -1), partner, n, np.ones(len(own), bool)))
        own, side, rank, partner, n, cross = (np.concatenate(x) for x in zip(*sides, strict=True))
        names, at = np.unique(own, return_inverse=True)
        add = lambda some, weight=None: np.bincount(at[some], None if weight is None else weight[some], len(names)).astype(np.int64)
        customers, many = add(side == 1), n > 1
        moving = (customers > 1) | (add(many) > 0)
        out.append(_row(MOVING, bucket, a=names[moving], i=add((side == 0) & ~many)[moving], n=add((side == 1) & ~many)[moving], k=add(side == 0, n)[moving]))
        place = np.cumsum(moving) - 1
        mine, theirs = many & ~cross, many & cross
        out.append(_row(SIDES, bucket, i=place[at[mine]], k=rank[mine] << 1 | side[mine], n=n[mine]))
        theirs = np.flatnonzero(theirs)[np.lexsort((partner[theirs], own[theirs], side[theirs]))]
        out.append(_row(CROSS, bucket, i=place[at[theirs]], a=partner[theirs], k=side[theirs], n=n[theirs]))
        counts = np.concatenate(counts)
        out.append(_row(SUMS, bucket, -1, a=np.array([(counts == 1).sum(), (counts == 2).sum(), (customers == 1).sum(), (customers == 2).sum(), (~moving).sum()])))
        return pa.Table.from_batches([*out, _chunks(bucket, sums)])

    return _keep(_texts(docs).mapInArrow(count, PART).groupBy("bucket").applyInArrow(merge, PART), "pairs")


class Back:
    """What is known of words at some sweeps: customers and tables as a context, customers and tables in the parent restaurant.

    ``rows`` holds it for the frequent words, one row per word: [n, tables...], [customers...], [tables in the parent...].
    ``sums`` has the parent's customers and tables of each of those sweeps.
    """

    def __init__(self, frequent: Frequent, known: pa.Table, sums: list[tuple[int, int]], types: int, discount: float, parent_discount: float, strength: float):
        self.frequent, self.discount, self.parent_discount, self.strength, self.types = frequent, discount, parent_discount, strength, types
        self.customers, self.tables = (np.array(x, float) for x in zip(*sums, strict=True))
        at, _ = frequent.at(known["word"].to_numpy())
        self.rows = []
        for name, width in (("t", len(sums) + 1), ("c", len(sums)), ("r", len(sums))):
            out = np.zeros((len(frequent.sorted), width))
            if len(at):
                out[at] = known[name].combine_chunks().flatten().to_numpy().reshape(-1, width)
            self.rows.append(out)

    def parent(self, c: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Per sweep, the parent's probability of words with these customers and tables in it."""
        return (c - self.parent_discount * r + (self.strength + self.parent_discount * self.tables) / (self.types + 1)) / (self.strength + self.customers)

    @cached_property
    def parents(self) -> np.ndarray:
        """``parent`` of the frequent words."""
        return self.parent(self.rows[1], self.rows[2])

    def seats(self, context: np.ndarray, word: np.ndarray, n: np.ndarray, tables: np.ndarray, parent: np.ndarray, sweep: int) -> np.ndarray:
        return seat(n, (self.strength + self.discount * tables) * parent, self.discount, _keys(word, context, sweep))

    def mean_log10(self, key: np.ndarray, n: np.ndarray, known: np.ndarray, parent: np.ndarray, first_sweep: int) -> np.ndarray:
        """Of the mean probability of pairs over the sweeps from ``first_sweep``; ``key`` is the ``pair_key``, ``known`` the
        context's customers and tables, ``n`` how often the pair was seen."""
        total, tables = known[:, 0], known[:, 1:]
        count, many = tables.shape[1] - 1, np.flatnonzero(n > 1)      # one customer has one table
        own = count * np.minimum(n, 1).astype(float)
        for s in range(count if len(many) else 0):
            step = mix(np.uint64(first_sweep + s) ^ key[many])      # _keys(word, context, sweep)
            own[many] += seat(n[many], (self.strength + self.discount * tables[many, s]) * parent[many, s], self.discount, step) - 1
        mean = count * n - self.discount * own + np.einsum("ij,ij->i", self.strength + self.discount * tables[:, 1:], parent[:, 1:])
        return np.log10(mean / count / (self.strength + total))

    def log10(self, context: np.ndarray, word: np.ndarray, n: np.ndarray, first_sweep: int) -> np.ndarray:
        """``mean_log10`` of words by their hashes; those that are not frequent are taken as never seen."""
        known, c, r = (np.where(found[:, None], rows[at], 0) for rows, (at, found) in zip(self.rows, map(self.frequent.at, (context, word, word)), strict=True))
        return self.mean_log10(pair_key(context, word), n, known, self.parent(c, r), first_sweep)


def _last(state: DataFrame, last: int) -> DataFrame:
    return state.select("word", F.concat(F.array("n"), F.slice("t", -last, last)).alias("t"), F.slice("c", -last, last).alias("c"), F.slice("r", -last, last).alias("r"))


class Restaurants:
    """The fitted model: buckets of pairs, the state of the words after each sweep, and what is broadcast of them."""

    def __init__(self, docs: DataFrame, words: DataFrame, frequent: Frequent, least: int, types: int, sweeps: int, burn_in: int, strength: float = STRENGTH):
        self.frequent, self.types, self.burn_in, self.strength, self.spark = frequent, types, burn_in, strength, docs.sparkSession
        self.buckets = Buckets(frequent, words.agg(F.sum("n")).first()[0] or 0)
        self.parts = pair_counts(docs, frequent, self.buckets)
        size = len(frequent.sorted)
        numbers, sums = _totals(self.parts, 4, size)
        self.discount, self.singles = _discount(numbers[0], numbers[1]), int(numbers[4])
        known = words.where((F.col("n") >= least) | (F.col("word") == int(END_HASH))).toArrow()
        self.n = np.zeros(size, np.int64)
        self.n[frequent.at(known["word"].to_numpy())[0]] = known["n"].to_numpy()
        self.once, start = sums[:2], sums[2:]
        self.parent_discount = _discount(numbers[2] + (start[1] == 1).sum(), numbers[3] + (start[1] == 2).sum())
        self.sums, self.t, self.c, self.r, self.states = [], [], [], [], []
        share = self._share(types)
        self._seated(self._moved(None, -1, share), start, -1, share)
        for sweep in range(sweeps):
            back, share = self.spark.sparkContext.broadcast(self.back(1)), self._share(self.sums[-1][1])
            self._seated(self._moved(back, sweep, share), self.once + _totals(self._sit(back, sweep), 2, size)[1], sweep, share)

    def _share(self, before: int) -> float:
        return (self.strength + self.parent_discount * before) / (self.types + 1)

    def _seated(self, moved: DataFrame, sums: np.ndarray, sweep: int, share: float) -> None:
        """Adds a sweep to the history: tables and customers of the frequent words, and their tables in the parent."""
        rare, more = _totals(moved, 2, len(self.n))
        t, c = sums + more
        r = seat(c, np.full(len(c), share), self.parent_discount, _keys(self.frequent.sorted, sweep, 2))
        for history, values in zip((self.t, self.c, self.r, self.states), (t, c, r, moved.where(F.col("kind") != SUMS)), strict=True):
            history.append(values)
        self.sums.append((int(c.sum() + rare[0]) + self.singles, int(r.sum() + rare[1]) + self.singles))

    def back(self, last: int) -> Back:
        lists = (np.stack([self.n, *self.t[-last:]], 1), np.stack(self.c[-last:], 1), np.stack(self.r[-last:], 1))
        known = {k: pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]) for k, x in zip("tcr", lists, strict=True)}
        return Back(self.frequent, pa.table({"word": self.frequent.sorted, **known}), self.sums[-last:], self.types, self.discount, self.parent_discount, self.strength)

    def _sit(self, back, sweep: int) -> DataFrame:
        """New tables of the pairs of two frequent words, as sums for their contexts and for their words."""
        buckets, hashes = self.buckets, self.frequent.sorted

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, len(hashes)))
            for batch in batches:
                for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                    number, n = (batch.column(c)[k].values.to_numpy() for c in "in")
                    context, word = buckets.ranks(bucket, number)
                    own = back.value.seats(hashes[context], hashes[word], n, back.value.rows[0][context, 1], back.value.parents[word, 0], sweep)
                    for into, ranks in zip(sums, (context, word), strict=True):
                        into += np.bincount(ranks, own, len(hashes))
            yield _chunks(0, sums)
        return self.parts.where(F.col("kind") == MORE).mapInArrow(run, PART)

    def _moved(self, back, sweep: int, share: float) -> DataFrame:
        """State of the rarer words after a sweep, what other buckets must know of it, and sums for the frequent words.

        In sweep -1 each pair has one table, and the frequent words have it already.
        """
        hashes, buckets, discount = self.frequent.sorted, self.buckets, self.parent_discount

        def run(key: tuple, table: pa.Table) -> pa.Table:
            group, sums, bucket = _Group(table), np.zeros((2, len(hashes)), np.int64), key[0].as_py()
            names, t, c = group.get(MOVING, "a", "i", "n")
            at, coded, n = group.get(SIDES, "i", "k", "n")
            at_, partner, side_, n_ = group.get(CROSS, "i", "a", "k", "n")
            rank, side = coded >> 1, coded & 1
            if sweep < 0:
                own, own_ = np.ones(len(n), np.int64), np.ones(len(n_), np.int64)
            else:
                b = back.value
                old_t, old_c, old_r = group.get(STATE, "i", "n", "k")
                parent = b.parent(old_c[:, None], old_r[:, None])[:, 0]
                frequent, mine = hashes[rank], names[at]
                own = b.seats(np.where(side == 0, mine, frequent), np.where(side == 0, frequent, mine), n, np.where(side == 0, old_t[at], b.rows[0][rank, 1]),
                              np.where(side == 0, b.parents[rank, 0], parent[at]), sweep)
                for which in (0, 1):
                    sums[1 - which] += np.bincount(rank[side == which], own[side == which], len(hashes)).astype(np.int64)
                to, by, first, second, whose = group.get(TOLD, "a", "b", "i", "n", "k")
                order = np.lexsort((by, to, whose))       # as CROSS is sorted
                first, second, mine = first[order], second[order], names[at_]
                own_ = b.seats(np.where(side_ == 0, mine, partner), np.where(side_ == 0, partner, mine), n_, np.where(side_ == 0, old_t[at_], first),
                               np.where(side_ == 0, b.parent(first[:, None], second[:, None])[:, 0], parent[at_]), sweep)
            t, c = (x + np.bincount(np.concatenate([at[side == k], at_[side_ == k]]), np.concatenate([own[side == k], own_[side_ == k]]), len(names)).astype(np.int64)
                    for k, x in enumerate((t, c)))
            r = seat(c, np.full(len(c), share), discount, _keys(names, sweep, 2))
            out = [_row(STATE, bucket, sweep, i=t, n=c, k=r), _row(SUMS, bucket, -1, a=np.array([c.sum(), r.sum()])),
                   _dealt(TOLD, buckets.of_words(partner), sweep, a=partner, b=names[at_], i=np.where(side_ == 0, t[at_], c[at_]), n=np.where(side_ == 0, 0, r[at_]), k=1 - side_)]
            return pa.Table.from_batches([*out, _chunks(bucket, sums)] if sweep >= 0 else out)

        rows = self.parts.where(F.col("kind").isin(MOVING, SIDES, CROSS))
        if self.states:
            rows = rows.unionByName(self.states[-1])
        return _keep(rows.groupBy("bucket").applyInArrow(run, PART), "state")

    def rows(self, last: int) -> DataFrame:
        """All rows of the buckets that scoring needs, with the last states."""
        out = self.parts.where(F.col("kind").isin(ONCE, MORE, SIDED, AT_CONTEXT, MOVING))
        for state in self.states[-last:]:
            out = out.unionByName(state.where(F.col("kind") == STATE))
        return out

    @property
    def pairs(self) -> DataFrame:
        """``context, word, n`` of every pair."""
        buckets, hashes = self.buckets, self.frequent.sorted

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for kind, part in ((k, batch.slice(i, 1)) for i, k in enumerate(batch.column("kind").to_pylist())):
                    a, b, i, n = (part.column(x).flatten().to_numpy() for x in "abin")
                    if kind in (ONCE, MORE):
                        a, b = (hashes[x] for x in buckets.ranks(part.column("bucket")[0].as_py(), i))
                        n = np.ones(len(i), np.int64) if kind == ONCE else n
                    elif kind == SIDED:
                        a, b = (np.where(i & 1 == side, a, hashes[i >> 1]) for side in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], ["context", "word", "n"])
        return self.parts.where(F.col("kind").isin(ONCE, MORE, SIDED, AT_CONTEXT)).mapInArrow(run, "context long, word long, n long")

    @property
    def state(self) -> DataFrame:
        """``word, n`` and the history ``t, c, r`` of every word: tables as a context, customers and tables in the parent."""
        schema, sweeps, buckets = "word long, n long, t array<long>, c array<long>, r array<long>", len(self.t), self.buckets

        def listed(word: np.ndarray, n: np.ndarray, *histories: np.ndarray) -> pa.Table:
            cuts = pa.array(np.arange(len(word) + 1, dtype=np.int32) * sweeps)
            return pa.table([pa.array(word), pa.array(n.astype(np.int64)), *(pa.ListArray.from_arrays(cuts, pa.array(x.reshape(-1).astype(np.int64))) for x in histories)], ["word", "n", *"tcr"])

        def run(key: tuple, table: pa.Table) -> pa.Table:
            bucket = _Bucket(_Group(table), buckets, sweeps, -1)
            known, c, r = bucket.of(bucket.known)
            return listed(bucket.known, known[:, 0], known[:, 1:], c, r)

        seen = np.flatnonzero(self.n)
        some = listed(self.frequent.sorted[seen], self.n[seen], *(np.stack(x, 1)[seen] for x in (self.t, self.c, self.r)))
        return self.rows(sweeps).groupBy("bucket").applyInArrow(run, schema).unionByName(self.spark.createDataFrame(some.to_pylist(), schema))


class _Bucket:
    """Look-ups in one bucket: counts of pairs, and the histories of its rarer words."""

    def __init__(self, group: _Group, buckets: Buckets, last: int, first_sweep: int):
        self.once, self.more = (Index(group.get(kind, "i")[0], buckets.width - buckets.spread) for kind in (ONCE, MORE))
        self.n_more, = group.get(MORE, "n")
        rare, other, self.n_sided = group.get(SIDED, "a", "i", "n")
        self.names, at = np.unique(rare, return_inverse=True)
        self.sided = at.astype(np.int64) << 32 | other
        context, word, n = group.get(AT_CONTEXT, "a", "b", "n")
        key = pair_key(context, word)
        order = np.argsort(key)
        self.crossed, self.n_crossed = key[order], n[order]
        self.known = np.unique(np.concatenate([rare[other & 1 == 0], context]))      # every word seen is a context
        self.moving, self.n_moving = group.get(MOVING, "a", "k")
        self.history = []
        for name in "ink":
            lists = [group.get(STATE, name, at=s)[0] for s in range(first_sweep, first_sweep + last)]
            self.history.append(np.stack(lists, 1).astype(float) if len(self.moving) else np.zeros((0, last)))

    def frequent(self, number: np.ndarray) -> np.ndarray:
        """How often pairs of two frequent words were seen."""
        at, found = self.more.find(number)
        n = self.once.find(number)[1].astype(np.int64)
        n[found] = self.n_more[at[found]]
        return n

    def one_rare(self, rare: np.ndarray, other: np.ndarray) -> np.ndarray:
        at, known = _find(self.names, rare)
        at, found = _find(self.sided, at.astype(np.int64) << 32 | other)
        return np.where(known & found, self.n_sided[at] if len(self.sided) else 0, 0)

    def two_rare(self, key: np.ndarray) -> np.ndarray:
        at, found = _find(self.crossed, key)
        return np.where(found, self.n_crossed[at] if len(self.crossed) else 0, 0)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[n, tables...], [customers...], [tables in the parent...]; a word that does not move was seen once, one unknown never."""
        width = self.history[0].shape[1]
        seen = _find(self.known, words)[1].astype(float)
        known, c, r = (np.repeat(seen[:, None], w, axis=1) for w in (width + 1, width, width))
        at, found = _find(self.moving, words)
        known[found, 0] = self.n_moving[at[found]]
        for into, values in zip((known[:, 1:], c, r), self.history, strict=True):
            into[found] = values[at[found]]
        return known, c, r


def _least_cached(pairs: DataFrame, most: int) -> int:
    """The count that pairs of frequent words must exceed so that at most ``most`` do; 1 or more."""
    sizes = pairs.where(F.col("kind") == MORE).select(F.explode("n").alias("n")).groupBy("n").agg(F.count("*").alias("pairs"))
    above = sizes.withColumn("above", F.sum("pairs").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))
    return above.where(F.col("above") > most).agg(F.max("n")).first()[0] or 1


class _Scorer:
    """Broadcast part of the model: counts of the frequent words, and the scores of the most frequent pairs."""

    def __init__(self, frequent: Frequent, buckets: Buckets, n: np.ndarray, keys: np.ndarray, log10: np.ndarray, norm: float):
        order = np.argsort(keys)
        self.index, self.log10, self.frequent, self.buckets, self.n = Index(keys[order], buckets.width), log10[order], frequent, buckets, n
        self.base = np.log10((n + 0.5) / norm)

    def score(self, words: Words, first: int) -> tuple[tuple[np.ndarray, ...], list[tuple[np.ndarray, ...]]]:
        """Per document: tokens, known, base and model sums over what is broadcast. Then what buckets are asked, each with its row
        counted from ``first``: pairs of frequent words, pairs with one rarer word, rarer words alone, pairs of two."""
        docs = len(words.bounds) - 1
        context, word = neighbours(words)
        rc, rw = _ranks_of(self.frequent, words, word)
        bounds = words.bounds + np.arange(docs + 1)
        row = np.repeat(np.arange(docs), np.diff(bounds))
        both = np.flatnonzero((rc >= 0) & (rw >= 0))
        mixed = self.buckets.mixed(rc[both], rw[both])
        at, cached = self.index.find(mixed)
        add = lambda at, values: np.bincount(row[at], values, docs)
        common = np.flatnonzero(rw >= 0)
        sums = (np.diff(bounds), add(common, self.n[rw[common]] > 0).astype(np.int64), add(common, self.base[rw[common]]), add(both[cached], self.log10[at[cached]]))
        row = (row + first).astype(np.int32)
        one, two = np.flatnonzero((rc < 0) ^ (rw < 0)), np.flatnonzero((rc < 0) & (rw < 0))
        return sums, [(*self.buckets.split(mixed[~cached]), row[both[~cached]]), (*_sided(self.buckets, context[one], word[one], rc[one], rw[one]), row[one]),
                      (context[two], word[two], row[two])]


def score_documents(docs: DataFrame, training: Column, contexts: int = CONTEXTS, frequent: int = FREQUENT,
                    sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score, perplexity`` per row of ``docs``.

    Learns from the rows where ``training`` holds and scores all rows. Null text is empty: its only token is the end. Repeated
    rows count and are scored each by itself. Without training rows every word is unseen. An empty table gives none.
    """
    spark = docs.sparkSession
    learn = docs.where(training)
    words = store(word_counts(learn), "words")
    n_all, n_types = words.agg(F.sum("n"), F.count("*")).first()
    n_all = n_all or 0
    norm = n_all + 0.5 * (n_types + 1)
    top = most_frequent(words, frequent).toArrow()
    least = min(top["n"].to_pylist(), default=1 << 62)
    some = Frequent(top["word"].to_numpy())
    model = Restaurants(learn, words, some, least, n_types, sweeps, burn_in)
    last = sweeps - burn_in + 1
    back = spark.sparkContext.broadcast(model.back(last))
    buckets, hashes = model.buckets, some.sorted

    def scores(context: np.ndarray, word: np.ndarray, n: np.ndarray, known, parent) -> np.ndarray:
        """``known`` and ``parent`` give the context's and the word's values of a range of the pairs."""
        out = np.zeros(len(n))
        for i in range(0, len(n), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            out[part] = back.value.mean_log10(pair_key(context[part], word[part]), n[part].astype(np.int64), known(part), parent(part), burn_in)
        return out

    def of_ranks(rc: np.ndarray, rw: np.ndarray, n: np.ndarray) -> np.ndarray:
        return scores(hashes[rc], hashes[rw], n, lambda p: back.value.rows[0][rc[p]], lambda p: back.value.parents[rw[p]])

    above = _least_cached(model.parts, contexts * contexts)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                number, n = (batch.column(c)[k].values.to_numpy() for c in "in")
                rc, rw = buckets.ranks(bucket, number[n > above])
                yield pa.RecordBatch.from_arrays([pa.array(buckets.mixed(rc, rw).view(np.int64)), pa.array(of_ranks(rc, rw, n[n > above]))], ["key", "log10"])

    cache = model.parts.where(F.col("kind") == MORE).mapInArrow(often, "key long, log10 double").toArrow()
    scorer = spark.sparkContext.broadcast(_Scorer(some, buckets, model.n, cache["key"].to_numpy(), cache["log10"].to_numpy(), norm))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, docs_, size, n = TaskContext.get().partitionId() << 40, [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, known, base, log10 = (np.concatenate(x) for x in zip(*(d[2] for d in docs_), strict=True))
            ids, learned = (pa.concat_arrays([d[i] for d in docs_]) for i in (0, 1))
            yield _row(DOCS, block % (1 << buckets.spread), block, a=ids, i=learned.cast(pa.int32()), n=tokens, k=known, x=base, y=log10)
            (bucket, number, row), (home, rare, other, row1), (context, word, row2) = (tuple(map(np.concatenate, zip(*x, strict=True))) for x in zip(*held, strict=True))
            yield _dealt(MORE, bucket, block, i=number, n=row)
            yield _dealt(SIDED, home, block, a=rare, i=other, n=row1)
            order = np.arange(len(row2))
            for kind, home in ((AT_CONTEXT, context), (AT_WORD, word)):
                yield _dealt(kind, buckets.of_words(home), block, a=context, b=word, n=row2, i=order)

        for batch in batches:
            for start, part in _slices_of_words(batch.column(0)):
                sums, asked = scorer.value.score(part, n)
                held.append(asked)
                docs_.append((batch.column(1).slice(start, len(sums[0])), batch.column(2).slice(start, len(sums[0])), sums))
                n, size = n + len(sums[0]), size + int(sums[0].sum())
                if size >= FLUSH_WORDS:
                    yield from flush()
                    block, held, docs_, size, n = block + 1, [], [], 0, 0
        if docs_:
            yield from flush()

    def answer(key: tuple, stored: pa.Table, asked: pa.Table) -> pa.Table:
        """Sums per row of each block, documents unchanged, and of pairs of two rarer words what the bucket knows."""
        bucket, group, here = key[0].as_py(), _Group(asked), _Bucket(_Group(stored), buckets, last, burn_in - 1)
        number, row, at = group.get(MORE, "i", "n", "at")
        log10 = of_ranks(*buckets.ranks(bucket, number), here.frequent(number))
        rare, other, row1, at1 = group.get(SIDED, "a", "i", "n", "at")
        names, place = np.unique(rare, return_inverse=True)
        known, c, r = here.of(names)
        parent, rank, first = back.value.parent(c, r), other >> 1, other & 1 == 0      # the rarer one is the context
        log10_ = scores(np.where(first, rare, hashes[rank]), np.where(first, hashes[rank], rare), here.one_rare(rare, other),
                        lambda p: np.where(first[p][:, None], known[place[p]], back.value.rows[0][rank[p]]),
                        lambda p: np.where(first[p][:, None], back.value.parents[rank[p]], parent[place[p]]))
        context, word, row2, order, at2 = group.get(AT_CONTEXT, "a", "b", "n", "i", "at")
        of_context, seen_pair = here.of(context)[0], pair_key(context, word)
        # Every rarer word is the context of one pair; there it is counted as a word too.
        seen = np.concatenate([np.where(first, known[place, 0], 0), of_context[:, 0]])
        base = np.where(np.append(first, np.ones(len(row2), bool)), np.log10((seen + 0.5) / norm), 0)
        blocks, block = np.unique(np.concatenate([at, at1, at2]), return_inverse=True)
        found, place = np.unique(block.astype(np.int64) << 32 | np.concatenate([row, row1, row2]), return_inverse=True)
        add = lambda at, values: np.bincount(at, values, len(found))
        out = [_dealt(SUMS, blocks[found >> 32], None, i=found & (1 << 32) - 1, k=add(place[len(row):], seen > 0).astype(np.int64), x=add(place[len(row):], base),
                      y=add(place[:len(row) + len(row1)], np.append(log10, log10_)))]
        values = np.concatenate([here.two_rare(seen_pair)[:, None], of_context], axis=1).astype(np.int64)
        wide = lambda x, values: np.repeat(x, values.shape[1])
        out.append(_dealt(HALF, wide(at2, values), None, a=wide(seen_pair.view(np.int64), values), b=wide(row2, values), i=wide(order, values), n=values.reshape(-1)))
        word, order, at = group.get(AT_WORD, "b", "i", "at")
        values = np.concatenate(here.of(word)[1:], axis=1).astype(np.int64)
        out.append(_dealt(AT_WORD, wide(at, values), None, i=wide(order, values), n=values.reshape(-1)))
        return pa.concat_tables([asked.filter(pa.array(group.kinds == DOCS)).cast(out[0].schema), pa.Table.from_batches(out)]).select(["at", "kind", *_KINDS])

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        group = _Group(table)
        part = group.table.take(pa.array(group.rows(DOCS)))
        ids, learned, tokens = (part[c].combine_chunks().flatten() for c in "ain")
        known, base, log10 = (part[c].combine_chunks().flatten().to_numpy().copy() for c in "kxy")
        row, k, x, y = group.get(SUMS, "i", "k", "x", "y")
        add = lambda row, values: np.bincount(row, values, len(ids))
        known, base, log10 = known + add(row, k).astype(np.int64), base + add(row, x), log10 + add(row, y)
        values, order, pair, row = group.get(HALF, "n", "i", "a", "b")
        values, order, pair, row = (x.reshape(-1, last + 2) for x in (values, order, pair, row))
        there, order_ = (x.reshape(-1, 2 * last) for x in group.get(AT_WORD, "n", "i"))
        sort, sort_ = np.argsort(order[:, 0]), np.argsort(order_[:, 0])
        values, there, row = values[sort].astype(float), there[sort_].astype(float), row[sort, 0]
        log10 += add(row, back.value.mean_log10(pair[sort, 0].view(np.uint64), values[:, 0].astype(np.int64), values[:, 1:], back.value.parent(there[:, :last], there[:, last:]), burn_in))
        return pa.table([ids, learned.cast(pa.bool_()), tokens.cast(pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(log10)],
                        ["doc_id", "learned", "n_tokens", "n_known", "base_score", "score"])

    asked = _texts(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("learned")).mapInArrow(ask, PART)
    answers = model.rows(last).groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answer, f"at long, kind int, {LISTS}")
    out = answers.groupBy("at").applyInArrow(add_up, "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "learned", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score",
                      F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
