"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as the embedding of its hash beside the sum of the embeddings of all its runs of three to five characters (code
points, with a mark before and behind the word), divided by the root of their number. Windows of ``WINDOW`` words overlap by
``WINDOW - STEP``; a gated recurrent layer runs over each in both directions, attention weighs its places, and a logistic unit reads the weighted mean. A document's score is that of its worst window,
put on the scale of a probability by a logistic fit on a fifth of the sample, which the network is not trained on.

Only documents are labelled, so training takes turns: in each round the worst window of a toxic document stands for it, and
all windows of clean documents are clean, of which the worst and some others are used. Embeddings start from the smoothed log
odds of each feature between toxic and clean training documents. The sample is at most ``per_class`` labelled documents of
each class. Of a sampled document all windows are weighed by those odds, which are counted over the whole texts of the sample first;
the ``most_windows`` that training then gets are the heaviest ones and others that are evenly spread. Scoring takes all windows of all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthspark.llm.common import Words, _power_tables, mix, slices

WINDOW, STEP = 32, 16
RUNS = (3, 4, 5)
CHUNK = 1 << 18         # runs of characters handled at once
BUCKET_BITS = 15
DIMENSIONS, HIDDEN = 8, 8
PER_CLASS, MOST_WINDOWS = 1_500, 256
ROUNDS, LEAST_STEPS, BATCH = 5, 250, 128   # small samples get more rounds, until there were so many steps
SLICE = 1 << 20


class Features:
    """Places in the embedding tables of distinct words, and which of them stands where.

    ``pieces`` gives, chunk by chunk, the words (ascending within a chunk) and the places of their runs of characters, of which
    a word has ``number`` in all.
    """

    def __init__(self, at: np.ndarray, word: np.ndarray, number: np.ndarray, pieces: Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]):
        self.at, self.word, self.number, self.pieces = at, word, number, pieces

    @staticmethod
    def stored(at: np.ndarray, word: np.ndarray, number: np.ndarray, runs: np.ndarray) -> Features:
        """From the places of the runs of all words, one word after the other."""
        def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            owner = np.repeat(np.arange(len(word)), number)
            for i in range(0, len(owner), CHUNK):
                yield owner[i:i + CHUNK], runs[i:i + CHUNK]
        out = Features(at, word, number, pieces)
        out.runs, out.first = runs, np.cumsum(number) - number
        return out

    @staticmethod
    def dense(places: np.ndarray) -> Features:
        """From an array whose last axis has a word and then as many runs for each."""
        flat = places.reshape(-1, places.shape[-1])
        return Features.stored(np.arange(len(flat)).reshape(places.shape[:-1]), flat[:, 0], np.full(len(flat), flat.shape[1] - 1), flat[:, 1:].reshape(-1))

    @staticmethod
    def joined(parts: list[Features]) -> Features:
        first = np.cumsum([0, *(len(p.word) for p in parts)])
        return Features.stored(*(np.concatenate(x) for x in ([p.at + f for p, f in zip(parts, first, strict=False)], [p.word for p in parts],
                                                             [p.number for p in parts], [p.runs for p in parts])))

    def part(self, rows: np.ndarray) -> Features:
        """Of the words that stand in the places ``rows``; only for stored ones."""
        words, at = np.unique(self.at[rows], return_inverse=True)
        number = self.number[words]
        before = np.cumsum(number) - number
        return Features.stored(at, self.word[words], number, self.runs[np.repeat(self.first[words] - before, number) + np.arange(number.sum())])


class Characters:
    """Prefix sums and character borders of a slice, from which the features of any of its words are taken."""

    def __init__(self, words: Words):
        self.words, self.sums, self.inverse = words, words.sums(), _power_tables(len(words.data) + 1)[1]
        self.borders = np.append(np.flatnonzero((words.data & 0xC0) != 0x80), len(words.data))

    def features(self, rows: np.ndarray | slice = slice(None)) -> Features:
        hashes, first, at = np.unique(self.words.hashes[rows], return_index=True, return_inverse=True)
        starts, ends = self.words.starts[rows][first], self.words.ends[rows][first]
        begin = np.searchsorted(self.borders, starts)
        length = np.searchsorted(self.borders, ends) - begin
        per_size = [np.maximum(0, length + 3 - n) for n in RUNS]   # of the word with its two marks

        def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for n, number in zip(RUNS, per_size, strict=True):
                upto = np.concatenate([[0], np.cumsum(number)])
                for low in range(0, int(upto[-1]), CHUNK):
                    high = min(low + CHUNK, int(upto[-1]))
                    a, b = int(np.searchsorted(upto, low, "right")) - 1, int(np.searchsorted(upto, high))
                    owner = np.repeat(np.arange(a, b), np.minimum(upto[a + 1:b + 1], high) - np.maximum(upto[a:b], low))
                    place, chars = np.arange(low, high) - upto[owner], length[owner]
                    marks = (place == 0) + 2 * (place + n == chars + 2)
                    left = self.borders[begin[owner] + np.maximum(place - 1, 0)]
                    right = self.borders[begin[owner] + np.minimum(place + n - 1, chars)]
                    key = ((self.sums[right] - self.sums[left]) * self.inverse[left]) ^ (4 * n + marks).astype(np.uint64)
                    yield owner, (mix(key) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)

        return Features(at, (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), sum(per_size), pieces)

    def stored(self, rows: np.ndarray) -> Features:
        found = self.features(rows)
        owner, runs = (np.concatenate(x) for x in zip((np.zeros(0, int), np.zeros(0, np.int32)), *found.pieces(), strict=True))
        return Features.stored(found.at, found.word, found.number, runs[np.argsort(owner, kind="stable")])


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and number of words of every window; a document without words has none."""
    lengths = np.diff(bounds)
    number = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STEP)), 0)
    document = np.repeat(np.arange(len(lengths)), number)
    place = np.arange(len(document)) - np.repeat(np.cumsum(number) - number, number)
    start = bounds[:-1][document] + place * STEP
    return document, start, np.minimum(WINDOW, bounds[1:][document] - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and the passes over windows. A gate block holds update, reset and candidate, in this order."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = DIMENSIONS, HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"word": draw(1 << BUCKET_BITS, d) * np.float32(0.1), "part": draw(1 << BUCKET_BITS, d) * np.float32(0.1),
                  "in": draw(2 * d, 6 * h), "in_bias": np.zeros(6 * h, np.float32), "forward": draw(h, 3 * h), "backward": draw(h, 3 * h),
                  "attend": draw(2 * h, h), "attend_out": draw(h), "out": draw(2 * h), "out_bias": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def parts(self, places: Features) -> np.ndarray:
        """Per distinct word, the sum over its runs of characters by the root of their number."""
        table = self.p["part"]
        out = np.zeros((len(places.word), table.shape[1]), table.dtype)
        for owner, runs in places.pieces():
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[starts]] += np.add.reduceat(table[runs], starts, axis=0)
        return out / np.sqrt(np.maximum(1, places.number))[:, None].astype(table.dtype)

    def of_words(self, places: Features) -> np.ndarray:
        return np.concatenate([self.p["word"][places.word], self.parts(places)], axis=-1)

    def inputs(self, places: np.ndarray | Features) -> np.ndarray:
        places = places if isinstance(places, Features) else Features.dense(places)
        return self.of_words(places)[places.at]

    def _run(self, gates: np.ndarray, weights: np.ndarray, mask: np.ndarray, order: range, keep: list | None) -> np.ndarray:
        """States of one direction, time first. ``gates``: input part of the gates; masked places hand the state on."""
        h = HIDDEN
        state, out = np.zeros((gates.shape[1], h), gates.dtype), np.empty((*gates.shape[:2], h), gates.dtype)
        for t in order:
            x = gates[t]
            zr = _sigmoid(x[:, :2 * h] + state @ weights[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h:] + (r * state) @ weights[:, 2 * h:])
            m = mask[t]
            if keep is not None:
                keep.append((t, state, z, r, c))
            state = state + (m * z) * (c - state)
            out[t] = state
        return out

    def logits(self, gates: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """``gates`` (time, windows, 6 * hidden), ``mask`` (time, windows, 1) with 1 where a word is."""
        h, steps = HIDDEN, range(len(gates))
        kept = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self._run(gates[:, :, :3 * h], self.p["forward"], mask, steps, kept[0]),
                               self._run(gates[:, :, 3 * h:], self.p["backward"], mask, steps[::-1], kept[1])], axis=2)
        u = np.tanh(both @ self.p["attend"])
        a = np.where(mask[:, :, 0] > 0, u @ self.p["attend_out"], -1e9)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * both).sum(axis=0)
        if keep is not None:
            keep.update(runs=kept, both=both, u=u, a=a, pooled=pooled)
        return pooled @ self.p["out"] + self.p["out_bias"]

    def gradients(self, places: np.ndarray | Features, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss, by back-propagation through time. ``places`` stand as (time, windows)."""
        places = places if isinstance(places, Features) else Features.dense(places)
        h, p, keep, g = HIDDEN, self.p, {}, {}
        x = self.inputs(places)
        gates = x @ p["in"] + p["in_bias"]
        d_logit = (_sigmoid(self.logits(gates, mask, keep)) - y) * weight / max(1e-9, weight.sum())
        both, u, a, pooled = (keep[k] for k in ("both", "u", "a", "pooled"))
        g["out"], g["out_bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_both = a[:, :, None] * d_pooled
        d_a = (both * d_pooled).sum(axis=2)
        d_a = a * (d_a - (a * d_a).sum(axis=0))
        g["attend_out"] = np.tensordot(d_a, u, ((0, 1), (0, 1)))
        d_u = d_a[:, :, None] * p["attend_out"] * (1 - u * u)
        g["attend"] = np.tensordot(both, d_u, ((0, 1), (0, 1)))
        d_both = d_both + d_u @ p["attend"].T
        d_gates = np.zeros_like(gates)
        for side, (name, steps) in enumerate((("forward", keep["runs"][0]), ("backward", keep["runs"][1]))):
            w, d_state, g[name] = p[name], np.zeros((y.shape[0], h), np.float32), np.zeros_like(p[name])
            for t, state, z, r, c in reversed(steps):
                d = d_state + d_both[t, :, side * h:(side + 1) * h]
                m = mask[t]
                d_c = d * m * z * (1 - c * c)
                d_z = d * m * (c - state) * z * (1 - z)
                d_rs = d_c @ w[:, 2 * h:].T
                d_r = d_rs * state * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                d_state = d * (1 - m * z) + d_rs * r + d_zr @ w[:, :2 * h].T
                g[name][:, :2 * h] += state.T @ d_zr
                g[name][:, 2 * h:] += (r * state).T @ d_c
                d_gates[t, :, side * 3 * h:(side + 1) * 3 * h] = np.concatenate([d_zr, d_c], axis=1)
        g["in"], g["in_bias"] = np.tensordot(x, d_gates, ((0, 1), (0, 1))), d_gates.sum(axis=(0, 1))
        d_x = (d_gates @ p["in"].T).reshape(-1, 2 * DIMENSIONS)
        at, size = places.at.reshape(-1), len(places.word)
        per_word = np.column_stack([np.bincount(at, d, size) for d in d_x.T])
        per_word[:, DIMENSIONS:] /= np.sqrt(np.maximum(1, places.number))[:, None]
        g["word"] = np.column_stack([np.bincount(places.word, d, 1 << BUCKET_BITS) for d in per_word[:, :DIMENSIONS].T]).astype(p["word"].dtype)
        g["part"] = np.zeros_like(p["part"])
        for owner, runs in places.pieces():
            g["part"] += np.column_stack([np.bincount(runs, d, 1 << BUCKET_BITS) for d in per_word[owner, DIMENSIONS:].T]).astype(p["part"].dtype)
        return g

    def score_words(self, places: Features, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and logit of every window over the words of several documents."""
        document, start, length = windows(bounds)
        if not len(document):
            return document, np.zeros(0, np.float32)
        gates = np.vstack([self.of_words(places) @ self.p["in"] + self.p["in_bias"], np.zeros((1, 6 * HIDDEN), np.float32)])
        stands = np.append(places.at, len(places.word))
        at = stands[np.where(np.arange(WINDOW)[:, None] < length, start + np.arange(WINDOW)[:, None], len(places.at))]
        mask = (at < len(places.word)).astype(np.float32)[:, :, None]
        out = [self.logits(gates[at[:, i:i + 2048]], mask[:, i:i + 2048]) for i in range(0, len(document), 2048)]
        return document, np.concatenate(out)

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * worst + self.shift)


def _start_from_odds(network: Network, docs: list[Features], y: np.ndarray, least: int = 3) -> dict[str, np.ndarray]:
    """First dimension of the embeddings: log odds of a feature's documents. Features that fewer than ``least`` documents have
    stay zero, so that no document is learnt by heart; returns which ones are in use."""
    used = {}
    for name, own in (("word", lambda d: d.word), ("part", lambda d: d.runs)):
        n = np.zeros((2, 1 << BUCKET_BITS))
        for places, label in zip(docs, y.tolist(), strict=True):
            n[label, np.unique(own(places))] += 1
        odds = np.log((n[1] + 0.5) / (max(1, (y == 1).sum()) + 1)) - np.log((n[0] + 0.5) / (max(1, (y == 0).sum()) + 1))
        network.p[name][:, 0] += np.clip(odds, -2, 4).astype(np.float32) * (0.5 if name == "word" else 0.25)
        used[name] = n.sum(axis=0) >= least
        network.p[name][~used[name]] = 0
    return used


def train(docs: list[tuple[Features, np.ndarray]], y: np.ndarray, share: float, rounds: int = ROUNDS, seeds: tuple[int, ...] = (5, 6, 7)) -> Network:
    """A network from documents as (features of the words kept, bounds of their stretches) with labels 0 or 1.

    ``share`` is the part of toxic ones among all labelled documents; the final scale is fitted to it. One network is trained
    from each seed, and the one with the least log loss on the documents that only set the scale is taken.
    """
    return min((_train(docs, y, share, rounds, seed) for seed in seeds), key=lambda found: found[1])[0]


def _train(docs: list[tuple[Features, np.ndarray]], y: np.ndarray, share: float, rounds: int, seed: int) -> tuple[Network, float]:
    network, rng = Network(seed), np.random.default_rng(seed)
    if not len(y) or len(np.unique(y)) < 2:
        network.scale, network.shift = 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return network, 0.0
    fitted = np.arange(len(y)) % 5 > 0   # the others only set the final scale
    for label in (0, 1):
        if not fitted[y == label].any() or fitted[y == label].all():
            fitted[:] = True
    used = _start_from_odds(network, [d[0] for d, f in zip(docs, fitted, strict=True) if f], y[fitted])
    odds = [(network.p["word"][p.word, 0] + network.parts(p)[:, 0])[p.at] for p, _ in docs]
    cut = [windows(b) for _, b in docs]
    best = [np.array([o[s:s + n].max() for s, n in zip(c[1], c[2], strict=True)]) if len(c[1]) else np.zeros(0) for o, c in zip(odds, cut, strict=True)]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    pool, first_word = Features.joined([d for d, _ in docs]), np.cumsum([0, *(len(d.at) for d, _ in docs)])
    step = turn = 0
    while turn < rounds or step < LEAST_STEPS:
        if turn:
            best = _window_logits(network, docs)
        chosen = []
        for i, logits in enumerate(best):
            if len(logits) and fitted[i]:
                order = np.argsort(-logits, kind="stable")
                chosen += [(i, int(order[0]))] if y[i] else [(i, int(j)) for j in {*order[:3].tolist(), *rng.integers(0, len(order), 4).tolist()}]
        if not chosen:
            break
        turn += 1
        for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // BATCH)):
            picked = [chosen[k] for k in part]
            start, length = (np.array([cut[i][which][j] for i, j in picked]) for which in (1, 2))
            stands = np.arange(WINDOW)[:, None] < length
            places = pool.part((first_word[[i for i, _ in picked]] + start + np.arange(WINDOW)[:, None])[stands])
            at, mask = np.zeros((WINDOW, len(picked)), np.int64), stands.astype(np.float32)[:, :, None]
            at[stands] = places.at
            places.at = at
            label = y[[i for i, _ in picked]].astype(np.float32)
            step += 1
            for k, grad in network.gradients(places, mask, label, np.where(label > 0, 3.0, 1.0).astype(np.float32)).items():
                if k in used:
                    grad[~used[k]] = 0
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                network.p[k] -= (0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    held = np.flatnonzero(~fitted) if not fitted.all() else np.arange(len(y))
    y = y[held]
    worst = np.array([b.max() if len(b) else -5.0 for b in _window_logits(network, [docs[i] for i in held])])
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    x, beta = np.column_stack([worst, np.ones(len(y))]), np.array([1.0, 0.0])
    for _ in range(100):   # Newton with short steps, held near (1, 0) so that separable documents end too
        q = _sigmoid(x @ beta)
        hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + np.eye(2) * 1e-3
        move = np.linalg.solve(hessian, x.T @ (weight * (q - y)) + 1e-3 * (beta - [1.0, 0.0]))
        beta -= move / max(1.0, 4 * np.abs(move).max())
    network.scale, network.shift = float(beta[0]), float(beta[1])
    return network, float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ beta))).sum())


def _window_logits(network: Network, docs: list[tuple[Features, np.ndarray]]) -> list[np.ndarray]:
    out = []
    for first in range(0, len(docs), 100):
        part = docs[first:first + 100]
        at = np.cumsum([0, *(len(p.at) for p, _ in part)])
        bounds = np.concatenate([[0], *(b[1:] + a for (_, b), a in zip(part, at, strict=False))]) if part else np.zeros(1)
        per_doc = np.repeat(np.arange(len(part)), [len(b) - 1 for _, b in part])
        document, logits = network.score_words(Features.joined([p for p, _ in part]), bounds.astype(np.int64))
        owner = per_doc[document]
        out += [logits[owner == k] for k in range(len(part))]
    return out


def window_odds(tables: dict[str, np.ndarray], places: Features, bounds: np.ndarray) -> np.ndarray:
    """The largest log odds of a word in every window, by those of the word and the mean of its runs of characters."""
    network = Network()
    network.p = {"word": tables["word"][:, None], "part": tables["part"][:, None]}
    value = (network.p["word"][places.word, 0] + network.parts(places)[:, 0])[places.at]
    _, start, length = windows(bounds)
    return np.array([value[s:s + n].max() for s, n in zip(start.tolist(), length.tolist(), strict=True)])


def chosen_windows(odds: np.ndarray, most: int) -> np.ndarray:
    """Half of them the heaviest, the rest evenly spread; all where there are few."""
    if len(odds) <= most:
        return np.arange(len(odds))
    heavy = np.argsort(-odds, kind="stable")[:most // 2]
    return np.union1d(heavy, np.linspace(0, len(odds) - 1, most - len(heavy)).astype(int))


def feature_odds(sample: DataFrame) -> dict[str, np.ndarray]:
    """Log odds of each word and run of characters between toxic and clean documents of ``sample`` (doc_id, text, toxic), over whole texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros((2, 2, 1 << BUCKET_BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for start, end in slices(batch.column(1), SLICE):
                words = Words(batch.column(1).slice(start, end - start))
                characters = Characters(words)
                for i, a, b in words.documents():
                    label = batch.column(2)[start + i].as_py()
                    rows[label] += 1
                    own = characters.features(slice(a, b))
                    found[label, 0, np.unique(own.word)] += 1
                    runs = np.zeros(1 << BUCKET_BITS, bool)
                    for _, places in own.pieces():
                        runs[places] = True
                    found[label, 1] += runs
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(found.reshape(-1)[at], rows))], ["at", "n"])

    # At most four numbers for each bucket.
    sums = sample.select("doc_id", "text", "toxic").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    rows = [int(sums.loc[sums["at"] == k, "n"].sum()) for k in (-1, -2)]
    n = np.zeros(4 << BUCKET_BITS)
    sums = sums[sums["at"] >= 0]
    n[sums["at"]] = sums["n"]
    n = n.reshape(2, 2, -1)
    odds = [np.log((n[1, k] + 0.5) / (max(1, rows[1]) + 1)) - np.log((n[0, k] + 0.5) / (max(1, rows[0]) + 1)) for k in (0, 1)]
    return {"word": (0.5 * np.clip(odds[0], -2, 4)).astype(np.float32), "part": (0.25 * np.clip(odds[1], -2, 4)).astype(np.float32)}


def fit(docs: DataFrame, labels: DataFrame, training: Column, per_class: int = PER_CLASS, most_windows: int = MOST_WINDOWS, rounds: int = ROUNDS) -> Network:
    """A network from ``labels`` (doc_id, toxic) where ``training`` holds. A doc_id labelled twice takes its highest label."""
    known = labels.where(training & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    per_label = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1)):
                words = Words(batch.column(1).slice(start, end - start))
                characters, rows = Characters(words), []
                for i, a, b in words.documents():
                    _, first, length = windows(np.array([0, b - a]))
                    if len(first) > most_windows:
                        pick = chosen_windows(window_odds(odds.value, characters.features(slice(a, b)), np.array([0, b - a])), most_windows)
                        kept = np.concatenate([np.arange(a + s, a + s + n) for s, n in zip(first[pick], length[pick], strict=True)])
                        bounds = np.concatenate([[0], np.cumsum(length[pick])])
                    else:
                        kept, bounds = np.arange(a, b), np.array([0, b - a])
                    f = characters.stored(kept)
                    rows.append((batch.column(0)[start + i].as_py(), batch.column(2)[start + i].as_py(), f.at.astype(np.int32).tobytes(), f.word.astype(np.uint16).tobytes(),
                                 f.number.astype(np.int32).tobytes(), f.runs.astype(np.uint16).tobytes(), bounds.astype(np.int64).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)],
                                                 ["doc_id", "toxic", "at", "word", "number", "runs", "bounds"])

    # At most 2 * per_class rows on the broadcast side.
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    odds = docs.sparkSession.sparkContext.broadcast(feature_odds(mine))
    rows = {r.doc_id: r for r in mine.mapInArrow(read, "doc_id long, toxic int, at binary, word binary, number binary, runs binary, bounds binary").orderBy("doc_id", "word", "at").toLocalIterator()}
    sample = [(Features.stored(np.frombuffer(r.at, np.int32), np.frombuffer(r.word, np.uint16), np.frombuffer(r.number, np.int32), np.frombuffer(r.runs, np.uint16)),
               np.frombuffer(r.bounds, np.int64)) for r in rows.values()]
    total = sum(per_label.values())
    return train(sample, np.array([r.toxic for r in rows.values()], int), per_label.get(1, 0) / total if total else 0.0, rounds)


def toxicity_scores(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, toxicity, windows`` per row of ``docs`` (doc_id, text): the probability of its worst window, and their number.

    Null and empty texts have no window and score as a document whose worst logit is -5. Repeated rows are repeated; an empty table
    gives none. Texts of any length are scored window by window.
    """
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worst, number = np.full(batch.num_rows, -np.inf), np.zeros(batch.num_rows, np.int64)
            for start, end in slices(batch.column(1), SLICE):
                words = Words(batch.column(1).slice(start, end - start))
                document, logits = model.value.score_words(Characters(words).features(), words.bounds)
                np.maximum.at(worst, start + document, logits)
                number[start:end] += np.bincount(document, minlength=end - start)
            score = model.value.probability(np.where(number > 0, worst, -5.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(number)], ["doc_id", "toxicity", "windows"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(run, "doc_id long, toxicity double, windows long")
