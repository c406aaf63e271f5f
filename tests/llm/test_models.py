"""Mixing, language model, decontamination, quality and toxicity, and the pipeline."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from depthspark.llm import common, decontaminate, knn_quality, mixing, pitman_yor, toxicity
from depthspark.llm.common import Words, store
from depthspark.llm.queries import llm_queries, llm_sql
from tests.llm.data import crc, edge_rows, prose, table, words

SMALL = "/root/testdata/sf0.001"


def plain_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1.0 + i % 3 for i, s in enumerate(order)}
    target, full = {}, set()
    total = sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / share for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 5)
    rng = random.Random(6)
    rows = edge_rows() + [(100 + i, prose(i, rng.choice([3, 7, 7, 20, 55])), "en", rng.choice("aaaaaabcdeé")) for i in range(300)] + [(900 + i, prose(77, 11), "en", "a") for i in range(40)]
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = plain_targets(sizes)
    assert sorted((r.doc_id, r.size, r.source_size) for r in got if r.doc_id is not None) == sorted((r[0], len(words(r[1])), sizes[r[3]]) for r in rows if r[0] is not None)
    taken = Counter()
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s]) or sizes[s] > 50_000
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    kept = mixing.repeated(docs, mixing.mix(docs))
    assert kept.columns == docs.columns and kept.count() == sum(r.copies for r in got)
    assert mixing.mix(table(spark, [])).count() == 0


def test_tilt_is_the_closest_solution():
    rng = np.random.default_rng(1)
    for target in (0.2, 0.9, 1.0, 1.8, 2.9, 3.0, 0.0):
        size, count = np.unique(rng.integers(1, 500, 40)), None
        count = rng.integers(1, 30, len(size))
        have = float((size * count).sum())
        rate = mixing.tilt(size, count, target * have)
        assert math.isclose((rate * size * count).sum(), target * have, rel_tol=1e-6, abs_tol=1e-6)
        free = (rate < 3 - 1e-9) & (rate > 0)
        if 0 < target < 3 and free.sum() > 1:   # log rate is a multiple of size wherever the limit does not bind
            slope = np.log(rate[free]) / size[free]
            assert np.allclose(slope, slope[0], rtol=1e-5, atol=1e-9)


def test_language_model(spark):
    rows = [(i, prose(i % 40, 30) if i % 7 else "the cat sat on the mat " * 4, "en", "a") for i in range(60)] + [r for r in edge_rows() if r[0] != 6] + [(70, "the  cat\nTHE Zebra", "en", "a")]
    got = pitman_yor.score_documents(table(spark, rows), pitman_yor.remainder("doc_id", 5) != 1, contexts=5, frequent=9, sweeps=3, burn_in=1).collect()
    counts = Counter()
    for r in rows:
        if crc(r[0], 5) != 1:
            counts.update([*words(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        tokens = [*words(r[1]), None]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        want[r[0], crc(r[0], 5) != 1, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.learned, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    nothing = pitman_yor.score_documents(table(spark, rows[:3]), F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens, round(r.base_score, 9)) for r in nothing] == [(0, 0, 0.0)] * 3
    assert pitman_yor.score_documents(table(spark, []), F.lit(True)).count() == 0


def test_most_frequent_words(spark):
    words_ = spark.createDataFrame([(i, 10 - i // 3) for i in range(30)] + [(-1, 99)], "word long, n long")
    for most, want in ((0, 0), (1, 0), (3, 3), (5, 3), (6, 6), (29, 27), (30, 30), (99, 30)):
        assert pitman_yor.most_frequent(words_, most).count() == want


def test_seats():
    customers = np.array([0, 1, 2, 5, 300, 100_000])
    key = pitman_yor._keys(np.arange(6), 3)
    tables = pitman_yor.seat(customers, np.full(6, 2.0), 0.5, key)
    assert tables[0] == 0 and tables[1] == 1 and (tables <= customers).all() and (tables[1:] >= 1).all()
    assert (tables == pitman_yor.seat(customers, np.full(6, 2.0), 0.5, key)).all()
    many = pitman_yor.seat(np.full(4000, 3), np.full(4000, 1.0), 0.5, pitman_yor._keys(np.arange(4000), 9))
    # One table with chance (0.5 / 1.5) * (1.5 / 2.5), three with (1 / 1.5) * (1 / 2), by the seating rule.
    assert abs((many == 1).mean() - 0.2) < 0.03 and abs((many == 3).mean() - 1 / 3) < 0.03


def test_walk_finds_all_above_the_threshold():
    rng = random.Random(1)
    items = [(i, *decontaminate.split_item(prose(i, rng.randint(5, 60)))) for i in range(150)]
    index = decontaminate.Index(items)
    for _ in range(200):
        terms, threshold = sorted(rng.sample(range(len(index.terms)), min(60, len(index.terms)))), rng.choice([0.02, 0.1, 0.2])
        scores = Counter()
        for t in terms:
            for i, w in zip(*index.postings[t], strict=True):
                scores[i] += w
        found = [i for i, _ in index.walk(terms, threshold)]
        assert sorted(found) == sorted(i for i, s in scores.items() if s >= threshold + 1e-12 or (i in found and s >= threshold - 1e-12))


def test_leaks_match_brute_force(spark):
    items = [(i, prose(500 + i, 20 + i)) for i in range(30)] + [(40, None), (41, ""), (42, "one two three")]
    rng = random.Random(2)
    rows = edge_rows()
    for i in range(60):
        item = rng.choice(items[:30])[1].split()
        cut = {0: item, 1: item[:len(item) // 3], 2: item[len(item) // 2:]}[i % 3]
        rows.append((200 + i, " ".join([prose(900 + i, rng.randint(0, 150)), *cut, prose(950 + i, rng.randint(0, 90))]), "en", "a"))
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.Index([(i, *decontaminate.split_item(t)) for i, t in items if words(t)])
    want = set()
    for doc_id, text, *_ in rows:
        doc = Words(pa.array([text or ""])).hashes
        for a in range(0, max(1, len(doc)), index.stretch):
            passage = doc[a:a + 2 * index.stretch]
            place = np.searchsorted(index.terms, np.unique(passage)) if len(passage) else []
            score = np.zeros(len(index.ids))
            for t in {int(p) for p, w in zip(place, np.unique(passage), strict=True) if p < len(index.terms) and index.terms[p] == w}:
                score[index.postings[t][0]] += index.postings[t][1]
            for item in np.flatnonzero(score >= 0.5):
                q, s = index.overlap(int(item), passage)
                if q >= 0.5 and s >= 0.5:
                    want.add((doc_id, index.ids[item]))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and {d for d, _ in got} == {200 + i for i in range(60) if i % 3 == 0}
    assert {tuple(r[:2]) for r in decontaminate.leaks(docs, bench.repartition(3)).collect()} == want
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows if r[0] not in {d for d, _ in got})
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, nothing).count() == 0 and decontaminate.without_leaks(docs, nothing).count() == len(rows)
    assert decontaminate.leaks(table(spark, []), bench).count() == 0


def plain_leaks(rows, items, threshold=0.5):
    """The registered mode on lists of words: item by item and passage by passage, with weights from counters."""
    texts = [(i, words(t)) for i, t in items if words(t)]
    df = Counter(w for _, t in texts for w in set(t))
    mean, stretch = sum(len(t) for _, t in texts) / len(texts), max(decontaminate.LEAST_STRETCH, *(len(t) for _, t in texts))
    out = {}
    for doc_id, text, *_ in rows:
        doc = words(text)
        for a in range(0, len(doc), stretch):
            passage = doc[a:a + 2 * stretch]
            for item, t in texts:
                weight = {w: math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w, n in Counter(t).items()}
                total = sum(weight.values())
                half = -(-len(t) // 2)
                least = min(sum(weight[w] for w in set(t[k:k + half])) / total for k in range(len(t) - half + 1))
                score = sum(weight[w] for w in set(passage) & set(t)) / total
                if score * max(1.0, threshold / least * 1.0001) < threshold:
                    continue
                run = min(5, len(t))
                shingles = [tuple(t[k:k + run]) for k in range(len(t) - run + 1)]
                there = {tuple(passage[k:k + run]) for k in range(len(passage) - run + 1)}
                verbatim = any(set(shingles[k:k + max(1, half - run + 1)]) <= there for k in range(len(shingles) - max(1, half - run + 1) + 1))
                if verbatim or sum(x in there for x in set(shingles)) >= 0.5 * len(set(shingles)):
                    out[doc_id, item] = max(out.get((doc_id, item), 0.0), score)
    return out


def test_whole_items_match_brute_force_in_any_parts(spark, monkeypatch):
    items = [(i, prose(500 + i, 12 + 3 * i)) for i in range(25)] + [(30, prose(500, 12)), (31, "one two three"), (32, None), (None, prose(700, 25))]
    rng, rows = random.Random(8), [r for r in edge_rows() if r[0] not in (6, None)]
    for i in range(50):
        item = words(rng.choice(items[:25])[1])
        k = rng.randrange(len(item) // 2 + 1)
        cut = {0: item, 1: item[k:k + len(item) // 3], 2: item[k:k + -(-len(item) // 2)], 3: [w for j, w in enumerate(item) if j % 9]}[i % 4]
        rows.append((200 + i, " ".join([prose(900 + i, rng.randint(0, 120)), *(w.decode() for w in cut), prose(950 + i, rng.randint(0, 60))]), "en", "a"))
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(rows, items)
    found = decontaminate.leaks(docs, bench, answer_share=None).collect()
    got = {(r.doc_id, r.item_id): r.score for r in found}
    assert got.keys() == want.keys() and len(want) > 20 and all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)
    one = {share: sorted(map(str, decontaminate.leaks(docs, bench, answer_share=share).collect())) for share in (None, 0.25)}
    monkeypatch.setattr(decontaminate, "PART_WORDS", 100)
    assert len(list(decontaminate.indexes(bench, 100))) > 1
    assert sum(len(i.ids) for some in decontaminate.indexes(bench, 100) for i in some) == 28
    for share, rows_of_one in one.items():
        assert sorted(map(str, decontaminate.leaks(docs, bench, answer_share=share).collect())) == rows_of_one
        kept = {r.doc_id for r in decontaminate.without_leaks(docs, bench, answer_share=share).collect()}
        assert kept == {r[0] for r in rows} - {r.doc_id for r in decontaminate.leaks(docs, bench, answer_share=share).collect()}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from depthspark.llm import common

    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(RuntimeError):
        common.shared_folder(Far())


def test_counts_beyond_sixteen_bits_are_kept(spark):
    text = "ab " * 70_000
    docs, labels = spark.createDataFrame([(1, text), (2, prose(1, 30))], "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    voters = knn_quality.fit(docs, labels, F.lit(True))
    counts = np.concatenate([c for _, c in knn_quality.term_counts(pa.array([text]))])
    x = voters._weighted(counts) @ voters.space
    assert counts.max() > 65_535 and np.allclose(x / np.linalg.norm(x), voters.vectors[0], atol=1e-5)


def labelled(spark, kind: str):
    rng = random.Random(3)
    rows, marks = edge_rows(), []
    for i in range(300):
        bad = i % 4 == 0
        text = prose(i, 60 + i % 90)
        if bad and kind == "quality":
            text = text.upper().replace(" ", "!! ") if i % 8 else " ".join(w for x in text.split()[:9] for w in [x] * 9)
        if bad and kind == "toxic":
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["nastyword", "awfulthing", "vile" + rng.choice(["one", "two", "six", "ten"])]))
            text = " ".join(w)
        rows.append((1000 + i, text, "en", "a"))
        marks.append((1000 + i, int(bad != (kind == "quality"))))
    marks += [(1, None), (None, 1), (5, 7), (99_999, 1)]
    return rows, marks, table(spark, rows), spark.createDataFrame(marks, f"doc_id long, {kind} int")


def test_quality(spark):
    rows, marks, docs, labels = labelled(spark, "quality")
    voters = knn_quality.fit(docs, labels, pitman_yor.remainder("doc_id", 5) != 0)
    got = [(r.row.doc_id, r.quality_score) for r in knn_quality.quality_scores(docs, voters).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    score, held = dict(got), [(i, y) for i, y in marks if i and i >= 1000 and i < 2000 and crc(i, 5) == 0]
    assert sum((score[i] >= 0.3) == bool(y) for i, y in held) >= 0.95 * len(held)
    assert knn_quality.quality_scores(table(spark, []), voters).count() == 0
    empty = knn_quality.fit(docs, labels.where("false"), F.lit(True))
    assert {r.quality_score for r in knn_quality.quality_scores(docs, empty).collect()} == {0.5}


def test_all_windows_of_a_long_labelled_text_are_weighed(spark):
    clean = [(i, prose(i, 80), 0) for i in range(30)]
    toxic = [(100 + i, f"{prose(200 + i, 20)} nastyword {prose(300 + i, 20)}", 1) for i in range(30)]
    long_text = prose(7, 9000).split()
    long_text.insert(5001, "nastyword")
    rows = [*clean, *toxic, (200, " ".join(long_text), 1), (201, None, 0), (202, "", 1)]
    odds = toxicity.feature_odds(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    words_ = Words(pa.array([" ".join(long_text)]))
    weight = toxicity.window_odds(odds, toxicity.Characters(words_).features(), words_.bounds)
    _, start, length = toxicity.windows(words_.bounds)
    holds = {k for k, (s, n) in enumerate(zip(start, length, strict=True)) if s <= 5001 < s + n}
    picked = toxicity.chosen_windows(weight, 64)
    assert len(weight) > 500 and len(picked) <= 64 and holds <= set(picked.tolist()) and picked[0] == 0 and picked[-1] == len(weight) - 1
    assert toxicity.chosen_windows(weight[:10], 64).tolist() == list(range(10))


def test_votes_are_exact():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 5, (40, knn_quality.TERMS + knn_quality.SHAPES)).astype(np.float32)
    y = np.arange(40) % 2
    voters = knn_quality.Voters(np.ones(knn_quality.TERMS), rows, y, {0: 60, 1: 20}, dimensions=8, neighbours=7)
    test = rng.integers(0, 5, (9, rows.shape[1])).astype(np.float32)
    x = voters._weighted(test) @ voters.space
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for vector, score in zip(x, voters.score(test), strict=True):
        cosine = np.maximum(voters.vectors @ vector, 0)
        near = np.argsort(-cosine)[:7]
        weight = cosine[near].astype(float) ** knn_quality.POWER * np.where(y[near] == 1, 1.0, 3.0)
        assert math.isclose(score, weight @ y[near] / weight.sum(), rel_tol=1e-3, abs_tol=1e-4)


def test_the_sample_is_never_whole_in_memory():
    rng, n = np.random.default_rng(6), 3_000
    row = lambda: rng.integers(0, 3, knn_quality.TERMS + knn_quality.SHAPES, np.uint32)
    packed = [zlib.compress(row().tobytes(), 1) for _ in range(30)]
    sample, labels = knn_quality.Sample(packed * (n // 30)), np.arange(n) % 2
    assert len(sample) == n and sum(len(x) for x in sample) == n
    tracemalloc.start()
    voters = knn_quality.Voters(np.ones(knn_quality.TERMS), sample, labels, {0: 4_000, 1: 2_000})
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < n * (knn_quality.TERMS + knn_quality.SHAPES) * 4
    whole = knn_quality.Voters(np.ones(knn_quality.TERMS), np.vstack(list(sample)), labels, {0: 4_000, 1: 2_000})
    assert np.allclose(voters.vectors @ voters.vectors[0], whole.vectors @ whole.vectors[0], atol=1e-4)


def test_toxicity(spark):
    rows, marks, docs, labels = labelled(spark, "toxic")
    network = toxicity.fit(docs, labels, pitman_yor.remainder("doc_id", 4) != 2)
    got = [(r.doc_id, r.toxicity, r.windows) for r in toxicity.toxicity_scores(docs, network).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s, _ in got)
    score, held = {i: s for i, s, _ in got}, [(i, y) for i, y in marks if i and 1000 <= i < 2000 and crc(i, 4) == 2]
    assert sum((score[i] >= 0.3) == bool(y) for i, y in held) >= 0.9 * len(held)
    assert {n for i, _, n in got if i in (2, 3, 4)} == {0} and next(n for i, _, n in got if i == 6) > 2000
    assert toxicity.toxicity_scores(table(spark, []), network).count() == 0
    assert toxicity.toxicity_scores(docs, toxicity.fit(docs, labels.where("false"), F.lit(True))).where("toxicity > 0.5").count() == 0


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        document, start, length = toxicity.windows(np.array([0, n, n, n + 40]))
        mine = document == 0
        assert sorted({w for s, k in zip(start[mine], length[mine], strict=True) for w in range(s, s + k)}) == list(range(n))
        assert all(b - a == toxicity.STEP for a, b in zip(start[mine][:-1], start[mine][1:], strict=True))


def test_gradients():
    rng = np.random.default_rng(2)
    network = toxicity.Network(3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    places = rng.integers(0, 50, (toxicity.WINDOW, 4, 4))
    mask = np.ones((toxicity.WINDOW, 4, 1))
    mask[20:, 1] = 0
    y, weight = np.array([1.0, 0, 1, 0]), np.array([3.0, 1, 1, 1])

    def loss():
        z = network.logits(network.inputs(places) @ network.p["in"] + network.p["in_bias"], mask)
        return float((weight * np.logaddexp(0, np.where(y > 0, -z, z))).sum() / weight.sum())

    grads = network.gradients(places, mask, y, weight)
    for name, p in network.p.items():
        at = tuple(rng.integers(0, min(s, 40)) for s in p.shape) if name not in ("word", "part") else (int(places[3, 0, 0 if name == "word" else 1]), 2)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert math.isclose((up - down) / 2e-5, grads[name][at], rel_tol=2e-2, abs_tol=2e-6), name


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, SMALL), "stage")
        assert name == "tokens" or out.columns == columns
        if name != "mix":
            assert out.count() <= before
        docs, before = out, out.count()
    assert before > 0 and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("name", llm_queries())
def test_query_runs(spark, name):
    df = llm_queries()[name](spark, SMALL)
    table_ = {"op2_multi_index": "embeddings", "op12_conversation_repair": "conversations"}.get(name, "documents")
    rows_ = spark.read.parquet(f"{SMALL}/{table_}.parquet")
    want = (rows_.select("conv_id").distinct() if table_ == "conversations" else rows_).count()
    assert df.count() == want or "decontaminate" in name
    assert name not in llm_sql() or llm_sql()[name]


def test_language_model_learns_pairs_of_rare_words(spark):
    """Rare words that always follow each other: their pairs count however few words are frequent or cached."""
    rows = [(i, f"{prose(i, 30)} left{i % 25} right{i % 25}", "en", "a") for i in range(100)]
    rows += [(200 + i, f"left{i} right{i}", "en", "a") for i in range(25)] + [(300 + i, f"left{i} right{(i + 1) % 25}", "en", "a") for i in range(25)]
    def score(contexts, frequent):
        got = pitman_yor.score_documents(table(spark, rows), F.col("doc_id") < 200, contexts=contexts, frequent=frequent, sweeps=3, burn_in=1)
        return {r.doc_id: r.score for r in got.collect()}
    few = score(2, 3)
    assert all(few[200 + i] > few[300 + i] + 1.5 for i in range(25))
    many = score(40, 5000)
    assert few.keys() == many.keys() and all(math.isclose(few[i], many[i], rel_tol=1e-9) for i in few)


def test_language_model_over_pairs_adds_up_to_one(spark):
    docs = table(spark, [(i, prose(i % 9, 25) + " a b a b", "en", "a") for i in range(20)])
    counted = store(pitman_yor.word_counts(docs), "words")
    top = pitman_yor.most_frequent(counted, 6).toPandas()
    model = pitman_yor.Restaurants(docs, counted, pitman_yor.Frequent(top["word"].to_numpy()), int(top["n"].min()), counted.count(), 3, 1)
    state = {r.word: r for r in model.state.collect()}
    pairs = {(r.context, r.word): r.n for r in model.pairs.collect()}
    every = pitman_yor.Frequent(np.array(list(state)))
    known = pitman_yor._last(model.state, 3).toArrow()
    back = pitman_yor.Back(every, known, model.sums[-3:], len(state), model.discount, model.parent_discount, model.strength)
    word = np.array([*state, 12345], np.int64)
    for context in [*list(state)[:12], -1, 12345]:
        n = np.array([pairs.get((context, w), 0) for w in word.tolist()])
        assert n.sum() == (state[context].n if context in state else 0)
        assert math.isclose((10.0 ** back.log10(np.full(len(word), context), word, n, 1)).sum(), 1, rel_tol=1e-9)
    for s in range(4):
        assert sum(r.c[s] for r in state.values()) == sum(r.t[s] for r in state.values()) == model.sums[s][0]


def test_parts_of_items_without_answers_are_leaks(spark, tmp_path):
    items = [(i, prose(500 + i, 20 + i)) for i in range(30)] + [(40, ""), (41, "one two three")]
    cuts = {0: lambda w: w[:-(-3 * len(w) // 4)], 1: lambda w: w[len(w) // 2:], 2: lambda w: w[:-(-len(w) // 2)], 3: lambda w: w[len(w) // 4:][:-(-len(w) // 2)],
            4: lambda w: w[:len(w) // 4], 5: lambda w: w[::2]}
    rows = [(100 * k + i, " ".join([prose(900 + i, 70 * (i % 3)), *cut(text.split()), prose(950 + i, 40)]), "en", "a") for k, cut in cuts.items() for i, text in items[:30]]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = {(100 * k + i, i) for k in range(4) for i in range(30)}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.doc_id, r.item_id) for r in llm_queries()["op3_decontaminate"](spark, str(tmp_path)).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()} == {r[0] for r in rows} - {d for d, _ in want}
    told = spark.createDataFrame([(i, " ".join(t.split()[:12]), " ".join(t.split()[12:])) for i, t in items[:30]], "item_id long, text string, answer string")
    whole = table(spark, [(i, t, "en", "a") for i, t in items[:30]] + [(100 + i, " ".join(t.split()[:12]), "en", "a") for i, t in items[:30]])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(whole, told).collect()} == {(i, i) for i in range(30)}


def test_runs_of_characters(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    texts = ["idiot", '"idiot",', "nidiotisch", "плохой", "(плохой)", "a", "é", "idiot"]
    characters = toxicity.Characters(Words(pa.array([" ".join(texts), None])))
    runs = [set(characters.stored(np.array([i])).runs.tolist()) for i in range(len(texts))]
    assert [int(characters.stored(np.array([i])).number.sum()) for i in range(len(texts))] == [max(0, 3 * len(t) - 3) or 1 for t in texts]
    inner = 3 + 2 + 1
    assert len(runs[0] & runs[1]) >= inner and len(runs[0] & runs[2]) >= inner and runs[0] == runs[7]
    assert len(runs[3] & runs[4]) >= 4 + 3 + 2 and not runs[0] & runs[3]
    both = characters.features()
    network = toxicity.Network()
    want = np.array([network.p["part"][characters.stored(np.array([i])).runs].sum(axis=0) / math.sqrt(max(1, 3 * len(t) - 3)) for i, t in enumerate(texts)])
    assert np.allclose(network.parts(both)[both.at], want, atol=1e-5)
    assert 2 * toxicity.STEP <= toxicity.WINDOW


def test_toxic_words_in_marks_and_compounds(spark):
    rows, marks, docs, labels = labelled(spark, "toxic")
    network = toxicity.fit(docs, labels, F.lit(True))
    forms = ['"nastyword",', "(nastyword)", "**nastyword**", "xxnastywordzz"]
    def text(i, w):
        return " ".join([prose(5000 + i, 12), w, prose(6000 + i, 12)])
    new = [(i, text(i, forms[i % 4]), "en", "a") for i in range(40)] + [(100 + i, text(i, prose(7000 + i, 1)), "en", "a") for i in range(40)]
    score = {r.doc_id: r.toxicity for r in toxicity.toxicity_scores(table(spark, new), network).collect()}
    assert sum(score[i] > score[100 + i] for i in range(40)) >= 36


def test_places_by_first_bits():
    rng = np.random.default_rng(4)
    for width, size in ((1, 0), (4, 3), (31, 1000), (64, 1000)):
        keys = np.unique(rng.integers(0, (1 << width) - 1, size, np.uint64, endpoint=True))
        wanted = np.concatenate([keys, rng.integers(0, (1 << width) - 1, 300, np.uint64, endpoint=True), np.array([0, (1 << width) - 1], np.uint64)])
        at, found = pitman_yor.Index(keys, width).find(wanted)
        assert found.tolist() == np.isin(wanted, keys).tolist() and (not size or (keys[at[found]] == wanted[found]).all())
    # Beyond the last number nothing is walked through: a search stays within the numbers that share its first bits.
    index = pitman_yor.Index(np.arange(1000, dtype=np.uint64), 40)
    assert not index.find(np.full(10, (1 << 40) - 1))[1].any()
    buckets = pitman_yor.Buckets(pitman_yor.Frequent(rng.integers(0, 1 << 62, 5000)), 1 << 26)
    context, word = (rng.integers(0, 5001, 400) for _ in range(2))
    bucket, number = buckets.split(buckets.mixed(context, word))
    assert len(set(bucket.tolist())) > 30 and (number >= 0).all()
    for b in set(bucket.tolist()):
        back = buckets.ranks(b, number[bucket == b])
        assert (back[0] == context[bucket == b]).all() and (back[1] == word[bucket == b]).all()


def test_language_model_over_many_buckets_and_blocks(spark, monkeypatch):
    rows = [(i, f"{prose(i, 40)} left{i % 25} right{i % 25} left{i % 7}", "en", "a") for i in range(80)] + edge_rows()
    def score():
        got = pitman_yor.score_documents(table(spark, rows).repartition(3), pitman_yor.remainder("doc_id", 5) != 1, contexts=4, frequent=30, sweeps=3, burn_in=1)
        return sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got.collect())
    one = score()
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 1 << 13)
    monkeypatch.setattr(pitman_yor, "FLUSH_WORDS", 100)
    monkeypatch.setattr(pitman_yor, "CHUNK", 7)
    monkeypatch.setattr(pitman_yor, "AT_ONCE", 50)
    assert score() == one


def test_language_model_stores_no_row_per_pair(spark, tmp_path, monkeypatch):
    rows = [(i, prose(i, 200), "en", "a") for i in range(60)]
    pairs = len({p for r in rows for p in zip(words(r[1]), words(r[1])[1:])})
    for module in (common, pitman_yor):
        monkeypatch.setattr(module, "new_path", lambda _, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}", raising=False)
    assert pitman_yor.score_documents(table(spark, rows), F.lit(True), contexts=3, sweeps=3, burn_in=1).count() == 60
    stored = sum(spark.read.parquet(str(d)).count() for d in tmp_path.iterdir() if not d.name.startswith("words"))
    assert 0 < stored < pairs / 10
