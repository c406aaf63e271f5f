"""Words and hashes, token counts, token files, secret scan."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from depthspark.llm import common, secrets, token_counts, token_files
from tests.llm.data import edge_rows, prose, table, words

ODD = ["", "a", " a", "a ", "  a  b", "a\n\nb \n c", "x\ty", "it's we'LL don't", "12²3 ²", "<|endoftext|>a b", "a\x1cb c", "é à́ b", "日本 語", "a\x00b c",
       "\n", "tab\t\n q", "😀 😀😀", "word, word. Word!", " \n x", "\nThe a", "naïve b c"]


def test_words_match_plain_python():
    texts = [*ODD, None, prose(4, 500), "THE the The"]
    found = common.Words(pa.array(texts))
    seen = {}
    for i, a, b in found.documents():
        plain = words(texts[i])
        assert b - a == len(plain)
        for word, h in zip(plain, found.hashes[a:b].tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_match_plain_sets():
    texts = [None, "", "a", "a b c d", "a b c d e", "a b c d e f a b c d e", "A b C d e", "b a c d"]
    found = common.Words(pa.array(texts)).shingles()
    plain = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in texts]
    for (i, x), (j, y) in itertools.product(enumerate(plain), repeat=2):
        assert len(np.intersect1d(found[i], found[j])) == len(x & y)


@pytest.mark.parametrize("model", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, model):
    rows = edge_rows() + [(100 + i, t) for i, t in enumerate(ODD)]
    tool = token_counts.load(model)
    plain = lambda t: len(tool.encode(t or "") if model.endswith(".model") else tool.encode(t or "", add_special_tokens=False).ids)
    got = token_counts.token_counts(table(spark, rows), model, limit=50).collect()
    want = [(r[0], len((r[1] or "").encode()), plain(r[1]), plain(r[1]) > 50) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(table(spark, []), model).count() == 0


def test_cut_texts_have_the_same_count():
    tool = token_counts.load("piece_bpe_32k.model")
    for text in [*ODD, prose(8, 3000), "a b  c d " * 500]:
        assert sum(len(tool.encode(p)) for p in token_counts.parts(text, 40)) == len(tool.encode(text))
    assert not [p for p in (tool.id_to_piece(i) for i in range(tool.get_piece_size())) if "▁" in p.lstrip("▁")]


def test_encoder_gives_the_ids_of_whole_texts():
    tool = token_counts.load("byte_bpe_50k.json")
    texts = [*ODD, None, prose(9, 2000), prose(10, 50) + "\n" + prose(11, 50) + ".  " + prose(12, 5)]
    got = [x for _, _, ids in token_files.encode("byte_bpe_50k.json", pa.array(texts)) for x in ids]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tool.encode(text or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark):
    rows = edge_rows()
    path = common.new_path(spark, "ids")
    token_files.write_tokens(table(spark, rows).repartition(5), path)
    tool = token_counts.load("byte_bpe_50k.json")
    at, want = 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array([*tool.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.token_digest(spark, path).collect()), key=lambda r: r[1]) == want
    found = token_files.look_up(spark, path, [5, 8])
    assert {r.doc_id: r.ids for r in found.collect()} == {i: [*tool.encode(t, add_special_tokens=False).ids, 2] for i, t in ((r[0], r[1]) for r in rows) if i in (5, 8)}
    assert "doc_id" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:120]
    empty = common.new_path(spark, "ids")
    token_files.write_tokens(table(spark, []), empty)
    assert token_files.token_digest(spark, empty).count() == 0


def plain_spans(text: str) -> list[tuple[str, int, int, str]]:
    out = []
    for kind, pattern, group, least in (("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
                                        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        out += [(kind, m.start(), m.end(), m.group(group)) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return out


def test_secrets_match_plain_python(spark):
    hexes = "0123456789abcdef" * 2
    shared, mine = "Zq7" * 12, "Xk9" * 12
    texts = ["password = hunter22 and token: 'abc'", "é😀 API_KEY=\"sk.live-123456\"", "secret=token: abcdefgh", "token=token=abcdef", "AKIA" + "Q" * 16, "xAKIA0AKIA" + "7" * 15,
             "AKIAshort", hexes + " " + hexes[:23] + "g" + hexes, f"a {shared} b", f"c {shared}", f"d {shared}", f"e {mine} password=" + "Secret" * 3, "ſecret=abcdefgh apiKey=abcdefgh", None, "",
             "token  =  a" + "b" * 200_000, f"secret={mine}"]
    rows = [(i, t, "en", f"s{i}") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s3"), (None, texts[0], None, None)]
    got = {(r.doc_id, r.base_sha256): r for r in secrets.scan_secrets(table(spark, rows)).collect()}
    order = {"assign": 0, "access": 1, "hex": 2, "owned": 3}
    owners = defaultdict(set)
    per_row = []
    for doc_id, text, _, source in rows:
        base = plain_spans(text or "")
        owned = [("owned", m.start(), m.end(), m.group()) for m in re.finditer(r"[A-Za-z0-9_-]{32,}", text or "")
                 if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()) and not any(s < m.end() and m.start() < e for _, s, e, _ in base)]
        per_row.append((doc_id, base, owned))
        for *_, value in base + owned:
            owners[value].add(source or "")
    for doc_id, base, owned in per_row:
        text = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e, _ in sorted(spans, key=lambda x: (x[1], order[x[0]])))
        r = got[doc_id, hashlib.sha256(text(base).encode()).hexdigest()]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex"))
        assert r.spans == text(base + [o for o in owned if len(owners[o[3]]) <= 2])
        assert (r.n_live, r.n_shared) == tuple(sum((len(owners[v]) <= 2) == live for *_, v in base + owned) for live in (True, False))
    assert secrets.scan_secrets(table(spark, rows)).count() == len(rows)
    assert secrets.scan_secrets(table(spark, [])).count() == 0
    assert "Python" not in secrets.scan_secrets(table(spark, rows))._jdf.queryExecution().executedPlan().toString()


def test_a_value_in_many_texts_of_one_source_is_shared(spark):
    value, own = "Ab3" * 12, "Cd4" * 12
    rows = [(i, f"text {i} has {value}", "en", "s") for i in range(9)] + [(20 + i, f"the same {own}", "en", "s") for i in range(30)]
    got = {r.doc_id: (r.spans, r.n_live, r.n_shared) for r in secrets.scan_secrets(table(spark, rows)).collect()}
    assert all(got[i] == ("", 0, 1) for i in range(9)) and all(got[20 + i] == ("owned:9:45", 1, 0) for i in range(30))
    few = {r.doc_id: r.n_live for r in secrets.scan_secrets(table(spark, rows[:8])).collect()}
    assert set(few.values()) == {1}
