"""Repair against a plain search over whole audits."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import sys
import zlib

import pytest

from depthspark.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, g long, kind int, after string, copy int, at string, same string"
NAMES = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    """(conv_id, turn, role, text) after damage, by turn; of a conversation without rows the id alone."""
    show = lambda v: " " if v is None else str(v)
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, show(r[2]), hashlib.sha256(show(r[3]).encode()).hexdigest())):
        hit, role, text = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20, show(r), show(x)
        own = out.setdefault(c, [])
        if hit:
            row = (t, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
            own += [row] * (2 if hit == 3 else 1)
    return out


def plain_repair(rows):
    """The contract for one conversation's rows (turn, role, text)."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("b" if not last else "d" if (role, text) in seen else "." if last in ".!?" else "t")
        seen.add((role, text))

    @functools.cache
    def best(i, done, inserted):
        """(cost, audit, lines) from row i on, the initials so far being summed up as '', s, u or a."""
        then = "a" if done == "u" else "u"
        ways = []
        if i == len(rows):
            if done in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, role, text = rows[i]
            c, a, x = best(i + 1, done, 0)
            ways.append((c + 4, "D" + a, x))
            if faults[i] in "t.":
                more = 3 * (faults[i] == "t")
                c, a, x = best(i + 1, then, 0)
                ways.append((c + 3 + more, "R" + a, (f"{NAMES[then]}:{text}", *x)))
                first = role[:1]
                if first == then or (first == "s" and done == ""):
                    c, a, x = best(i + 1, first, 0)
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *x)))
        if inserted < 4:
            c, a, x = best(i, then, inserted + 1)
            ways.append((c + 3, "I" + a, (f"{NAMES[then]}:", *x)))
        return min(ways) if ways else (1 << 40, "", ())

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y", "z") for r in rows], SCHEMA)


def some_rows(seed: int, n: int):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "What", "", " \n", "\x0b\x0c", "a?", "long text. ", "b.\t\n", "c\xa0", None, "é…", "."]
    for c in (*range(n), None):
        turn = rng.randrange(-3, 3)
        for k in range(rng.randrange(1, 9)):
            good = rng.random() < 0.7
            rows.append((c, turn, ["user", "assistant"][k % 2] if good else rng.choice(["system", "user", "assistant", "tool", "", None, "ursa", "su", "é"]),
                         f"Text {rng.randrange(50)}." if good else rng.choice(texts)))
            turn = None if rng.random() < 0.05 else (turn or 0) + rng.choice([0, 1, 1, 1, 1, 3])
        if rng.random() < 0.2:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("bits", [1, 12])
def test_repair_matches_a_plain_search(spark, bits):
    rows = some_rows(bits, 120)
    got = {r.conv_id: tuple(r)[1:] for r in conv.repair(conv.damaged(table(spark, rows)), piece_bits=bits).collect()}
    want = {c: plain_repair(tuple(own))[0] for c, own in plain_damage(rows).items()}
    assert got == want
    assert any(len(set(w[6])) == 4 for w in want.values()) and any(w[0] for w in want.values()) and any(w[1] and w[2] and w[3] for w in want.values())


def test_repaired_turns(spark):
    rows = some_rows(9, 40)
    lines = {}
    for r in conv.repair(conv.damaged(table(spark, rows)), turns=True).orderBy("conv_id", "place").collect():
        assert r.place == len(lines.setdefault(r.conv_id, []))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert r.edit in "KRI"
    assert lines == {c: list(x) for c, own in plain_damage(rows).items() if (x := plain_repair(tuple(own))[1])}


def test_one_long_conversation_crosses_pieces(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["A.", "b", "", f"t{i}."])) for i in range(1500)] + [(2, 0, "user", "x" * 300_000)]
    got = {r.conv_id: tuple(r)[1:] for r in conv.repair(conv.damaged(table(spark, rows)), piece_bits=5).collect()}
    own = plain_damage(rows)
    sys.setrecursionlimit(20_000)   # of the plain search
    assert got == {c: plain_repair(tuple(own[c]))[0] for c in own}


def test_ties_take_the_least_audit():
    rng = random.Random(5)
    for _ in range(3000):
        rows = tuple((k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", f"{k}."])) for k in range(rng.randrange(9)))
        want = plain_repair(rows)[0]
        faults, seen = [], set()
        for _, role, text in rows:
            faults.append("d" if (role, text) in seen else "." if text[-1] == "." else "t")
            seen.add((role, text))
        audit, state = conv.solve([(r[0] if r[0] in "sua" else "?", f) for (_, r, _), f in zip(rows, faults, strict=True)], conv.START, conv.END)
        assert audit + conv.ENDING[state] == want[6]


def test_nothing(spark):
    assert conv.repair(conv.damaged(table(spark, []))).count() == 0
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in conv.repair(conv.damaged(table(spark, [(gone, 0, "user", "A.")]))).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    far = [(1, -(1 << 63), "user", "A."), (1, (1 << 63) - 1, "assistant", "B.")]
    assert conv.repair(conv.damaged(table(spark, far))).first().gaps == (1 << 63) - 1
