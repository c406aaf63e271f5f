"""Repair of conversations at the least cost, by Hirschberg's divide and conquer over four states.

The roles' initials of a repaired conversation are ``(s?(ua)+)?``, so what has been kept so far is in one of four states: nothing
yet, after the system's turn, after the user's, after the assistant's. A row is kept, gets another role or goes, and empty rows
may be put in before it; a table gives the costs from state to state for each kind of row. Forward costs from the start and
backward costs from the end meet in the middle of a stretch of rows; of the cheapest crossings the left half takes the one
whose audit is least, and both halves are solved the same way. No more than two vectors of four numbers are held per level.

A conversation may be long, so it is cut into pieces of at most ``2 ** PIECE_BITS`` rows. A piece first gives its costs from state to state;
what these make of a conversation are the backward costs at the borders of its pieces, one row per piece; then each piece is solved
for the states it may be entered in. Rows are ordered by one range exchange, which spreads a long conversation, and texts
are read again only to write the repaired conversation in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthspark.llm.common import store

PIECE_BITS = 12
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
FAR = 1 << 60
BLANK, DUPLICATE, TRUNCATED, WHOLE = "bdt."
# Fixed value: the white space of the contract.
WHITE = " \t\n\x0b\x0c\r"
_NAMES = {USER: "user", ASSISTANT: "assistant"}
Vector = tuple[int, int, int, int]


def _next_turn(state: int) -> int:
    """The state behind a user's or assistant's turn, whichever may come."""
    return ASSISTANT if state == USER else USER


def _options(initial: str, fault: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row from a state on (rows put in before it, then the row itself), their cost and the state behind it."""
    out, before, cost = [], "", 0
    for _ in range(3):
        out.append((before + "D", cost + DELETE, state))
        if fault not in (BLANK, DUPLICATE):
            more = CUT_OFF if fault == TRUNCATED else 0
            out.append((before + "R", cost + RENAME + more, _next_turn(state)))
            kept = SYSTEM if initial == "s" and state == START else _next_turn(state) if initial == ("a" if state == USER else "u") else None
            if kept is not None:
                out.append((before + "K", cost + more, kept))
        before, cost, state = before + "I", cost + INSERT, _next_turn(state)
    return sorted(out)


OPTIONS = {(i, f): [_options(i, f, s) for s in STATES] for i in "sua?" for f in (BLANK, DUPLICATE, TRUNCATED, WHOLE)}
STEP = {kind: [[min((c for _, c, q in options if q == to), default=FAR) for to in STATES] for options in by_state] for kind, by_state in OPTIONS.items()}
# What is put in behind the last row, by state, and what it costs.
ENDING = ("", "II", "I", "")
END: Vector = tuple(INSERT * len(x) for x in ENDING)


def forward(costs: Vector, rows: list[tuple[str, str]]) -> Vector:
    """The least costs to reach each state behind ``rows`` (initial, fault), from those in front of them."""
    for row in rows:
        step = STEP[row]
        costs = tuple(min(costs[s] + step[s][to] for s in STATES) for to in STATES)
    return costs


def backward(rows: list[tuple[str, str]], costs: Vector) -> Vector:
    """The least costs to the end from each state in front of ``rows``, from those behind them."""
    for row in reversed(rows):
        costs = tuple(min(step[to] + costs[to] for to in STATES) for step in STEP[row])
    return costs


def solve(rows: list[tuple[str, str]], state: int, after: Vector) -> tuple[str, int]:
    """The least audit among the cheapest ones from ``state`` over ``rows`` to the end, and the state behind them.

    An audit of a row ends with the row's own edit, so of two audits that lead to different states none begins the other, and the
    left half alone decides between crossings.
    """
    if not rows:
        return "", state
    if len(rows) == 1:
        options = OPTIONS[rows[0]][state]
        least = min(cost + after[to] for _, cost, to in options)
        return next((edits, to) for edits, cost, to in options if cost + after[to] == least)
    half = len(rows) // 2
    there = forward(tuple(0 if s == state else FAR for s in STATES), rows[:half])
    back = backward(rows[half:], after)
    least = min(a + b for a, b in zip(there, back, strict=True))
    left, crossing = solve(rows[:half], state, tuple(b if a + b == least else FAR for a, b in zip(there, back, strict=True)))
    right, last = solve(rows[half:], crossing, after)
    return left + right, last


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped, at, copy``: rows with the damage that crc32 of ``conv_id:turn`` gives them.

    Nulls are read as one space, but ``conv_id`` and ``turn`` keep theirs. A dropped row stays as a mark of its conversation. ``at`` orders
    the rows of one turn, by role and digest of the text as they were.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), hit.alias("hit"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("hit") == 0).alias("dropped"), F.struct("role", F.sha2(F.col("text"), 256).alias("digest"), F.monotonically_increasing_id().alias("row")).alias("at"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Stores the rows with ``g``, a number that ascends by conversation and turn; the rows of a conversation are neighbours."""
    keys = ["conv_id", "turn", "at", "copy"]
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), WHOLE).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    ready = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("at", "copy")
    return store(ready.withColumn("g", F.monotonically_increasing_id()).withColumn("fault", fault)
                 .withColumn("initial", F.when(initial.isin("s", "u", "a"), initial).otherwise("?"))
                 .withColumn("same", F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role"), "role", "text"), 256)), "turns")


def _pieces(rows: DataFrame, bits: int) -> DataFrame:
    """``conv_id, g, first, initials, faults``: the rows that are there of one conversation and piece; ``g`` is its first one's number."""
    there = rows.where(~F.col("dropped"))
    first = there.groupBy("same").agg(F.min("g").alias("seen"), F.count("*").alias("n")).where("n > 1")
    again = there.select("g", "same").join(first, "same").where("g > seen").select("g")
    # A mark in front of its row tells that the row repeats an earlier one.
    marks = again.select("g", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(False).alias("dropped"),
                         F.lit("").alias("initial"), F.lit("").alias("fault"))
    light = marks.unionByName(rows.select("g", F.lit(1).alias("kind"), "conv_id", "dropped", "initial", "fault"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, piece, done, marked = None, None, [], False
        for batch in batches:
            for g, is_row, conv, dropped, initial, fault in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if not is_row:
                    marked = True
                    continue
                if here != (conv, g >> bits):
                    here, piece = (conv, g >> bits), (conv, g, [], [])
                    done.append(piece)
                if not dropped:
                    piece[2].append(initial)
                    piece[3].append(DUPLICATE if marked and fault != BLANK else fault)
                marked = False
            if len(done) > 1:   # the last one may go on
                yield rows_of(done[:-1])
                done = done[-1:]
        if done:
            yield rows_of(done)

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_pydict({"conv_id": columns[0], "g": columns[1], "initials": ["".join(x) for x in columns[2]], "faults": ["".join(x) for x in columns[3]]}, schema)

    schema = pa.schema([("conv_id", _arrow(rows)), ("g", pa.int64()), ("initials", pa.string()), ("faults", pa.string())])
    cut = light.repartition(F.shiftright("g", bits)).sortWithinPartitions("g", "kind")
    return store(cut.mapInArrow(run, f"conv_id {kind}, g long, initials string, faults string"), "pieces")


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(rows.schema["conv_id"].dataType)


def _borders(pieces: DataFrame) -> DataFrame:
    """``g, first, after`` per piece: whether a conversation begins there, and the costs to its end from each state behind the piece."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[c for s in STATES for c in forward(tuple(0 if q == s else FAR for q in STATES), list(zip(i, f, strict=True)))]
                     for i, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["conv_id", "g", "costs"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def flush() -> pa.RecordBatch:
            after, found = END, []
            for _, costs in reversed(held):
                found.append(after)
                after = tuple(min(min(costs[4 * s + to], FAR) + after[to] for to in STATES) for s in STATES)
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in held], pa.int64()), pa.array([i == 0 for i in range(len(held))]),
                                               pa.array(found[::-1], pa.list_(pa.int64()))], ["g", "first", "after"])

        for batch in batches:
            for conv, g, costs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and conv != here:
                    yield flush()
                    held = []
                here = conv
                held.append((g, costs))
        if held:
            yield flush()

    costs = pieces.mapInArrow(cost, f"conv_id {kind}, g long, costs array<long>")
    return costs.repartition("conv_id").sortWithinPartitions("conv_id", "g").mapInArrow(walk, "g long, first boolean, after array<long>")


def _solved(pieces: DataFrame) -> DataFrame:
    """``conv_id, g, faults, exits, audits``: for each state a piece may be entered in, the state behind it and its audit."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exits, audits = [], []
            for initials, faults, first, after in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                rows = list(zip(initials, faults, strict=True))
                found = [solve(rows, s, tuple(after)) if s == START or not first else ("", s) for s in STATES]
                exits.append([q for _, q in found])
                audits.append([a for a, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(exits, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))],
                                             ["conv_id", "g", "faults", "exits", "audits"])

    both = pieces.join(_borders(pieces), "g").select("conv_id", "g", "initials", "faults", "first", "after")
    return both.mapInArrow(run, f"conv_id {kind}, g long, faults string, exits array<int>, audits array<string>")


class _Repair:
    """One conversation, read row by row: its pieces' audits stand in front of their rows."""

    def __init__(self, conv_id: Any, tell: Callable[[Any, str, str, str], None] | None = None):
        self.conv_id, self.tell, self.state, self.behind = conv_id, tell, START, START   # behind: the state at the end of the piece
        self.audits, self.hash, self.lines, self.cost, self.illegal = [], hashlib.sha256(), 0, 0, 0
        self.faults = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED, WHOLE), 0)
        self.before, self.turns, self.least, self.most = None, 0, None, None

    def piece(self, faults: str, exits: list[int], audits: list[str]) -> None:
        audit, self.behind = audits[self.behind], exits[self.behind]
        self.audits.append(audit)
        self.edits, self.piece_faults = iter(audit), iter(faults)

    def _line(self, edit: str, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        if self.tell:
            self.tell(self.conv_id, edit, role, text)

    def _insert(self) -> None:
        self.state, self.cost = _next_turn(self.state), self.cost + INSERT
        self._line("I", _NAMES[self.state], "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.most:
            self.turns, self.least, self.most = self.turns + 1, turn if self.least is None else self.least, turn
        initial, fault = role[:1], next(self.piece_faults)
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.faults[fault] += 1
        while (edit := next(self.edits)) == "I":
            self._insert()
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += CUT_OFF if fault == TRUNCATED else 0
        if edit == "R":
            self.state, self.cost = _next_turn(self.state), self.cost + RENAME
            role = _NAMES[self.state]
        else:
            self.state = SYSTEM if initial == "s" else USER if initial == "u" else ASSISTANT
        self._line(edit, role, text)

    def result(self) -> tuple:
        for _ in ENDING[self.state]:
            self._insert()
        self.audits.append(ENDING[self.behind])
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, min(gaps, (1 << 63) - 1), self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost,
                "".join(self.audits), self.hash.hexdigest())


_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame, turns: bool = False, piece_bits: int = PIECE_BITS) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (as ``damaged`` gives them): ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``;
    with ``turns`` the repaired conversations themselves, ``conv_id, place, edit, role, text``.

    Rows of one turn keep the order of ``at``; rows that are equal in all are duplicates of the first. A null ``conv_id`` is one conversation. A
    conversation without rows that are there has zeros, an empty audit and the hash of no text. A gap beyond 64 bits is the
    largest number. Rows of any number and length are read one after the other, and an empty table gives no rows. Writes into the
    shared folder when called.
    """
    kept = _ordered(rows)
    solved = _solved(_pieces(kept, piece_bits))
    nothing = F.lit(None).cast
    kind = kept.schema["conv_id"].dataType.simpleString()
    both = solved.select("conv_id", "g", F.lit(0).alias("kind"), nothing("long").alias("turn"), F.lit("").alias("role"), F.col("faults").alias("text"), F.lit(False).alias("dropped"),
                         "exits", "audits").unionByName(
        kept.select("conv_id", "g", F.lit(1).alias("kind"), "turn", "role", "text", "dropped", nothing("array<int>").alias("exits"), nothing("array<string>").alias("audits")))
    conv_type = _arrow(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, lines = None, [], []

        def tell(conv_id: Any, edit: str, role: str, text: str) -> None:
            lines.append((conv_id, now.lines - 1, edit, role, text))

        def flush() -> pa.RecordBatch:
            if turns:
                columns, kinds = list(zip(*lines, strict=True)) or [()] * 5, [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()]
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "place", "edit", "role", "text"])
            else:
                columns, kinds = list(zip(*done, strict=True)) or [()] * 9, [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", *_RESULT, "audit", "repaired_sha256"])
            lines.clear()
            done.clear()
            return out

        for batch in batches:
            for conv, is_row, turn, role, text, dropped, exits, audits in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "kind", "turn", "role", "text", "dropped", "exits", "audits")), strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = _Repair(conv, tell if turns else None)
                if not is_row:
                    now.piece(text, exits, audits)
                elif not dropped:
                    now.row(turn, role, text)
            yield flush()
        if now is not None:
            done.append(now.result())
            yield flush()

    schema = f"conv_id {kind}, place long, edit string, role string, text string" if turns else f"conv_id {kind}, {', '.join(c + ' long' for c in _RESULT)}, audit string, repaired_sha256 string"
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "g", "kind").mapInArrow(run, schema)
