"""The order book as keyed streaming state: sync, apply, sweep, classify, emit.

Spark partitions the stream by ``(symbol, market)`` and keeps each book in RocksDB: one map entry per price
level, one list entry per buffered diff, one small value row for the rest. A batch reads a book once,
applies its messages in order of arrival and writes back only the levels that changed. A book is one
sequence, so its part of a batch is handled by one task: bound batches at the source
(``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``), and let symbols spread over the cluster.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from depthspark.functions import tiers
from depthspark.operators.book import BAND
from depthspark.sources import depth

TOP = 5
PENDING, REQUESTED, SYNCED = "PENDING", "SNAPSHOT_REQUESTED", "SYNCED"

OUTPUT = ("symbol string, market string, type string, update_id bigint, recv_ms bigint, "
          "bids string, asks string")
_LEVELS = "array<struct<price:double,qty:double,tier:int,first_seen_ms:bigint,distance:double>>"


@dataclass
class Message:
    kind: str
    first_id: int
    final_id: int
    prev_id: int
    recv_ms: int
    bad: bool
    has_levels: bool
    levels: list[tuple[str, float, float]]


@dataclass
class Book:
    """One book. ``dirty`` and ``gone`` collect the levels to write back."""

    symbol: str
    market: str
    phase: str = PENDING
    last_id: int = 0
    mid: float | None = None
    shown: bool = False
    sent: str = ""
    levels: dict[str, dict[float, tuple[float, int]]] = field(default_factory=lambda: {"BID": {}, "ASK": {}})
    buffer: list[Message] = field(default_factory=list)
    band: float = BAND
    compute_on_sync: bool = True
    most_waiting: int | None = None
    prices: dict[str, list[float]] = field(default_factory=dict)
    touched: set[tuple[str, float]] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.prices = {side: sorted(by_price) for side, by_price in self.levels.items()}

    # One message in, and whether the book asks for a snapshot because of it.

    def on_diff(self, m: Message) -> bool:
        if self.phase == SYNCED:
            if self._live(m):
                return False
            self._restart()
            return True
        if self.phase == PENDING:
            self.phase = REQUESTED
            self.buffer = [m]
            return True
        if self.most_waiting is not None and len(self.buffer) >= self.most_waiting:
            self._restart()
            return True
        self.buffer.append(m)
        return False

    def on_snapshot(self, m: Message) -> bool:
        if self.phase != REQUESTED:
            return False
        if not self._synchronise(m):
            self._restart()
            return True
        self.phase = SYNCED
        self.buffer = []
        return False

    def _restart(self) -> None:
        # The levels stay until the next good snapshot; the book is not shown meanwhile.
        self.buffer = []
        self.phase = REQUESTED

    def _synchronise(self, m: Message) -> bool:
        if m.bad:
            return False
        usable = self.buffer
        while usable and usable[0].final_id < m.final_id:
            usable = usable[1:]
        if not usable or not usable[0].first_id <= m.final_id <= usable[0].final_id or usable[0].bad:
            return False
        for side in ("BID", "ASK"):
            for price in list(self.levels[side]):
                self._remove(side, price)
        self.mid = None
        self._apply([level for level in m.levels if level[2] > 0], m.recv_ms)
        self._apply(usable[0].levels, m.recv_ms)
        self.last_id = usable[0].final_id
        if self.compute_on_sync:
            self._sweep()
        return all(self._live(later, m.recv_ms) for later in usable[1:])

    def _live(self, m: Message, now_ms: int | None = None) -> bool:
        if m.bad:
            return False
        if m.has_levels:
            expected = m.first_id == self.last_id + 1 if self.market == "SPOT" else m.prev_id == self.last_id
            if not expected:
                return False
        self._apply(m.levels, m.recv_ms if now_ms is None else now_ms)
        self._sweep()
        self.last_id = m.final_id
        return True

    def _apply(self, levels: list[tuple[str, float, float]], now_ms: int) -> None:
        for side, price, qty in levels:
            if qty == 0.0:
                self._remove(side, price)
                continue
            old = self.levels[side].get(price)
            if old is None:
                bisect.insort(self.prices[side], price)
            self.levels[side][price] = (qty, now_ms if old is None else old[1])
            self.touched.add((side, price))

    def _remove(self, side: str, price: float) -> None:
        if self.levels[side].pop(price, None) is not None:
            del self.prices[side][bisect.bisect_left(self.prices[side], price)]
            self.touched.add((side, price))

    def _sweep(self) -> None:
        bids, asks = self.prices["BID"], self.prices["ASK"]
        if not bids or not asks:
            return
        self.mid = (bids[-1] + asks[0]) / 2.0
        lower, upper = self.mid * (1.0 - self.band), self.mid * (1.0 + self.band)
        for side, prices in (("BID", bids), ("ASK", asks)):
            while prices and prices[0] < lower:
                self._remove(side, prices[0])
            while prices and prices[-1] > upper:
                self._remove(side, prices[-1])

    # What to show.

    def activity(self) -> tuple[str, str, str] | None:
        """``(type, bids, asks)`` if the visible state moved since the last call."""
        tops = self._tops() if self.phase == SYNCED else None
        if tops is None:
            was, self.shown = self.shown, False
            return ("DROP", "", "") if was else None
        bids, asks = (json.dumps(side) for side in tops)
        was, self.shown = self.shown, True
        same, self.sent = self.sent == bids + asks, bids + asks
        if not was:
            return "ADD", bids, asks
        return None if same else ("UPDATE", bids, asks)

    def _tops(self) -> list[list[dict]] | None:
        if not self.prices["BID"] or not self.prices["ASK"]:
            return None
        bands = tiers.LIQUID_BANDS if self.symbol in tiers.LIQUID_SYMBOLS else tiers.NORMAL_BANDS
        tops = [self._best(side, bands) for side in ("BID", "ASK")]
        return tops if any(side[0]["tier"] >= 1 for side in tops) else None

    def _best(self, side: str, bands) -> list[dict]:
        widest = max(b[2] for b in bands)
        outward = reversed(self.prices[side]) if side == "BID" else iter(self.prices[side])
        ranked = []
        for depth_no, price in enumerate(outward):
            distance = 0.0 if self.mid is None else abs(price - self.mid) / self.mid
            if depth_no >= TOP and distance > widest:
                break
            qty, first_seen = self.levels[side][price]
            notional = price * qty
            tier = max((n for n, least, far in bands if notional >= least and distance <= far), default=0)
            ranked.append((-tier, -notional, distance, depth_no,
                           {"price": price, "qty": qty, "tier": tier, "first_seen_ms": first_seen,
                            "distance": distance}))
        ranked.sort(key=lambda r: r[:4])
        return [r[4] for r in ranked[:TOP]]


def messages(rows: pd.DataFrame) -> Iterator[Message]:
    """Rows of ``arrivals`` in order of arrival."""
    rows = rows.sort_values(["recv_ms", "snapshot", "final_id"], kind="stable")
    for r in rows.itertuples(index=False):
        levels = [("BID", float(p), float(q)) for p, q in zip(r.bid_price, r.bid_qty)]
        levels += [("ASK", float(p), float(q)) for p, q in zip(r.ask_price, r.ask_qty)]
        yield Message("SNAPSHOT" if r.snapshot else "DIFF", int(r.first_id), int(r.final_id),
                      int(r.prev_final_id), int(r.recv_ms), bool(r.bad), bool(r.has_levels), levels)


def replay(book: Book, rows: pd.DataFrame, ask: bool) -> list[tuple]:
    out: list[tuple] = []

    def emit(m: Message) -> None:
        moved = book.activity()
        if moved:
            out.append((book.symbol, book.market, moved[0], m.final_id, m.recv_ms, moved[1], moved[2]))

    for message in messages(rows):
        wants = book.on_snapshot(message) if message.kind == "SNAPSHOT" else book.on_diff(message)
        if wants and ask:
            out.append((book.symbol, book.market, "SNAPSHOT_REQUEST", message.final_id, message.recv_ms, "", ""))
        emit(message)
    return out


class _BookProcessor(StatefulProcessor):
    def __init__(self, band: float, compute_on_sync: bool, ask: bool, most_waiting: int | None):
        self.band, self.compute_on_sync, self.ask, self.most_waiting = band, compute_on_sync, ask, most_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", "phase string, last_id bigint, mid double, shown boolean, sent string")
        self.levels = handle.getMapState("levels", "side string, price double", "qty double, first_seen bigint")
        self.waiting = handle.getListState("waiting", "message string")

    def _load(self, key) -> tuple[Book, bool]:
        known = self.meta.exists()
        settings = dict(band=self.band, compute_on_sync=self.compute_on_sync, most_waiting=self.most_waiting)
        if not known:
            return Book(key[0], key[1], **settings), False
        phase, last_id, mid, shown, sent = self.meta.get()
        levels: dict[str, dict[float, tuple[float, int]]] = {"BID": {}, "ASK": {}}
        for (side, price), (qty, first_seen) in self.levels.iterator():
            levels[side][price] = (qty, first_seen)
        buffer = [Message(**json.loads(text)) for (text,) in self.waiting.get()] if phase == REQUESTED else []
        return Book(key[0], key[1], phase, last_id, mid, shown, sent, levels, buffer, **settings), True

    def _store(self, book: Book, had_buffer: bool) -> None:
        for side, price in book.touched:
            now = book.levels[side].get(price)
            if now is None:
                self.levels.removeKey((side, price))
            else:
                self.levels.updateValue((side, price), now)
        if book.buffer:
            self.waiting.put([(json.dumps(vars(m)),) for m in book.buffer])
        elif had_buffer:
            self.waiting.clear()
        self.meta.update((book.phase, book.last_id, book.mid, book.shown, book.sent))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        book, known = self._load(key)
        had_buffer = bool(book.buffer)
        if not known:
            # A snapshot for a book nobody has seen a diff of is ignored.
            frame = frame.sort_values(["recv_ms", "snapshot", "final_id"], kind="stable")
            first = (~frame["snapshot"]).to_numpy().argmax() if (~frame["snapshot"]).any() else len(frame)
            frame = frame.iloc[first:]
            if frame.empty:
                return
        out = replay(book, frame, self.ask)
        self._store(book, had_buffer)
        if out:
            yield pd.DataFrame(out, columns=["symbol", "market", "type", "update_id", "recv_ms", "bids", "asks"])

    def close(self) -> None:
        pass


def arrivals(raw: DataFrame) -> DataFrame:
    """Typed messages from raw rows ``kind (DIFF | SNAPSHOT), symbol, market, raw, recv_ms``.

    Parsing stays in the JVM, before the shuffle to the books. A failed snapshot is kept as ``bad``, because it
    makes the book ask again.
    """
    is_diff = F.col("kind") == "DIFF"
    diffs = depth.parse_diffs(depth.read_depth(raw.filter(is_diff)))
    snaps = raw.filter(~is_diff)
    empty = F.array().cast("array<struct<price:double,qty:double>>")
    snapshots = depth.read_snapshots(snaps).select(
        "symbol", "market", F.lit(0).cast("bigint").alias("first_id"),
        F.coalesce("snapshot_id", F.lit(-1)).alias("final_id"), F.lit(0).cast("bigint").alias("prev_final_id"),
        "recv_ms", *[F.when(F.col("bad"), empty).otherwise(F.col(side)).alias(side) for side in ("bids", "asks")], "bad")
    both = (diffs.withColumn("snapshot", F.lit(False))
            .unionByName(snapshots.withColumn("snapshot", F.lit(True))))
    has = F.col("bids").isNotNull() | F.col("asks").isNotNull()

    def part(side: str, name: str):
        return F.transform(F.coalesce(side, empty), lambda x: F.coalesce(x[name], F.lit(0.0)))

    return both.select(
        "symbol", "market", "snapshot", "first_id", "final_id", "prev_final_id", "recv_ms", "bad",
        has.alias("has_levels"), part("bids", "price").alias("bid_price"), part("bids", "qty").alias("bid_qty"),
        part("asks", "price").alias("ask_price"), part("asks", "qty").alias("ask_qty"))


def book_stream(raw: DataFrame, band: float = BAND, compute_on_sync: bool = True, ask: bool = False,
                most_waiting: int | None = None) -> DataFrame:
    """Feed events of every book of a raw stream.

    The book is looked at after every message, so the events do not depend on how rows fall into batches.
    ``most_waiting`` bounds the diffs that wait for a snapshot: one more empties the buffer and a new snapshot is asked for,
    as a live feed with little memory does (500 there); none by default, for replay of a log. ``compute_on_sync=False`` leaves distances at 0 until the first live
    diff after a sync. ``ask=True`` also emits SNAPSHOT_REQUEST rows for whoever fetches snapshots.
    Snapshots are used only while a book waits for one.
    """
    out = (arrivals(raw).groupBy("symbol", "market")
           .transformWithStateInPandas(_BookProcessor(band, compute_on_sync, ask, most_waiting),
                                       outputStructType=OUTPUT, outputMode="Append", timeMode="None"))
    return out.select("symbol", "market", "type", "update_id", "recv_ms",
                      F.from_json(F.nullif("bids", F.lit("")), _LEVELS).alias("bids"),
                      F.from_json(F.nullif("asks", F.lit("")), _LEVELS).alias("asks"))
