"""Short plain-Python models of the sequential rules, written straight from their description."""

from __future__ import annotations

import json


def tier_of(bands, notional, distance):
    return max((t for t, least, far in bands if notional >= least and distance <= far), default=0)


def top_five(levels, bands, k=5):
    """``levels`` are (price, qty, distance) from the best outward; one walk that stops when nothing can follow."""
    widest = max(b[2] for b in bands)
    kept = []
    for place, (price, qty, distance) in enumerate(levels):
        if len(kept) == k and distance > widest:
            break
        entry = (tier_of(bands, price * qty, distance), price * qty, -distance, -place, price)
        kept = sorted([*kept, entry], reverse=True)[:k]
    return [(e[4], e[0]) for e in kept]


def net_event(types):
    """What a map of pending events holds after merging one tick's events in order."""
    held = None
    for t in types:
        if held == "ADD" and t == "DROP":
            held = None
        else:
            held = t
    return held


def fold(grants):
    """``grants`` are (at, seconds) in order; returns (previous, new) per grant."""
    out, previous = [], None
    for at, seconds in grants:
        new = max(at, previous) + seconds if previous is not None else at + seconds
        out.append((previous, new))
        previous = new
    return out


class SlowBook:
    """One book, message by message, with nothing clever about it."""

    def __init__(self, market, band=0.1):
        self.market, self.band = market, band
        self.state, self.buffer, self.last = "PENDING", [], 0
        self.book = {"b": {}, "a": {}}
        self.mid = None

    def diff(self, text, now):
        d = json.loads(text)
        if self.state == "PENDING":
            self.state, self.buffer = "SNAPSHOT_REQUESTED", [d]
        elif self.state == "SNAPSHOT_REQUESTED":
            self.buffer = [] if len(self.buffer) >= 500 else [*self.buffer, d]
        elif not self.live(d, now):
            self.state, self.buffer = "SNAPSHOT_REQUESTED", []

    def snapshot(self, text, now):
        if self.state != "SNAPSHOT_REQUESTED":
            return
        s = json.loads(text)
        sid = s.get("lastUpdateId")
        todo = [d for d in self.buffer]
        while todo and sid is not None and todo[0]["u"] < sid:
            todo.pop(0)
        self.buffer = []
        if sid is None or not todo or not todo[0]["U"] <= sid <= todo[0]["u"]:
            return
        self.book = {side: {float(p): (float(q), now) for p, q in s[name] if float(q) > 0}
                     for side, name in (("b", "bids"), ("a", "asks"))}
        first = todo.pop(0)
        self.mid = None
        self.apply(first, now)
        self.last = first["u"]
        self.sweep()
        if all(self.live(d, now) for d in todo):
            self.state = "SYNCED"

    def live(self, d, now):
        if ("b" in d or "a" in d) and (d["U"] != self.last + 1 if self.market == "SPOT" else d["pu"] != self.last):
            return False
        self.apply(d, now)
        self.sweep()
        self.last = d["u"]
        return True

    def apply(self, d, now):
        for side in "ba":
            for p, q in d.get(side, []):
                p, q = float(p), float(q)
                if q == 0:
                    self.book[side].pop(p, None)
                else:
                    self.book[side][p] = (q, self.book[side][p][1] if p in self.book[side] else now)

    def sweep(self):
        if not self.book["b"] or not self.book["a"]:
            return
        self.mid = (max(self.book["b"]) + min(self.book["a"])) / 2.0
        low, high = self.mid * (1.0 - self.band), self.mid * (1.0 + self.band)
        for side in "ba":
            self.book[side] = {p: v for p, v in self.book[side].items() if low <= p <= high}

    def levels(self):
        return sorted((s, p, q, t) for s, name in (("BID", "b"), ("ASK", "a")) for p, (q, t) in self.book[name].items())
