"""Distinct users per time slice, presence and last-seen over the connection log."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthspark.session import stored

DEFAULT_ZONE = "Asia/Tashkent"
DEFAULT_SLICE = "PT1H"
MIN_SLICE_SECONDS = 60
CALENDAR = {"P1M": "month", "P1Y": "year"}

_DURATION = re.compile(
    r"(?P<sign>[-+]?)P(?:(?P<d>[-+]?\d+)D)?(?P<t>T(?:(?P<h>[-+]?\d+)H)?(?:(?P<m>[-+]?\d+)M)?"
    r"(?:(?P<s>[-+]?\d+)(?:[.,]\d{0,9})?S)?)?", re.IGNORECASE)


def parse_zone(name: str) -> ZoneInfo:
    try:
        return ZoneInfo(name)
    except Exception as e:
        raise ValueError(f"invalid zone: {name}") from e


def parse_slice(text: str) -> int | str:
    """Whole seconds of an ISO-8601 duration, or ``month`` / ``year`` for the two calendar literals."""
    if text in CALENDAR:
        return CALENDAR[text]
    m = _DURATION.fullmatch(text)
    if not m or not any(m[g] for g in "dhms") or (m["t"] and len(m["t"]) == 1):
        raise ValueError(f"invalid slice (use PT30M, PT1H, P7D, P1M or P1Y): {text}")
    seconds = sum(int(m[g] or 0) * n for g, n in (("d", 86_400), ("h", 3_600), ("m", 60), ("s", 1)))
    seconds = -seconds if m["sign"] == "-" else seconds
    if seconds < MIN_SLICE_SECONDS:
        raise ValueError(f"slices of less than 60 seconds are not counted: {text}")
    return seconds


@dataclass(frozen=True)
class UsageWindow:
    start: datetime
    end: datetime
    zone: str

    @classmethod
    def of(cls, start: date | None = None, end: date | None = None, zone: str = DEFAULT_ZONE) -> UsageWindow:
        """From local midnight of ``start`` to local midnight after ``end``; both default to today."""
        tz = parse_zone(zone)
        today = datetime.now(tz).date()
        start, end = start or today, end or today
        if end < start:
            raise ValueError(f"empty window, its end date {end} is earlier than {start}")

        def midnight(day: date) -> datetime:
            return datetime.combine(day, time.min, tzinfo=tz).astimezone(timezone.utc)

        return cls(midnight(start), midnight(end + timedelta(days=1)), zone)

    @property
    def start_epoch(self) -> int:
        return int(self.start.timestamp())


def _bound(events: DataFrame, instant: datetime) -> Column:
    # A literal of the column's own type, so that the comparison reaches the Parquet scan.
    text = instant.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    kind = "TIMESTAMP_NTZ" if dict(events.dtypes)["connected_at"] == "timestamp_ntz" else "TIMESTAMP"
    return F.expr(f"{kind}'{text}'" if kind == "TIMESTAMP_NTZ" else f"TIMESTAMP'{text}Z'")


def _in_window(events: DataFrame, window: UsageWindow) -> DataFrame:
    """Connects of the window; a ``day`` column (UTC, as the log is written) prunes whole folders."""
    inside = (F.col("connected_at") >= _bound(events, window.start)) & (F.col("connected_at") < _bound(events, window.end))
    if "day" in events.columns:
        days = [F.lit(t.astimezone(timezone.utc).date()) for t in (window.start, window.end)]
        inside = inside & F.col("day").between(*days)
    return events.filter(inside)


def _instant(column: str = "connected_at") -> Column:
    # Columns without a zone hold UTC; the session zone is UTC.
    return F.col(column).cast("timestamp")


def usage_fixed(events: DataFrame, window: UsageWindow, slice_seconds: int) -> DataFrame:
    """Distinct users per slice of fixed length from local midnight of the first day."""
    anchor = window.start_epoch
    bucket = F.expr(f"(unix_seconds(CAST(connected_at AS TIMESTAMP)) - {anchor}) div {slice_seconds}")
    start = F.lit(anchor) + F.col("bucket") * slice_seconds
    return (_in_window(events, window).select(bucket.alias("bucket"), "user_id")
            .groupBy("bucket").agg(F.count_distinct("user_id").alias("unique_connections"))
            .select(F.timestamp_seconds(start).alias("slice_start"),
                    F.timestamp_seconds(start + slice_seconds).alias("slice_end"), "unique_connections"))


def usage_calendar(events: DataFrame, window: UsageWindow, unit: str) -> DataFrame:
    """Distinct users per local month or year."""
    if unit not in CALENDAR.values():
        raise ValueError(f"unit must be month or year: {unit}")
    zone = F.lit(window.zone)
    local = F.date_trunc(unit, F.from_utc_timestamp(_instant(), zone))
    months = 1 if unit == "month" else 12
    after = F.add_months("local_start", months).cast("timestamp")
    return (_in_window(events, window).select(local.alias("local_start"), "user_id")
            .groupBy("local_start").agg(F.count_distinct("user_id").alias("unique_connections"))
            .select(F.to_utc_timestamp("local_start", zone).alias("slice_start"),
                    F.to_utc_timestamp(after, zone).alias("slice_end"), "unique_connections"))


def usage_slices(events: DataFrame, start: date | None = None, end: date | None = None,
                 slice_text: str = DEFAULT_SLICE, zone: str = DEFAULT_ZONE) -> DataFrame:
    """Checks the arguments while planning, then counts fixed or calendar slices."""
    window = UsageWindow.of(start, end, zone)
    length = parse_slice(slice_text)
    if isinstance(length, str):
        return usage_calendar(events, window, length)
    return usage_fixed(events, window, length)


def usage_report(slices: DataFrame) -> DataFrame:
    """Totals over slices; the busiest one is the earliest of those with the most users."""
    start = F.col("slice_start").cast("timestamp")
    return slices.agg(
        F.count("*").alias("slice_count"),
        F.coalesce(F.sum("unique_connections"), F.lit(0)).alias("total_connections"),
        F.max_by("slice_start", F.struct("unique_connections", -F.unix_micros(start))).alias("most_active_start"),
        F.max("unique_connections").alias("most_active"))


def presence(sessions: DataFrame, as_of_s: int, rules: DataFrame) -> DataFrame:
    """Users with open sessions and their number; ``custom`` marks users with rules."""
    open_now = sessions.filter(
        (F.col("opened_s") <= as_of_s) & (F.col("closed_s").isNull() | (F.col("closed_s") > as_of_s)))
    with_rules = rules.select("user_id").distinct().withColumn("custom", F.lit(True))
    return (open_now.groupBy("user_id").agg(F.count("*").alias("sessions"))
            .join(with_rules, "user_id", "left")
            .withColumn("custom", F.coalesce("custom", F.lit(False))))


def presence_totals(present: DataFrame) -> DataFrame:
    return present.agg(F.count("*").alias("online_users"),
                       F.coalesce(F.sum("sessions"), F.lit(0)).alias("total_sessions"))


def last_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("connected_at").alias("last_seen_at"))


# --- a state that merges --------------------------------------------------------------------------

UNIT_S = 900   # every zone's offset is a whole number of these, so any local hour, day, month and year is made of them


def user_numbers(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``user_id, number``: numbers from 0 on without large holes; users in ``known`` keep theirs, new ones follow.

    Ranges of ids are numbered side by side; only one row per range is summed.
    """
    users = events.select("user_id").filter(F.col("user_id").isNotNull()).distinct()
    first = F.lit(0).cast("bigint")
    if known is not None:
        users = users.join(known, "user_id", "left_anti")
        first = F.coalesce(known.select(F.max("number") + 1).scalar(), first)
    placed = stored(users.repartitionByRange("user_id").sortWithinPartitions("user_id").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.col("__at") - F.shiftleft(F.col("__part"), 33)
    new = placed.withColumn("__part", part).join(before, "__part").select("user_id", (first + F.col("__before") + inside).alias("number"))
    return new if known is None else known.select("user_id", "number").unionByName(new)


def usage_state(events: DataFrame, numbers: DataFrame, unit_s: int = UNIT_S) -> DataFrame:
    """``unit, bucket, users``: who connected in each unit of time, as bitmaps of user numbers (32,768 to a bucket).

    Exact, small, and mergeable: units of two states are joined with ``merge_states``, and any slice made of whole units is counted from the
    state without another look at the log.
    """
    unit = F.floor(F.unix_seconds(_instant()) / unit_s).cast("bigint")
    numbered = events.select("user_id", unit.alias("unit")).distinct().join(numbers, "user_id")
    number = F.col("number") + 1   # the bit functions count from 1
    return (numbered.groupBy("unit", F.bitmap_bucket_number(number).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("users")))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several; a connect that is in more than one of them counts once."""
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    return every.groupBy("unit", "bucket").agg(F.bitmap_or_agg("users").alias("users"))


def _count(slices: DataFrame) -> DataFrame:
    """Distinct users per ``slice``: the bitmaps of a bucket are joined, their bits are counted, buckets are added up."""
    return (slices.groupBy("slice", "bucket").agg(F.bitmap_or_agg("users").alias("users"))
            .groupBy("slice").agg(F.sum(F.bitmap_count("users")).alias("unique_connections")))


def _units(state: DataFrame, window: UsageWindow, unit_s: int) -> DataFrame:
    first, last = window.start_epoch, int(window.end.timestamp())
    if first % unit_s or last % unit_s:
        raise ValueError("the window is not made of whole units")
    return state.filter((F.col("unit") >= first // unit_s) & (F.col("unit") < last // unit_s))


def state_fixed(state: DataFrame, window: UsageWindow, slice_seconds: int, unit_s: int = UNIT_S) -> DataFrame:
    """``usage_fixed`` from a state."""
    if slice_seconds % unit_s:
        raise ValueError(f"a slice of {slice_seconds} s is not made of units of {unit_s} s")
    anchor = window.start_epoch
    number = F.expr(f"(unit * {unit_s} - {anchor}) div {slice_seconds}")
    start = F.lit(anchor) + F.col("slice") * slice_seconds
    return _count(_units(state, window, unit_s).withColumn("slice", number)).select(
        F.timestamp_seconds(start).alias("slice_start"), F.timestamp_seconds(start + slice_seconds).alias("slice_end"), "unique_connections")


def state_calendar(state: DataFrame, window: UsageWindow, unit: str, unit_s: int = UNIT_S) -> DataFrame:
    """``usage_calendar`` from a state."""
    if unit not in CALENDAR.values():
        raise ValueError(f"unit must be month or year: {unit}")
    zone = F.lit(window.zone)
    local = F.date_trunc(unit, F.from_utc_timestamp(F.timestamp_seconds(F.col("unit") * unit_s), zone))
    after = F.add_months("slice", 1 if unit == "month" else 12).cast("timestamp")
    return _count(_units(state, window, unit_s).withColumn("slice", local)).select(
        F.to_utc_timestamp("slice", zone).alias("slice_start"), F.to_utc_timestamp(after, zone).alias("slice_end"), "unique_connections")
