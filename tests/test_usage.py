from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from depthspark.operators import usage
from depthspark.sources import sinks
from tests.conftest import rows

DAY = date(2026, 7, 18)
ZONE = "Asia/Tashkent"


def log(spark, moments):
    """``moments`` are (local hour, users) on DAY in a zone five hours ahead of UTC."""
    base = datetime(2026, 7, 17, 19, tzinfo=timezone.utc)
    data = [(u, base + timedelta(hours=h)) for h, users in moments for u in users]
    return spark.createDataFrame(data, "user_id int, connected_at timestamp")


def local(df):
    return rows(df.select(F.from_utc_timestamp("slice_start", ZONE).cast("string"), F.from_utc_timestamp("slice_end", ZONE).cast("string"),
                          "unique_connections"))


def test_half_hours_in_a_zone(spark):
    events = log(spark, [(15.1, [1, 2, 3, 3]), (18.2, [1, 2, 3, 4, 5]), (24.0, [9]), (-0.001, [9])])
    slices = usage.usage_slices(events, DAY, DAY, "PT30M", ZONE)
    assert local(slices) == [("2026-07-18 15:00:00", "2026-07-18 15:30:00", 3), ("2026-07-18 18:00:00", "2026-07-18 18:30:00", 5)]
    report = usage.usage_report(slices).first()
    assert (report["slice_count"], report["total_connections"], report["most_active"]) == (2, 8, 5)
    assert report["most_active_start"] == datetime(2026, 7, 18, 13)


def test_the_earliest_slice_wins_a_tie_and_empty_is_empty(spark):
    events = log(spark, [(18.0, [1, 2]), (15.0, [1, 2])])
    report = usage.usage_report(usage.usage_slices(events, DAY, DAY, "PT30M", ZONE)).first()
    assert report["most_active_start"] == datetime(2026, 7, 18, 10)
    none = usage.usage_report(usage.usage_slices(events, date(2020, 1, 1), date(2020, 1, 1), "PT1H", ZONE)).first()
    assert tuple(none) == (0, 0, None, None)


def test_months_and_years_follow_the_local_calendar(spark):
    utc = timezone.utc
    data = [(1, datetime(2025, 12, 31, 19, tzinfo=utc)), (2, datetime(2026, 1, 31, 18, 59, tzinfo=utc)), (3, datetime(2026, 1, 31, 19, tzinfo=utc))]
    events = spark.createDataFrame(data, "user_id int, connected_at timestamp")
    months = usage.usage_slices(events, date(2026, 1, 1), date(2026, 12, 31), "P1M", ZONE)
    assert local(months) == [("2026-01-01 00:00:00", "2026-02-01 00:00:00", 2), ("2026-02-01 00:00:00", "2026-03-01 00:00:00", 1)]
    years = usage.usage_slices(events, date(2026, 1, 1), date(2026, 12, 31), "P1Y", ZONE)
    assert local(years) == [("2026-01-01 00:00:00", "2027-01-01 00:00:00", 3)]


def test_calendar_slices_follow_daylight_saving(spark):
    events = spark.createDataFrame([(1, datetime(2026, 3, 15, tzinfo=timezone.utc))], "user_id int, connected_at timestamp")
    row = usage.usage_slices(events, date(2026, 3, 1), date(2026, 3, 31), "P1M", "Europe/Berlin").first()
    assert (row["slice_start"], row["slice_end"]) == (datetime(2026, 2, 28, 23), datetime(2026, 3, 31, 22))


@pytest.mark.parametrize("text, seconds", [("PT30M", 1800), ("P7D", 604800), ("PT1H30M", 5400), ("PT60.9S", 60), ("P1DT1M", 86460),
                                           ("P1M", "month"), ("P1Y", "year")])
def test_slices_that_are_valid(text, seconds):
    assert usage.parse_slice(text) == seconds


@pytest.mark.parametrize("text", ["PT30S", "P2M", "1h", "P", "PT", "", "-PT1H", "P1DT", "PT59.9S"])
def test_slices_that_are_not(text):
    with pytest.raises(ValueError):
        usage.parse_slice(text)


def test_window_arguments():
    with pytest.raises(ValueError, match="end date"):
        usage.UsageWindow.of(DAY, date(2026, 7, 17), ZONE)
    with pytest.raises(ValueError, match="zone"):
        usage.UsageWindow.of(DAY, DAY, "Mars/Base")
    today = usage.UsageWindow.of(zone=ZONE)
    assert today.end - today.start == timedelta(days=1)


def test_the_window_reaches_the_scan(spark, folder):
    log(spark, [(1, [1])]).write.parquet(f"{folder}/t")
    plan = usage.usage_slices(spark.read.parquet(f"{folder}/t"), DAY, DAY, "PT1H", ZONE)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(connected_at" in plan and "LessThan(connec" in plan


def test_presence_and_last_seen(spark):
    sessions = spark.createDataFrame([(1, 0, 10), (1, 5, None), (2, 5, 9), (3, 11, None), (4, 10, 30)], "user_id int, opened_s int, closed_s int")
    rules = spark.createDataFrame([(4,), (4,), (9,)], "user_id int")
    present = usage.presence(sessions, 10, rules)
    assert [tuple(r) for r in present.collect()] == [(1, 1, False), (4, 1, True)]
    assert tuple(usage.presence_totals(present).first()) == (2, 2)
    assert rows(usage.last_seen(log(spark, [(1, [7]), (3, [7]), (2, [8])])), "user_id") == [(7,), (8,)]


def test_the_log_is_pruned_by_day(spark, folder):
    events = spark.sql("SELECT id AS user_id, timestamp'2024-01-01 00:30:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS connected_at FROM range(10)")
    sinks.append_connections(events, f"{folder}/log")
    log = spark.read.parquet(f"{folder}/log")
    window = usage.UsageWindow.of(date(2024, 1, 3), date(2024, 1, 4), "Asia/Tashkent")
    out = usage.usage_fixed(log, window, 86400)
    assert rows(out, "unique_connections") == rows(usage.usage_fixed(events, window, 86400), "unique_connections") == [(1,), (1,)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "day" in plan.split("PartitionFilters:")[1].split("]")[0]


@pytest.mark.parametrize("zone", ["Asia/Tashkent", "Europe/Berlin", "Asia/Kathmandu"])
def test_a_merged_state_counts_as_the_log_does(spark, zone):
    base = datetime(2026, 3, 1, tzinfo=timezone.utc)
    data = [(f"u{(i * 7) % 90}" if i % 31 else None, base + timedelta(minutes=i * 37 % 87_000)) for i in range(3000)]
    log_ = spark.createDataFrame(data, "user_id string, connected_at timestamp")
    first, rest = log_.filter("connected_at < '2026-03-20'"), log_.filter("connected_at >= '2026-03-10'")   # they overlap
    numbers = usage.user_numbers(rest, usage.user_numbers(first))
    assert rows(numbers, "number") == [(i,) for i in range(90)]
    state = usage.merge_states(usage.usage_state(first, numbers), usage.usage_state(rest, numbers))
    window = usage.UsageWindow.of(date(2026, 3, 1), date(2026, 4, 30), zone)
    known = log_.filter("user_id IS NOT NULL")
    for length in (900, 3600, 86_400, 7 * 86_400):
        assert rows(usage.state_fixed(state, window, length)) == rows(usage.usage_fixed(known, window, length))
    for unit in ("month", "year"):
        assert rows(usage.state_calendar(state, window, unit)) == rows(usage.usage_calendar(known, window, unit))
    with pytest.raises(ValueError):
        usage.state_fixed(state, window, 1000)


def test_more_users_than_one_bitmap_holds(spark):
    log_ = spark.range(100_000).select(F.col("id").alias("user_id"), F.lit(datetime(2026, 3, 1, 12)).alias("connected_at"))
    state = usage.usage_state(log_, usage.user_numbers(log_))
    assert state.count() == 4
    window = usage.UsageWindow.of(date(2026, 3, 1), date(2026, 3, 1), "UTC")
    assert [r.unique_connections for r in usage.state_fixed(usage.merge_states(state, state), window, 3600).collect()] == [100_000]
