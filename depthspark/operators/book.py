"""Order books from level changes: sequence checks, sync, state at a moment, sweep and views.

Level changes have ``symbol, market, side, price, qty, update_id, recv_ms`` and optionally ``pos``, the
place inside one diff. Distances are fractions of the mid price, ``band`` too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthspark.operators import dyadic, scan

BAND = 0.1
BOOK = ["symbol", "market"]
LEVEL = ["symbol", "market", "side", "price"]

# A price level sees few of the changes of its book, so scans per level use longer blocks.
LEVEL_STRETCH = 64

# Diff ids whose whole covers are kept together in the search for best prices, as a power of two.
STRIDE = 6

# Blocks over arrival time are as long as a block of ids at this many milliseconds per diff.
MS_PER_DIFF = 50


def nearest_first(side: str = "side", price: str = "price") -> Column:
    """Sort key that runs from the best price outward on both sides."""
    return F.when(F.col(side) == "BID", -F.col(price)).otherwise(F.col(price))


def _rank(df: DataFrame) -> Column:
    # One number, so that the aggregate stays a hash aggregate. ANSI mode raises on overflow.
    pos = F.col("pos").cast("bigint") if "pos" in df.columns else F.lit(0).cast("bigint")
    return F.col("update_id") * 65_536 + pos


# --- sequence and sync -------------------------------------------------------------------------


def sequence_gaps(diffs: DataFrame, width: int = scan.WIDTH) -> DataFrame:
    """Adds ``prev_id``, ``prev_ms`` and ``is_gap``. Arrival order is ``(recv_ms, final_id)``.

    Where the columns ``bids`` and ``asks`` are there, a diff that has neither is never a gap. The first
    diff of a book has nothing before it and is no gap. Rows with ``bad = true`` (text that could not be
    read) always are.
    """
    seen = scan.previous(diffs, BOOK, ["recv_ms", "final_id"], ["final_id", "recv_ms"], width * MS_PER_DIFF,
                         prefix="__prev_")
    last = F.col("__prev_final_id")
    broken = (F.when(F.col("market") == "SPOT", F.col("first_id") != last + 1)
              .otherwise(F.col("prev_final_id") != last))
    if {"bids", "asks"} <= set(diffs.columns):
        broken = broken & (F.col("bids").isNotNull() | F.col("asks").isNotNull())
    gap = F.coalesce(broken, F.lit(False))
    if "bad" in diffs.columns:
        gap = gap | F.coalesce("bad", F.lit(False))
    return (seen.withColumn("is_gap", gap)
            .withColumnsRenamed({"__prev_final_id": "prev_id", "__prev_recv_ms": "prev_ms"}))


def with_segments(diffs: DataFrame, width: int = scan.WIDTH) -> DataFrame:
    """``sequence_gaps`` with the runs between gaps numbered: ``segment`` goes up by one at each gap."""
    gaps = sequence_gaps(diffs, width).withColumn("__gap", F.col("is_gap").cast("bigint"))
    return scan.running(gaps, BOOK, ["recv_ms", "final_id"], width * MS_PER_DIFF, segment=("sum", "__gap")).drop("__gap")


def sync_points(snapshots: DataFrame, segments: DataFrame, width: int = scan.WIDTH) -> DataFrame:
    """For each snapshot the diff that joins it to the live sequence; ``segments`` are ``with_segments``.

    The buffer of a snapshot is every diff of the current run that came before the snapshot, without the
    diff that broke the sequence; the first of them with ``final_id >= snapshot_id`` must cover
    ``snapshot_id``. Ids only grow inside a run, so that is the diff of the run whose ids hold
    ``snapshot_id``. Snapshots meet diffs in dyadic buckets of ids, mostly one per diff, so that a snapshot meets only diffs that
    hold it. There are far fewer snapshots than diffs, so Spark mostly broadcasts them and leaves the diffs where they are.
    """
    diffs = segments.filter(~F.col("is_gap") & (F.col("first_id") > 0)).select(   # an absent id reads as 0 and covers nothing
        *BOOK, "segment", "first_id", F.col("final_id").alias("sync_id"), (F.col("final_id") + 1).alias("__stop_id"),
        "prev_id", "prev_ms", F.col("recv_ms").alias("sync_ms"))
    asked = snapshots.select(*BOOK, "snapshot_id", "recv_ms")
    met = (dyadic.dyadic_join(asked, diffs, BOOK, "snapshot_id", "first_id", "__stop_id")
           .filter(F.col("sync_ms") <= F.col("recv_ms")))
    starts = segments.groupBy(*BOOK, "segment").agg(F.min("recv_ms").alias("__next_ms"))
    after = starts.select(*BOOK, (F.col("segment") - 1).alias("segment"), "__next_ms")
    # Runs are numbered without holes, so the next run is the one with the next number.
    current = (met.join(after, [*BOOK, "segment"], "left")
               .filter(F.col("__next_ms").isNull() | (F.col("recv_ms") < F.col("__next_ms"))))
    found = current.groupBy(*BOOK, "snapshot_id", "recv_ms").agg(
        F.min(F.struct("sync_id", "segment", "prev_id", "prev_ms", "sync_ms")).alias("__hit"))
    return (asked.join(found, [*BOOK, "snapshot_id", "recv_ms"], "left")
            .select(*asked.columns, *[F.col(f"__hit.{c}").alias(c) for c in ("segment", "sync_id", "sync_ms")],
                    F.col("__hit.prev_id").alias("before_id"), F.col("__hit.prev_ms").alias("before_ms"),
                    F.when(F.col("__hit").isNull(), "RESYNC").otherwise("SYNCED").alias("status")))


def sync_segments(segments: DataFrame, sync: DataFrame) -> DataFrame:
    """State of each book over its diffs, as ranges of ids and arrival times.

    Per run of ``with_segments``: the diff that broke the sequence is PENDING (it is lost), then
    SNAPSHOT_REQUESTED up to the first good snapshot of the run, then SYNCED to the end of the run. One
    aggregate brings the diffs down to runs; the rest works on runs.
    """
    gap, final, ms = F.col("is_gap"), F.col("final_id"), F.col("recv_ms")
    runs = segments.groupBy(*BOOK, "segment").agg(
        F.max(F.when(gap, final)).alias("gap_id"), F.max(F.when(gap, ms)).alias("gap_ms"),
        F.min(F.when(~gap, final)).alias("start_id"), F.min(F.when(~gap, ms)).alias("start_ms"),
        F.max(F.when(~gap, final)).alias("end_id"), F.max(F.when(~gap, ms)).alias("end_ms"))
    good = (sync.filter(F.col("status") == "SYNCED").groupBy(*BOOK, "segment")
            .agg(F.min(F.struct("recv_ms", "sync_id", "sync_ms", "before_id", "before_ms")).alias("__good")))
    df = runs.join(good, [*BOOK, "segment"], "left")
    at, live = F.col("__good"), F.col("__good").isNotNull()

    def part(state: str, condition: Column, from_id, to_id, from_ms, to_ms) -> Column:
        return F.when(condition, F.struct(
            F.lit(state).alias("state"), from_id.alias("from_id"), to_id.alias("to_id"), from_ms.alias("from_ms"),
            to_ms.alias("to_ms")))

    waits = F.col("start_id").isNotNull() & (~live | (at["sync_id"] > F.col("start_id")))
    parts = F.array(
        part("PENDING", F.col("gap_id").isNotNull(), F.col("gap_id"), F.col("gap_id"), F.col("gap_ms"),
             F.col("gap_ms")),
        part("SNAPSHOT_REQUESTED", waits, F.col("start_id"), F.when(live, at["before_id"]).otherwise(F.col("end_id")),
             F.col("start_ms"), F.when(live, at["before_ms"]).otherwise(F.col("end_ms"))),
        part("SYNCED", live, at["sync_id"], F.col("end_id"), at["sync_ms"], F.col("end_ms")))
    return (df.select(*BOOK, "segment", F.explode(F.array_compact(parts)).alias("__part"))
            .select(*BOOK, "segment", "__part.*"))


def state_at(segments: DataFrame, as_of_ms: int | Column) -> DataFrame:
    """One row per book: its state at ``as_of_ms``, which may be a scalar subquery, and since when."""
    return (segments.filter(F.col("from_ms") <= as_of_ms).groupBy(*BOOK)
            .agg(F.max_by("state", F.struct("from_ms", "from_id")).alias("state"),
                 F.max("from_ms").alias("since_ms")))


def sync_counts(segments: DataFrame, as_of_ms: int) -> DataFrame:
    return (state_at(segments, as_of_ms).filter(F.col("state") == "SYNCED")
            .groupBy("market").agg(F.count("*").alias("synced")))


def snapshot_backlog(segments: DataFrame, as_of_ms: int, limit: int = 10) -> DataFrame:
    """Books waiting for a snapshot, with the ``limit`` longest waiting per market marked admitted."""
    waiting = (state_at(segments, as_of_ms).filter(F.col("state") == "SNAPSHOT_REQUESTED")
               .select("market", "symbol", F.col("since_ms").alias("waiting_since")))
    first = scan.best_rows(waiting, ["market"], [F.col("waiting_since"), F.col("symbol")], limit, "__n")
    return (waiting.join(first.select("market", "symbol", F.lit(True).alias("admitted")),
                         ["market", "symbol"], "left")
            .withColumn("admitted", F.coalesce("admitted", F.lit(False))))


# --- state at a moment -------------------------------------------------------------------------


def reconstruct_book(changes: DataFrame, as_of_id: int | None = None, as_of_ms: int | None = None,
                     snapshot_levels: DataFrame | None = None) -> DataFrame:
    """Live levels: the last quantity per price wins, zero removes.

    ``snapshot_levels`` (``symbol, market, side, price, qty, snapshot_id``, one snapshot per book) are the
    base: whatever was set before the snapshot and is not in it is gone. Price is part of the grouping
    key, so a busy symbol spreads over all tasks. A ``first_seen_ms`` column is carried along.
    """
    if as_of_id is not None:
        changes = changes.filter(F.col("update_id") <= as_of_id)
    if as_of_ms is not None:
        changes = changes.filter(F.col("recv_ms") <= as_of_ms)
    kept = ["qty"] + [c for c in ("first_seen_ms",) if c in changes.columns]
    rows = changes.select(*LEVEL, *kept, "update_id", _rank(changes).alias("__rank"))
    if snapshot_levels is not None:
        # Changes of one diff start at pos 0; the snapshot sorts before a diff with the same id.
        rows = rows.withColumn("__rank", F.col("__rank") + 1).unionByName(
            snapshot_levels.filter(F.col("qty") > 0).select(
                *LEVEL, *kept, F.col("snapshot_id").alias("update_id"),
                (F.col("snapshot_id") * 65_536).alias("__rank")))
    live = (rows.groupBy(*LEVEL)
            .agg(*[F.max_by(c, "__rank").alias(c) for c in kept], F.max("update_id").alias("last_id"))
            .filter(F.col("qty") > 0))
    if snapshot_levels is not None:
        base = snapshot_levels.groupBy(*BOOK).agg(F.max("snapshot_id").alias("__base"))
        live = (live.join(base, BOOK, "left")
                .filter(F.col("__base").isNull() | (F.col("last_id") >= F.col("__base"))).drop("__base"))
    return live


def first_seen(changes: DataFrame, width: int = scan.WIDTH) -> DataFrame:
    """Adds ``first_seen_ms``: when the level was inserted, kept while its quantity changes.

    A delete ends a run; so does a row with ``restart = true`` where that column is there (a snapshot
    load). Rows that delete get null. One blocked scan: a run that starts inside a block is known there;
    a run that is open at a block's first row started where the blocks before say, or at that row. Of the
    blocks since the last one with an end or a start inside, the earliest time is the start.
    """
    block = scan.BLOCK
    order = ["update_id", "pos"] if "pos" in changes.columns else ["update_id"]
    rows, level = scan.plain_keys(changes, LEVEL)
    cut = scan.cut_blocks(rows, level, "update_id", width * LEVEL_STRETCH)
    inside = Window.partitionBy(*level, block).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.coalesce(F.lag(F.col("qty") == 0).over(inside), F.lit(False))
    if "restart" in changes.columns:
        starts = starts | F.col("restart")
    local = (cut.withColumns({"__begins": starts, "__entry": F.first("recv_ms").over(so_far),
                              "__n": F.count(F.lit(1)).over(so_far)})
             .withColumn("__start", F.when((F.col("qty") > 0) & F.col("__begins"), F.col("recv_ms")))
             .withColumn("__start", F.last("__start", ignorenulls=True).over(so_far)))

    ends = scan.per_block(local, level, F.max_by("qty", "__n").alias("__qty"), F.max_by("__start", "__n").alias("__own"),
                          F.min("__entry").alias("__entry"))
    opened = scan.handed_on(F.col("__qty")) > 0
    through = opened & F.col("__own").isNull()
    over = Window.partitionBy(*level).orderBy(block)
    grouped = ends.withColumns({
        "__since": F.when(through, F.col("__entry")).when(opened, F.col("__own")),
        "__group": F.sum(F.when(through, 0).otherwise(1)).over(over.rowsBetween(Window.unboundedPreceding, 0))})
    since = F.min("__since").over(
        Window.partitionBy(*level, "__group").orderBy(block).rowsBetween(Window.unboundedPreceding, 0))
    carried = (grouped.withColumn("__open", since)
               .select(*level, block, F.lag("__open").over(over).alias("__in")))
    seen = F.coalesce("__start", "__in", "__entry")
    return local.join(carried, [*level, block]).select(
        *[F.col(c) for c in changes.columns], F.when(F.col("qty") > 0, seen).alias("first_seen_ms"))


def with_distance(book: DataFrame, band: float = BAND, keys: list[str] = BOOK) -> DataFrame:
    """Adds ``mid`` and ``distance`` and drops levels outside the band.

    A book with an empty side keeps its levels, with null mid and distance. The best prices are a
    partial aggregate; joining them back leaves it to Spark to broadcast them when they measure small.
    """
    best = book.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "BID", F.col("price"))).alias("__bid"),
        F.min(F.when(F.col("side") == "ASK", F.col("price"))).alias("__ask"))
    mids = best.select(*keys, ((F.col("__bid") + F.col("__ask")) / 2.0).alias("mid"))
    joined = book.join(mids, keys)
    inside = ((F.col("price") >= F.col("mid") * (1.0 - F.lit(band)))
              & (F.col("price") <= F.col("mid") * (1.0 + F.lit(band))))
    return (joined.filter(F.col("mid").isNull() | inside)
            .withColumn("distance", F.abs(F.col("price") - F.col("mid")) / F.col("mid")))


def versions(changes: DataFrame, width: int = scan.WIDTH) -> DataFrame:
    """Each set level with the time it holds: ``[from_ms, to_ms)``, open end = null."""
    back = changes.withColumn("__back", -_rank(changes))
    ahead = scan.previous(back, LEVEL, ["__back"], ["recv_ms"], width * LEVEL_STRETCH * 65_536, prefix="next_")
    return (ahead.filter(F.col("qty") > 0)
            .select(*LEVEL, "qty", "update_id", F.col("recv_ms").alias("from_ms"),
                    F.col("next_recv_ms").alias("to_ms")))


def book_at(changes: DataFrame, start_ms: int, end_ms: int | Column, step_ms: int = 100,
            width: int = scan.WIDTH) -> DataFrame:
    """The whole book at every tick of a grid, ``start_ms <= tick_ms <= end_ms``.

    On a regular grid no join is needed: each version lists the ticks it holds at. ``end_ms`` may be a
    scalar subquery. For other ticks join ``versions`` with ``intervals.interval_join``.
    """
    ahead = F.greatest(F.col("from_ms"), F.lit(start_ms)) - start_ms
    first = F.lit(start_ms) + F.call_function("div", ahead + (step_ms - 1), F.lit(step_ms)) * step_ms
    last = F.least(F.coalesce(F.col("to_ms") - 1, F.lit(end_ms)), F.lit(end_ms))
    return (versions(changes, width)
            .withColumns({"__first": first.cast("bigint"), "__last": last.cast("bigint")})
            .filter(F.col("__first") <= F.col("__last"))
            .select(*LEVEL, "qty", "update_id",
                    F.explode(F.sequence("__first", "__last", F.lit(step_ms).cast("bigint"))).alias("tick_ms")))


# --- best prices at every diff, and the sweep ---------------------------------------------------


def id_ranges(changes: DataFrame, width: int = scan.WIDTH) -> DataFrame:
    """Each set level with the diff ids it holds for: ``[from_id, to_id)``, up to the last id of the book."""
    back = changes.withColumn("__back", -_rank(changes))
    ahead = scan.previous(back, LEVEL, ["__back"], ["update_id"], width * LEVEL_STRETCH * 65_536, prefix="next_")
    last = changes.groupBy(*BOOK).agg(F.max("update_id").alias("__last"))
    return (ahead.filter(F.col("qty") > 0).join(last, BOOK)
            .select(*LEVEL, "qty", F.col("update_id").alias("from_id"), F.coalesce("next_update_id", F.col("__last") + 1).alias("to_id")))


def best_over(ranges: DataFrame, ids: DataFrame, keys: list[str] = BOOK) -> DataFrame:
    """``keys, update_id, best_bid, best_ask``: the best prices that hold at each id; ``ranges`` are ``id_ranges``.

    Ids are cut into strides of ``2**STRIDE``. What a range covers of whole strides becomes a few dyadic buckets; each bucket keeps its
    best bid and ask, and a stride takes the best of the buckets that hold it. Of the two ends of a range, which lie inside a
    stride, only those that beat the best of their whole stride matter, and only these are spread over their ids.
    """
    bid, ask = F.when(F.col("side") == "BID", F.col("price")), F.when(F.col("side") == "ASK", F.col("price"))
    best = (F.max("bid").alias("bid"), F.min("ask").alias("ask"))
    begin, end = F.col("from_id"), F.col("to_id")
    up, down = -F.shiftright(-begin, STRIDE), F.shiftright(end, STRIDE)      # the whole strides are [up, down)
    cut = ranges.filter(end > begin).select(*keys, bid.alias("bid"), ask.alias("ask"), "from_id", "to_id", up.alias("__up"), down.alias("__down"))
    held = (cut.filter("__up < __down").withColumn("__bucket", F.explode(dyadic.buckets(F.col("__up"), F.col("__down"))))
            .groupBy(*keys, "__bucket").agg(*best))
    named = ids.select(*keys, "update_id").distinct().withColumn("__stride", F.shiftright("update_id", STRIDE))
    strides = named.select(*keys, "__stride").distinct()
    spread = strides.groupBy(*keys).agg((F.max("__stride") - F.min("__stride") + 1).alias("n"))
    top = F.coalesce(spread.select(F.max(dyadic.height_of(F.col("n")))).scalar(), F.lit(0))
    whole = (strides.withColumn("__top", top + 1).withColumn("__bucket", F.explode(dyadic.above(F.col("__stride"), F.col("__top"))))
             .join(held, [*keys, "__bucket"]).groupBy(*keys, "__stride").agg(F.max("bid").alias("__bid"), F.min("ask").alias("__ask")))

    def piece(a: Column, b: Column) -> Column:
        return F.when(a < b, F.struct(F.shiftright(a, STRIDE).alias("__stride"), a.alias("a"), b.alias("b")))

    ends = F.array_compact(F.array(piece(begin, F.least(end, F.shiftleft("__up", STRIDE))),
                                   piece(F.greatest(F.shiftleft("__down", STRIDE), F.shiftleft("__up", STRIDE)), end)))
    # An end inside one stride lies between the borders ``__down <= from`` and ``to <= __up``; it is the first piece.
    beats = (F.coalesce(F.col("bid") > F.col("__bid"), F.col("bid").isNotNull()) | F.coalesce(F.col("ask") < F.col("__ask"), F.col("ask").isNotNull()))
    partly = (cut.select(*keys, "bid", "ask", F.explode(ends).alias("__end")).select(*keys, "bid", "ask", "__end.*")
              .join(whole, [*keys, "__stride"], "left").filter(beats)
              .select(*keys, "bid", "ask", F.explode(F.sequence("a", F.col("b") - 1)).alias("update_id"))
              .groupBy(*keys, "update_id").agg(*best))
    return (named.join(whole, [*keys, "__stride"], "left").join(partly, [*keys, "update_id"], "left")
            .select(*keys, "update_id", F.greatest("bid", "__bid").alias("best_bid"), F.least("ask", "__ask").alias("best_ask")))


def mids(changes: DataFrame, width: int = scan.WIDTH) -> DataFrame:
    """Best bid, best ask and mid after every diff id, from books that are not swept."""
    best = best_over(id_ranges(changes, width), changes)
    return best.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2.0)


def sweep_book(book: DataFrame, mid_rows: DataFrame, as_of_id: int | None = None, band: float = BAND,
               width: int = scan.WIDTH) -> DataFrame:
    """Removes levels that were outside the band at any diff since they were last set.

    A level is gone for good once the mid moves too far from it, even if the mid comes back. It
    survives if it lies inside the band of the greatest and the smallest mid from its last change
    (``last_id``) on; those come from one scan over the ids from the end.
    """
    if as_of_id is not None:
        mid_rows = mid_rows.filter(F.col("update_id") <= as_of_id)
    back = mid_rows.select(*BOOK, F.col("update_id").alias("last_id"), "mid",
                           (-F.col("update_id")).alias("__back"))
    since = (scan.running(back, BOOK, ["__back"], width, __high=("max", "mid"), __low=("min", "mid"))
             .select(*BOOK, "last_id", "__high", "__low"))
    kept = ((F.col("price") >= F.col("__high") * (1.0 - F.lit(band)))
            & (F.col("price") <= F.col("__low") * (1.0 + F.lit(band))))
    return (book.join(since, [*BOOK, "last_id"], "left")
            .filter(F.col("__high").isNull() | kept).drop("__high", "__low"))


def book_of_record(changes: DataFrame, as_of_id: int | None = None, band: float = BAND,
                   width: int = scan.WIDTH) -> DataFrame:
    """Last values, minus everything swept on the way, with distances."""
    if as_of_id is not None:
        changes = changes.filter(F.col("update_id") <= as_of_id)
    return with_distance(sweep_book(reconstruct_book(changes), mids(changes, width), band=band, width=width), band)


# --- view --------------------------------------------------------------------------------------


def book_view(book: DataFrame, as_of_ms: int | Column, segments: DataFrame | None = None) -> DataFrame:
    """Levels with age and per-side counts; ``nearest_first`` is the order to show them in.

    ``book`` has ``first_seen_ms`` and ``distance``. With ``segments`` the sync state is added. ``as_of_ms`` may be a
    scalar subquery.
    """
    counts = book.groupBy(*BOOK).agg(
        F.count_if(F.col("side") == "BID").alias("bid_count"),
        F.count_if(F.col("side") == "ASK").alias("ask_count"))
    view = (book.join(counts, BOOK)
            .withColumn("lifetime_ms", F.lit(as_of_ms) - F.col("first_seen_ms")))
    if segments is not None:
        view = view.join(state_at(segments, as_of_ms).select(*BOOK, "state"), BOOK, "left")
    return view
