"""Ordered scans that do not put a whole key into one task.

A plain window over ``(symbol, market)`` sorts every row of that key in one task, so one hot symbol
decides the run time. Here the order column is cut into blocks of ``width`` and the window runs over
``(keys, block)``. What one block hands to the next (its last row, its sum, its maximum) is one row per
block; those rows are scanned over the keys and joined back on ``(keys, block)``. The result is the
same as that of the plain window.

The input is shuffled once and computed once. Both the windows and the block rows read the same
shuffle, and Spark reuses a shuffle only if both readers ask for the same columns and filters. So the
block rows look at every column (a hash), and the join is an inner one, which puts the same not-null
filter on both sides. Without that each scan would compute its input twice, and a chain of scans
twice as often at every step. Rows with a null key are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 65_536

BLOCK = "__block"
_SEEN = "__seen"


def block_of(column: str, width: int) -> Column:
    """Number of the block of ``width`` a whole number falls into; exact, and right below zero too."""
    return F.expr(f"(`{column}` - pmod(`{column}`, {width})) div {width}")


def plain_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows without null in a key that is a float, and the keys with a whole number in place of each float.

    Spark normalises floats in windows, aggregates and joins but not in ``repartition``, so a window over a float key shuffles
    once more. ``xxhash64`` of one number is one to one, and equal for 0.0 and -0.0 and for all NaN, so nothing else changes.
    """
    floats = {k: f"__key_{k}" for k in keys if df.schema[k].dataType.typeName() in ("double", "float")}
    for key, name in floats.items():
        df = df.filter(F.col(key).isNotNull()).withColumn(name, F.xxhash64(key))
    return df, [floats.get(k, k) for k in keys]


def cut_blocks(df: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    """Adds the block of each row and brings the rows of a block together."""
    block = F.coalesce(block_of(order, width), F.lit(0).cast("bigint"))
    return df.withColumn(BLOCK, block).repartition(*keys, BLOCK)


def per_block(cut: DataFrame, keys: list[str], *ends: Column) -> DataFrame:
    """One row per block with ``ends``, from the shuffle that ``cut_blocks`` made."""
    return cut.groupBy(*keys, BLOCK).agg(*ends, F.max(F.xxhash64(*cut.columns)).alias(_SEEN))


def handed_on(value: Column) -> Column:
    """Ties a carried value to the hash, so that the hash is not optimised away. It is never null."""
    return F.when(F.col(_SEEN).isNotNull(), value)


def _rank(order: list[str]) -> Column:
    # A single numeric column keeps max_by in a hash aggregate; a struct would need sorting.
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def previous(df: DataFrame, keys: list[str], order: list[str], values: list[str], width: int = WIDTH,
             prefix: str = "prev_") -> DataFrame:
    """Adds ``prev_<value>``: the value in the row before, per ``keys`` by ``order``.

    ``order[0]`` must be a whole number; together with ``keys`` the order should be unique.
    """
    columns, (df, keys) = df.columns, plain_keys(df, keys)
    cut = cut_blocks(df, keys, order[0], width)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    between = Window.partitionBy(*keys).orderBy(BLOCK)
    # One max_by per value, not one over a struct: plain numbers stay in a hash aggregate.
    last = [F.max_by(v, _rank(order)).alias(f"__end_{v}") for v in values]
    end = F.struct(*[F.col(f"__end_{v}").alias(v) for v in values])
    carried = (per_block(cut, keys, *last)
               .select(*keys, BLOCK, F.lag(handed_on(end)).over(between).alias("__carried")))
    local = cut.withColumn("__before", F.lag(F.struct(*values)).over(inside))
    before = F.coalesce("__before", "__carried")
    return local.join(carried, [*keys, BLOCK]).select(
        *[F.col(c) for c in columns], *[before.getField(v).alias(prefix + v) for v in values])


_PLAIN = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: list[str], order: list[str], width: int = WIDTH,
            inclusive: bool = True, **outputs: tuple[str, str]) -> DataFrame:
    """Adds running aggregates per ``keys`` by ``order``.

    ``outputs`` maps a new column to ``(kind, column)`` with kind ``sum``, ``count``, ``max``, ``min`` or
    ``last`` (last value that is not null). With ``inclusive=False`` the current row is left out and
    the first row gets null (0 for ``count``).
    """
    columns, (df, keys) = df.columns, plain_keys(df, keys)
    cut = cut_blocks(df, keys, order[0], width)
    stop = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    ends, carried, local, merged = [], [], {}, []
    for name, (kind, column) in outputs.items():
        value, part, carry = F.col(column), f"__end_{name}", f"__carried_{name}"
        passed = handed_on(F.col(part))
        if kind == "last":
            ends.append(F.max_by(value, F.when(value.isNotNull(), _rank(order))).alias(part))
            carried.append(F.last(passed, ignorenulls=True).over(before).alias(carry))
            local[name] = F.last(value, ignorenulls=True).over(inside)
            merged.append(F.coalesce(name, carry).alias(name))
            continue
        ends.append(_PLAIN[kind](value).alias(part))
        local[name] = _PLAIN[kind](value).over(inside)
        if kind in ("max", "min"):
            carried.append(_PLAIN[kind](passed).over(before).alias(carry))
            pick = F.greatest if kind == "max" else F.least
            merged.append(pick(name, carry).alias(name))
        else:
            carried.append(F.sum(passed).over(before).alias(carry))
            total = F.coalesce(name, F.lit(0)) + F.coalesce(carry, F.lit(0))
            if kind == "sum":
                total = F.when(F.col(name).isNotNull() | F.col(carry).isNotNull(), total)
            merged.append(total.alias(name))

    blocks = per_block(cut, keys, *ends).select(*keys, BLOCK, *carried)
    return (cut.withColumns(local).join(blocks, [*keys, BLOCK])
            .select(*[F.col(c) for c in columns], *merged))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str, width: int = WIDTH) -> DataFrame:
    """Adds the 1-based position per ``keys`` by ``order``."""
    return (running(df.withColumn("__one", F.lit(1)), keys, order, width, **{name: ("count", "__one")})
            .drop("__one"))


def numbered_since(df: DataFrame, keys: list[str], order: list[str], mark: str, last: str, number: str,
                   width: int = WIDTH) -> DataFrame:
    """Adds ``last``, the latest value of ``mark`` that is not null, and ``number``, the 1-based position
    since that row (which is 1). Before the first mark ``last`` is null and rows are numbered from 1.

    A block hands on how many rows it has and how many of them come since its last mark. With T the
    running total over blocks, the rows since the last mark are T minus the greatest ``T - since``
    among the blocks that have a mark.
    """
    columns, (df, keys) = df.columns, plain_keys(df, keys)
    cut = cut_blocks(df, keys, order[0], width)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = F.col(mark).isNotNull()
    local = (cut.withColumns({"__n": F.count(F.lit(1)).over(inside),
                              "__last": F.last(mark, ignorenulls=True).over(inside)})
             .withColumn("__at", F.max(F.when(marked, F.col("__n"))).over(inside)))
    upto = Window.partitionBy(*keys).orderBy(BLOCK)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    ends = (per_block(local, keys, F.count(F.lit(1)).alias("__rows"), F.max("__at").alias("__at_end"),
                      F.max_by("__last", "__n").alias("__last_end"))
            .withColumn("__total", F.sum(handed_on(F.col("__rows"))).over(
                upto.rowsBetween(Window.unboundedPreceding, 0))))
    started = F.col("__total") - F.col("__rows") + F.col("__at_end") - 1
    carried = ends.select(
        *keys, BLOCK, (F.col("__total") - F.col("__rows") - F.coalesce(F.max(started).over(before), F.lit(0))).alias("__since"),
        F.last("__last_end", ignorenulls=True).over(before).alias("__last_in"))
    joined = local.join(carried, [*keys, BLOCK])
    position = F.when(F.col("__at").isNotNull(), F.col("__n") - F.col("__at") + 1).otherwise(
        F.col("__since") + F.col("__n"))
    return joined.select(*[F.col(c) for c in columns], F.coalesce("__last", "__last_in").alias(last),
                         position.alias(number))


def best_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows per key with their rank.

    Spark turns ``row_number() <= k`` into a group limit that runs before the shuffle too, so no task
    ever receives more than ``k`` rows of a key from each map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
