"""Raw exchange JSON to typed rows. Everything here is map-side: no shuffle, works on streams too.

Raw rows have ``raw`` (text), ``market`` and ``recv_ms``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIRS = "array<array<string>>"
_SYMBOL = '"s":"'


def read_depth(raw: DataFrame) -> DataFrame:
    """Depth messages with their symbol; short frames, acks and messages without a symbol are dropped."""
    start = F.instr("raw", _SYMBOL)
    rest = F.substring(F.col("raw"), start + len(_SYMBOL), F.length("raw"))
    return (raw.filter((F.length("raw") > 4) & (F.substring("raw", 3, 1) != "r") & (start > 0) & rest.contains('"'))
            .withColumn("symbol", F.substring_index(rest, '"', 1)))


def _levels(pairs: Column) -> Column:
    def pair(p: Column) -> Column:
        return F.struct(F.get(p, 0).try_cast("double").alias("price"), F.get(p, 1).try_cast("double").alias("qty"))
    return F.transform(pairs, pair)


def _unreadable(levels: Column) -> Column:
    return F.exists(levels, lambda x: x["price"].isNull() | x["qty"].isNull())


def parse_diffs(depth: DataFrame) -> DataFrame:
    """Ids and levels of each diff; absent ids read as 0, ``bad`` marks text that cannot be read.

    The object is read once as a map: ``U`` and ``u`` differ by case only, so they cannot be two fields of
    one struct. A diff without ``b`` (or ``a``) gets null, not an empty array.
    """
    fields = F.from_json("raw", "map<string,string>")

    def number(name: str) -> Column:
        return F.coalesce(F.col("__f")[name].try_cast("bigint"), F.lit(0))

    df = (depth.withColumn("__f", fields)
          .withColumns({"bids": _levels(F.from_json(F.col("__f")["b"], _PAIRS)),
                        "asks": _levels(F.from_json(F.col("__f")["a"], _PAIRS))}))
    lost = ((F.col("__f")["b"].isNotNull() & F.col("bids").isNull())
            | (F.col("__f")["a"].isNotNull() & F.col("asks").isNull()))
    bad = (F.col("__f").isNull() | lost | F.coalesce(_unreadable(F.col("bids")), F.lit(False))
           | F.coalesce(_unreadable(F.col("asks")), F.lit(False)))
    return df.select("symbol", "market", number("U").alias("first_id"), number("u").alias("final_id"),
                     number("pu").alias("prev_final_id"), "recv_ms", "bids", "asks", bad.alias("bad"))


def explode_levels(parsed: DataFrame, update_id: str = "final_id") -> DataFrame:
    """One row per level; ``pos`` keeps the order inside the message, bids before asks."""
    def tagged(column: str, side: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<struct<price:double,qty:double>>")),
                           lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"),
                                              x["qty"].alias("qty")))

    both = F.concat(tagged("bids", "BID"), tagged("asks", "ASK"))
    return (parsed.select("symbol", "market", F.col(update_id).alias("update_id"), "recv_ms",
                          F.posexplode(both).alias("pos", "__level"))
            .select("symbol", "market", "__level.side", "__level.price", "__level.qty", "update_id", "pos", "recv_ms"))


def parse_snapshots(raw: DataFrame) -> DataFrame:
    """Snapshots with their id, levels without quantity left out. Failed snapshots are left out as a whole: those without
    an id, with sides that are no lists of levels, or with any level that cannot be read."""
    def loaded(name: str) -> Column:
        return F.filter(name, lambda x: x["qty"] > 0)

    return (read_snapshots(raw).filter(~F.col("bad"))
            .select("symbol", "market", "snapshot_id", "recv_ms", loaded("bids").alias("bids"), loaded("asks").alias("asks")))


def read_snapshots(raw: DataFrame) -> DataFrame:
    """All snapshots as they are: ``snapshot_id, bids, asks`` and ``bad``, whether the snapshot has failed."""
    parsed = F.from_json("raw", f"lastUpdateId bigint, bids {_PAIRS}, asks {_PAIRS}")
    df = raw.withColumn("__s", parsed).withColumns({name: _levels(F.col("__s")[name]) for name in ("bids", "asks")})
    lost = F.col("__s.lastUpdateId").isNull() | F.col("bids").isNull() | F.col("asks").isNull()
    bad = lost | _unreadable(F.col("bids")) | _unreadable(F.col("asks"))
    return df.select("symbol", "market", F.col("__s.lastUpdateId").alias("snapshot_id"), "recv_ms", "bids", "asks", F.coalesce(bad, F.lit(True)).alias("bad"))


def read_exchange_info(json: DataFrame, market: str | None = None) -> DataFrame:
    """One row per symbol; unknown fields are ignored, ``contract_type`` is null on spot."""
    shape = "symbols array<struct<symbol:string,quoteAsset:string,status:string,contractType:string>>"
    rows = (json.select(F.explode(F.from_json("json", shape)["symbols"]).alias("s"))
            .select(F.col("s.symbol").alias("symbol"), F.col("s.quoteAsset").alias("quote_asset"),
                    F.col("s.status").alias("status"), F.col("s.contractType").alias("contract_type")))
    return rows if market is None else rows.withColumn("market", F.lit(market))
