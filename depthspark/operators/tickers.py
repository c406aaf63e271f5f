"""The tradable universe from exchange information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Symbols left out of the universe.
EXCLUDED = ("USDCUSDT", "FDUSDUSDT", "DAIUSDT", "PYUSDUSDT", "USD1USDT", "XAUTUSDT", "PAXGUSDT")
QUOTE = "USDT"
TRADING = "TRADING"
PERPETUAL = "PERPETUAL"


def build_tickers(spot: DataFrame, futures: DataFrame, excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """Trading perpetual USDT futures, flagged with whether a trading USDT spot pair exists."""
    live = (F.col("status") == TRADING) & (F.col("quote_asset") == QUOTE)
    kept = futures.filter(live & (F.col("contract_type") == PERPETUAL))
    if excluded:
        kept = kept.filter(~F.col("symbol").isin(*excluded))
    pairs = spot.filter(live).select("symbol").distinct().withColumn("has_spot", F.lit(True))
    return (kept.select("symbol").distinct().join(pairs, "symbol", "left")
            .select("symbol", F.lit(True).alias("has_futures"),
                    F.coalesce("has_spot", F.lit(False)).alias("has_spot")))


def ticker_summary(tickers: DataFrame) -> DataFrame:
    return tickers.agg(F.count("*").alias("total"), F.count_if(F.col("has_spot")).alias("spot_count"),
                       F.count_if(F.col("has_futures")).alias("futures_count"))


def ticker_list(tickers: DataFrame) -> DataFrame:
    return tickers.orderBy("symbol")
