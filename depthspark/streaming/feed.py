"""Windowed streams: message rates and net feed events per tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


LATE, ON_TIME, MARKS = "late", "on_time", "marks"


def route_late(events: DataFrame, folder: str, checkpoint: str, lateness_ms: int = 10_000, **trigger) -> StreamingQuery:
    """Writes a stream to ``folder/on_time`` and, what is behind the watermark, to ``folder/late``; no row is dropped.

    The watermark of a batch is the latest ``recv_ms`` of all batches before it, less ``lateness_ms``. It is kept in ``folder/marks`` by
    batch, and a batch writes folders of its own number, so a batch that runs again after a failure writes the same rows to the
    same places. Rows without a time are late. Windows that read the first output with the same lateness lose nothing.
    """
    spark = events.sparkSession
    spark.createDataFrame([], "high bigint").write.mode("ignore").parquet(f"{folder}/{MARKS}/epoch=-1")

    def route(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        marks = own.read.schema("high bigint, epoch bigint").parquet(f"{folder}/{MARKS}").filter(F.col("epoch") < epoch)
        high = marks.agg(F.max("high")).first()[0]
        late = F.col("recv_ms").isNull() | (F.lit(False) if high is None else F.col("recv_ms") < high - lateness_ms)
        batch.filter(late).write.mode("overwrite").parquet(f"{folder}/{LATE}/epoch={epoch}")
        batch.filter(~late).write.mode("overwrite").parquet(f"{folder}/{ON_TIME}/epoch={epoch}")
        batch.agg(F.max("recv_ms").alias("high")).write.mode("overwrite").parquet(f"{folder}/{MARKS}/epoch={epoch}")

    return events.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def late_counts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """``symbol, market, late, earliest_ms, latest_ms`` of what came too late, per book."""
    return (spark.read.schema(schema).parquet(f"{folder}/{LATE}").groupBy("symbol", "market")
            .agg(F.count("*").alias("late"), F.min("recv_ms").alias("earliest_ms"), F.max("recv_ms").alias("latest_ms")))


def message_rate(messages: DataFrame, window: str = "10 seconds", lateness: str = "30 seconds") -> DataFrame:
    """Messages per market and window; also runs on a table."""
    timed = messages.withColumn("recv_ts", F.timestamp_millis("recv_ms"))
    if messages.isStreaming:
        timed = timed.withWatermark("recv_ts", lateness)
    return (timed.groupBy(F.window("recv_ts", window), "market").agg(F.count("*").alias("messages"))
            .select(F.unix_millis("window.start").alias("window_ms"), "market", "messages"))


def coalesce_stream(events: DataFrame, tick: str = "100 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """Net event per book and tick on a stream of feed events.

    Three running maxima per tick instead of its last two events: in a feed two DROPs of one book never
    follow each other without an ADD between, so the event before a last DROP is an ADD exactly when
    the last ADD comes after the last UPDATE.
    """
    timed = events.withColumn("recv_ts", F.timestamp_millis("recv_ms")).withWatermark("recv_ts", lateness)
    payload = [c for c in events.columns if c not in ("symbol", "market")]

    def last(kind: str):
        return F.max(F.when(F.col("type") == kind, F.col("update_id")))

    net = (timed.groupBy(F.window("recv_ts", tick), "symbol", "market")
           .agg(F.max_by(F.struct(*payload), "update_id").alias("__last"), last("ADD").alias("__add"),
                last("UPDATE").alias("__update")))
    lost = ((F.col("__last.type") == "DROP") & F.col("__add").isNotNull()
            & F.coalesce(F.col("__add") > F.col("__update"), F.lit(True)))
    return net.filter(~lost).select("symbol", "market", F.unix_millis("window.start").alias("tick_ms"),
                                    *[F.col(f"__last.{c}").alias(c) for c in payload])
