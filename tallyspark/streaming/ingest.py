"""Structured Streaming: bronze ingest of new files, and retry detection with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config


def first_seen(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; state is kept as long as rows may be late."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def retries(stream_a: DataFrame, stream_b: DataFrame, config: Config = Config(), late: str = "10 minutes") -> DataFrame:
    """Stream-stream interval join: (customer_id, amount) again within retry_seconds under another txn_id."""
    a = stream_a.select(F.col("customer_id").alias("ca"), F.col("amount").alias("ma"), F.col("txn_id").alias("txn_a"), F.col("ts").alias("ts_a")).withWatermark("ts_a", late)
    b = stream_b.select(F.col("customer_id").alias("cb"), F.col("amount").alias("mb"), F.col("txn_id").alias("txn_b"), F.col("ts").alias("ts_b")).withWatermark("ts_b", late)
    near = F.expr(f"ca = cb AND ma = mb AND txn_a != txn_b AND ts_b >= ts_a AND ts_b <= ts_a + INTERVAL {config.retry_seconds} SECONDS")
    return a.join(b, near).select("txn_a", "txn_b", F.col("ca").alias("customer_id"), F.col("ma").alias("amount"), "ts_a", "ts_b")


def volumes(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and amounts of each tumbling window and event type."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
