"""Roll-ups of a stream of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TRACES


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TRACES).parquet(path)


def daily(traces: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests, failures, tokens and cost by day of event time; rows later than `late` are dropped by the watermark."""
    rows = traces.withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", late)
    out = rows.groupBy(F.window("at", "1 day")).agg(F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("failed"), F.sum("token_usage.total_tokens").alias("tokens"), F.sum("cost_estimate.total_cost").alias("cost"))
    return out.select(F.col("window.start").alias("day"), "requests", "failed", "tokens", "cost")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users from events (ts, user_id): start, end, events."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = rows.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
