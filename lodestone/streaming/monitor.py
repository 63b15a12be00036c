"""Event-time monitoring of pipeline logs; the same aggregates run on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, where: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(where)


def counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and users of each window and type; rows later than ``late`` are left out of a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("window_start"), "event_type", "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n")


def answer_events(answer: str, citations: list[str]) -> list[tuple[str, str]]:
    """The event sequence of a buffered answer: metadata, at most one token, citations, done."""
    import json

    middle = [("token", answer)] if answer else []
    return [("metadata", "{}"), *middle, ("citations", json.dumps(citations)), ("done", "{}")]


def server_sent(events: list[tuple[str, str]]) -> str:
    """Server-sent-event text of (event, data) pairs."""
    return "".join(f"event: {e}\n" + "".join(f"data: {line}\n" for line in d.split("\n")) + "\n" for e, d in events)
