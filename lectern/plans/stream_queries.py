"""Streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.registry import Registry
from lectern.streaming import logs

R = Registry()


@R.query("stream_event_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts by event type, computed by a stream over the table's files."""
    x = logs.drained(logs.window_counts(logs.read_stream(s, d, "events"), "ts", "event_type"), "counts", ["window_start", "event_type"])
    return x.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES, SQL = R.queries, R.sql
