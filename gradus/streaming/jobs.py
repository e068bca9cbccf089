"""Job states over an event stream (an extension: the batch form is the query job_fsm)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_state(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Last event of each job so far; events later than `late` are dropped from the watermark on."""
    return events.withWatermark("ts", late).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_events"))


def windowed_means(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Mean value by type and event-time window; each window's state goes once the watermark has passed it."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "mean", "n")
