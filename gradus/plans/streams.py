"""Registered queries of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators.stages import new_folder
from gradus.plans import views as V
from gradus.plans.registry import query
from gradus.streaming import machine

DAY = 86_400_000_000


def job_events(events: DataFrame) -> DataFrame:
    """Each user as a job whose events are statuses and restarts, by a hash of their ids."""
    kinds = ("queued", "queued", "validating", "processing", "processing", "exporting", "succeeded", "succeeded", "failed", "cancel_requested", "cancelled", machine.RESTART)
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.pmod(F.xxhash64("event_id"), F.lit(len(kinds))).cast("int") + 1)
    return events.select(F.col("user_id").cast("long").alias("job"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("event"))


@query()
def job_transitions(spark, sf_dir):
    """What every event did to its job: moved it, was not allowed, interrupted or submitted it again; and when ended jobs expired."""
    return machine.replay(job_events(V.table(spark, sf_dir, "events")), ttl=2 * DAY)


@query()
def job_transitions_stream(spark, sf_dir):
    """The same rows from a stream of the events, run until there is no more."""
    spark.conf.set(*machine.STORE)
    shape = V.table(spark, sf_dir, "events").schema
    events = job_events(spark.readStream.schema(shape).parquet(f"{sf_dir}/event[s].parquet"))  # a pattern may be one file, a plain path may not
    folder = new_folder(spark, "jobs")
    out = machine.transitions(events, ttl=2 * DAY).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(machine.ROWS).parquet(f"{folder}/rows")
