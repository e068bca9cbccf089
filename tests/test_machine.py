"""Jobs as state machines: hand-made events, and a stream that is stopped in its middle against the replay of all events."""

import random

import pytest

from gradus.plans import registry
from gradus.streaming import machine as M

EVENT = "job long, event_id long, ts long, event string"
TTL = 800


def run(events):
    state, out = (None, None, 0), []
    for i, (ts, e) in enumerate(events):
        state, rows = M.step(state, i, ts, e, TTL)
        out += [r[2:] for r in rows]
    return out


def test_steps():
    assert run([(0, "processing"), (1, "queued"), (2, "restart"), (3, "processing"), (4, "restart"), (5, "restart"), (6, "queued"), (7, "exporting"), (8, "succeeded"), (9, "queued")]) == [
        ("illegal", None, "processing", 0), ("moved", None, "queued", 0), ("resubmitted", "queued", "queued", 0), ("moved", "queued", "processing", 1), ("interrupted", "processing", "failed", 1),
        ("moved", "failed", "queued", 1), ("moved", "queued", "exporting", 2), ("moved", "exporting", "succeeded", 2), ("illegal", "succeeded", "queued", 2),
    ]
    assert run([(5, "queued"), (4, "processing"), (5, "cancel_requested"), (6, "succeeded"), (7, "cancelled"), (7 + TTL, "queued")])[1:] == [
        ("late", "queued", "processing", 0), ("moved", "queued", "cancel_requested", 0), ("illegal", "cancel_requested", "succeeded", 0), ("moved", "cancel_requested", "cancelled", 0), ("expired", "cancelled", "expired", 0), ("moved", None, "queued", 0),
    ]
    assert all(not M.ALLOWED.get(s) for s in M.TERMINAL)


def test_a_stream_that_is_stopped_equals_the_replay(spark, tmp_path):
    spark.conf.set(*M.STORE)
    rng = random.Random(1)
    kinds = [*M.STATUSES[:9], "queued", "processing", "exporting", "succeeded", M.RESTART]
    rows = [(rng.randrange(20), i, i * 10_000_000 + rng.randrange(1000), rng.choice(kinds)) for i in range(500)]
    events, d = spark.createDataFrame(rows, EVENT), f"file://{tmp_path}"
    for part in ("event_id < 200", "event_id >= 200"):
        events.where(part).coalesce(1).write.mode("append").parquet(f"{d}/in")
        stream = M.transitions(spark.readStream.schema(EVENT).parquet(f"{d}/in"), ttl=800_000_000)
        stream.writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{d}/out").collect()), key=str)
    assert got == sorted(map(tuple, M.replay(events, 800_000_000).collect()), key=str)
    assert {r[3] for r in got} == {"moved", "illegal", "interrupted", "resubmitted", "expired"}
    assert M.replay(events.limit(0), TTL).count() == 0


@pytest.mark.parametrize("sf", ["0.001"])
def test_queries(spark, sf):
    a, b = (sorted(map(tuple, registry.QUERIES[n](spark, f"/root/testdata/sf{sf}").collect()), key=str) for n in ("job_transitions", "job_transitions_stream"))
    assert a == b and len(a) > 500
