"""Jobs as state machines over an event stream: allowed transitions, restarts of the server, expiry; the same over a table of events.

Events are rows of job, event_id, ts (microseconds) and event: a status that the job takes, or RESTART, which the server writes for each of its jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The statuses of a job, and those at which it ends.
STATUSES = ("queued", "validating", "processing", "standardizing", "exporting", "succeeded", "failed", "cancel_requested", "cancelled", "expired")
TERMINAL = frozenset(("succeeded", "failed", "cancelled", "expired"))
RESTART = "restart"

_WORK = ("validating", "processing", "standardizing", "exporting")
#: What may follow a status: a job passes on through its work, may skip steps of it, and can fail or be cancelled until it ends.
ALLOWED = {None: {"queued"}, "queued": {*_WORK, "failed", "cancel_requested"}, "cancel_requested": {"cancelled", "failed"}} | {
    s: {*_WORK[i + 1 :], "failed", "cancel_requested"} | ({"succeeded"} if s == "exporting" else set()) for i, s in enumerate(_WORK)
}

ROWS = "job long, event_id long, ts long, kind string, was string, now string, attempt int"
STATE = "status string, since long, attempt int"


def step(state: tuple, event_id: int, ts: int, event: str, ttl: int) -> tuple[tuple, list[tuple]]:
    """(status, since, attempt) and an event: the next state, and rows of (event_id, ts, kind, was, now, attempt).

    A job that ended `ttl` ago is expired first, at its time. A restart fails a job at work, which may be tried again, and submits a queued
    one again; others stay as they are. An event before the job's state began is late and, like a transition that isn't allowed, changes nothing.
    """
    status, since, attempt = state
    rows = []
    if status in TERMINAL and ts >= since + ttl:
        rows.append((None, since + ttl, "expired", status, "expired", attempt))
        status, since, attempt = None, None, 0
    if since is not None and ts < since:
        return (status, since, attempt), [*rows, (event_id, ts, "late", status, event, attempt)]
    if event == RESTART:
        if status == "queued":
            rows.append((event_id, ts, "resubmitted", status, status, attempt))
        elif status is not None and status not in TERMINAL:
            rows.append((event_id, ts, "interrupted", status, "failed", attempt))
            status, since = "failed", ts
    elif event in ALLOWED.get(status, ()) or status == "failed" and event == "queued":
        attempt += status == "queued" and event in _WORK
        rows.append((event_id, ts, "moved", status, event, attempt))
        status, since = event, ts
    else:
        rows.append((event_id, ts, "illegal", status, event, attempt))
    return (status, since, attempt), rows


class Machine(StatefulProcessor):
    """A job's state between batches; a timer of event time expires a job that ended, if no event does it before."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = tuple(self.held.get()) if self.held.exists() else (None, None, 0)
        for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
            state, out = step(state, r.event_id, r.at, r.event, self.ttl)
            for row in out:
                yield Row(job=key[0], **dict(zip(("event_id", "ts", "kind", "was", "now", "attempt"), row)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state[0] is None:
            self.held.clear()
            return
        self.held.update(state)
        if state[0] in TERMINAL:
            self.handle.registerTimer((state[1] + self.ttl) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            status, since, attempt = self.held.get()
            if status in TERMINAL:
                yield Row(job=key[0], event_id=None, ts=since + self.ttl, kind="expired", was=status, now="expired", attempt=attempt)
                self.held.clear()

    def close(self) -> None:
        pass


STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def transitions(events: DataFrame, ttl: int, late: str = "1 minute") -> DataFrame:
    """Rows of a stream of events, in append mode. Needs a state store with timers (RocksDB). Events of a batch are taken by ts, then event_id."""
    at = events.withColumn("at", F.col("ts")).withColumn("ts", F.timestamp_micros("ts")).withWatermark("ts", late)
    return at.groupBy("job").transformWithState(Machine(ttl), outputStructType=ROWS, outputMode="append", timeMode="EventTime")


def replay(events: DataFrame, ttl: int, late: int = 60_000_000) -> DataFrame:
    """The same rows of a table of events: each task runs through its jobs in the order of time, so a job of any length is one pass.

    Jobs that ended expire as far as the stream's last watermark, the last event's ts less `late`, reaches.
    """
    mark = (events.agg(F.max("ts")).first()[0] or 0) - late
    held = events.select("job", "event_id", "ts", "event").repartition("job").sortWithinPartitions("job", "ts", "event_id")

    def run(batches):
        job, state, none = None, (None, None, 0), True

        def ended():
            if not none and state[0] in TERMINAL and state[1] + ttl < mark:
                yield (job, None, state[1] + ttl, "expired", state[0], "expired", state[2])

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if none or r.job != job:
                    out += ended()
                    job, state, none = r.job, (None, None, 0), False
                state, rows = step(state, int(r.event_id), int(r.ts), r.event, ttl)
                out += [(job, *row) for row in rows]
            yield frame(out)
        yield frame(list(ended()))

    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=["job", "event_id", "ts", "kind", "was", "now", "attempt"])
        return f.astype({"event_id": "Int64"})

    return held.mapInPandas(run, ROWS)
