"""A queue of jobs as keyed state: what waits, what runs under a lease, what was given back, as a stream of actions.

Requests and reports of workers come as events of jobs; each job is a key with its state, its attempt and its lease. A worker
that starts or reports holds the job for `lease`; when the watermark passes the end of a lease without a report the job goes back
to the queue, with its next attempt. An event that the table of transitions does not know from a job's state is refused. A
repeated event changes nothing but a row of its refusal, so nothing is run twice however often it is sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import JOB, Machine

ACTIONS = "job_id string, time timestamp, action string, state string, attempt int"
_STATE = "state string, attempt int, until long"


class _Jobs(StatefulProcessor):
    def __init__(self, lease_ms: int) -> None:
        self.lease, self.machine = lease_ms, Machine(JOB)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", _STATE)

    def _now(self) -> tuple[str, int, int]:
        return self.job.get() if self.job.exists() else ("", 0, 0)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["time", "event"], kind="stable")
        state, attempt, until = self._now()
        before, out = until, []
        for time, event, own in zip(events["time"], events["event"], events["attempt"], strict=True):
            ms = int(time.timestamp() * 1000)
            if until and ms >= until:  # the lease had ended by then, whether or not its timer came first
                state, attempt, until = "queued", attempt + 1, 0
                out.append((time, "requeued", state, attempt))
            stale = not pd.isna(own) and event != "enqueue" and int(own) != attempt
            to = None if stale else self.machine.step(state, event)
            if to is None:
                out.append((time, f"refused {event}", state, attempt))
                continue
            attempt += event == "enqueue"
            state, until = to, ms + self.lease if to == "running" else 0
            if event != "beat":
                out.append((time, state, state, attempt))
        if until != before:
            if before:
                self.handle.deleteTimer(before)
            if until:
                self.handle.registerTimer(until)
        self.job.update((state, attempt, until))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, attempt, until = self._now()
        out = []
        if until and expiredTimerInfo.getExpiryTimeInMs() >= until:
            self.job.update(("queued", attempt + 1, 0))
            out = [(pd.Timestamp(until, unit="ms"), "requeued", "queued", attempt + 1)]
        yield self._rows(key, out)

    def _rows(self, key: Any, out: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["time", "action", "state", "attempt"])
        found.insert(0, "job_id", key[0])
        return found.astype({"job_id": "object", "time": "datetime64[ns]", "action": "object", "state": "object", "attempt": "int32"})

    def close(self) -> None:
        pass


def actions(events: DataFrame, lease: float = 60.0, late: str = "10 seconds") -> DataFrame:
    """The stream of actions on a stream of events(job_id, time, event, attempt): enqueue, start, beat, finish, fail, cancel.

    A report names the attempt that it is of, so one that comes after its lease is refused; null is any. Needs the RocksDB
    state store (see session).
    """
    rows = events.select("job_id", "time", "event", F.col("attempt").cast("int")).withWatermark("time", late).groupBy("job_id")
    return rows.transformWithStateInPandas(_Jobs(int(lease * 1000)), ACTIONS, outputMode="Append", timeMode="EventTime")


def session(spark) -> None:
    """The state store that keeps timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def waiting(actions_: DataFrame) -> DataFrame:
    """(job_id, state, attempt, since) of jobs by their last action that was not refused: what is in the queue, runs or is over."""
    done = actions_.where(~F.col("action").startswith("refused"))
    # the order of actions is that of attempts, then of states within one
    rank = F.struct("attempt", F.when(F.col("state") == "queued", 0).when(F.col("state") == "running", 1).otherwise(2), "time")
    return done.groupBy("job_id").agg(F.max_by(F.struct("state", "attempt", F.col("time").alias("since")), rank).alias("s")).select("job_id", "s.*")


def taken(queue: DataFrame, running: int, pending: int) -> DataFrame:
    """(job_id, run, refuse): of queued jobs, the oldest that free workers may take, and those beyond what may wait.

    Bounded by what a queue may hold: two limits over an order, and no window over all.
    """
    busy = queue.where("state = 'running'").count()
    waits = queue.where("state = 'queued'")
    first = waits.orderBy("since", "job_id").limit(max(0, running - busy)).select("job_id", F.lit(True).alias("run"))
    kept = waits.orderBy("since", "job_id").limit(max(0, running - busy) + pending).select("job_id", F.lit(True).alias("kept"))
    rows = waits.select("job_id").join(first, "job_id", "left").join(kept, "job_id", "left")
    return rows.select("job_id", F.coalesce("run", F.lit(False)).alias("run"), F.col("kept").isNull().alias("refuse"))
