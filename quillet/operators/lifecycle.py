"""Orders and jobs as folds over their events: a table of transitions, and what it refuses.

An event is a function from states to states, and so is any run of events: the states after it by those before it. Runs are
composed in two levels, by key and slice of time and then by key, so the events of a busy key are folded in many tasks; however
they are split, the end is the same. The same table drives the stream (streaming/queue.py).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# By state, the state that each event leads to; all others are refused. The empty state is that of what is not there yet.
ORDER = {
    "": {"create": "pending_payment"}, "pending_payment": {"pay": "paid", "cancel": "cancelled", "expire": "expired"},
    "paid": {"enqueue": "queued", "refund": "refunded"}, "queued": {"start": "running", "cancel": "cancelled"},
    "running": {"finish": "completed", "fail": "failed", "cancel": "cancelled", "requeue": "queued"}, "failed": {"enqueue": "queued", "refund": "refunded"},
}
JOB = {
    "": {"enqueue": "queued"}, "queued": {"start": "running", "cancel": "cancelled"},
    "running": {"beat": "running", "finish": "completed", "fail": "failed", "cancel": "cancelled", "lapse": "queued"},
}


class Machine:
    """A table of transitions as numbers: states in the order in which they are met, the empty one first."""

    def __init__(self, table: Mapping[str, Mapping[str, str]]) -> None:
        self.states = list(dict.fromkeys(["", *table, *(s for to in table.values() for s in to.values())]))
        self.events = list(dict.fromkeys(e for to in table.values() for e in to))
        self.next = [self.states.index(table[s][e]) if e in table.get(s, {}) else -1 for s in self.states for e in self.events]
        self.table = table

    def step(self, state: str, event: str) -> str | None:
        """Where an event leads; none if it is refused."""
        return self.table.get(state, {}).get(event)


def _runs(machine: Machine, events: Column) -> Column:
    """array<struct<to, refused>> by the state before: what a run of events in order comes to. events: array<struct<.., event>>."""
    table, count = F.array(*(F.lit(x) for x in machine.next)), len(machine.events)
    number = F.create_map(*(x for i, e in enumerate(machine.events) for x in (F.lit(e), F.lit(i))))
    zero = F.array(*(F.struct(F.lit(i).alias("to"), F.lit(0).cast("long").alias("refused")) for i in range(len(machine.states))))

    def step(acc: Column, x: Column) -> Column:
        def one(s: Column) -> Column:
            to = F.coalesce(F.get(table, s["to"] * count + F.try_element_at(number, x["event"])), F.lit(-1))  # an unknown event is refused
            return F.struct(F.when(to >= 0, to).otherwise(s["to"]).alias("to"), (s["refused"] + (to < 0).cast("long")).alias("refused"))

        return F.transform(acc, one)

    return F.aggregate(events, zero, step)


def states(events: DataFrame, keys: list[str], order: list[str], table: Mapping[str, Mapping[str, str]] = ORDER, at: Column | None = None) -> DataFrame:
    """(keys..., state, refused) after events(keys, order, event): the state of each key and how many of its events were
    refused, which change nothing. `at` is the slice of time of an event, the first of its order; a null event is refused."""
    machine = Machine(table)
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.coalesce("event", F.lit("?")).alias("event"))))
    slices = events.withColumn("_at", F.lit(0) if at is None else at).groupBy(*keys, "_at").agg(_runs(machine, ordered).alias("run"))
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("refused"))

    def then(acc: Column, x: Column) -> Column:
        r = F.get(x["run"], acc["to"])
        return F.struct(r["to"].alias("to"), (acc["refused"] + r["refused"]).alias("refused"))

    whole = slices.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_at", "run"))), zero, then).alias("end"))
    return whole.select(*keys, F.get(F.array(*map(F.lit, machine.states)), F.col("end.to")).alias("state"), F.col("end.refused").alias("refused"))
