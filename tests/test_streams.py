"""Logs that grow, orders and jobs as folds over events, and the queue with leases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillet.operators import lifecycle
from quillet.sources import events
from quillet.streaming import jobs, queue


def test_lines_in_any_ranges(tmp_path):
    """However a file is cut, each whole line is read once, from where it begins."""
    rng = random.Random(3)
    for k in range(40):
        data = b"".join(rng.choice((b"", b"a", b"\xc3\xa9" * 9, b"x" * 40, b"\r")) + rng.choice((b"\n", b"\n", b"")) for _ in range(30))
        (tmp_path / f"{k}.log").write_bytes(data)
        whole = data[: data.rfind(b"\n") + 1]
        want, at = [], 0
        for line in whole.split(b"\n")[:-1]:
            want.append((f"{k}.log", at, line.removesuffix(b"\r").decode("utf-8", "replace")))
            at += len(line) + 1
        for split in (1, 3, 7, 1000):
            r = events._Lines({"path": str(tmp_path), "pattern": f"{k}.log", "split": split})
            assert [x for p in r.ranges({}, r.sizes()) for x in r.read(p)] == want
            end = [(f"{k}.log", at, data[at:].decode("utf-8", "replace"))] if data[at:] else []
            assert [x for p in r.partitions() for x in r.read(p)] == want + end


def test_a_log_that_grows(spark, tmp_path):
    log, other = tmp_path / "in" / "j1.ndjson", tmp_path / "in" / "j2.ndjson"
    log.parent.mkdir()
    rows = events.stream(spark, str(log.parent), most_bytes=64)

    def run():
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        got = spark.read.schema(rows.schema).parquet(str(tmp_path / "out")).orderBy("job_id", "offset").collect()
        return [(r.job_id, r.offset, r.current) for r in got]

    line = '{"state":"running","current":%d}'
    log.write_text(line % 1 + "\n" + (line % 2)[:10])
    for _ in range(3):
        first = run()
    assert first == [("j1", 0, 1)]
    with log.open("a") as f:
        f.write((line % 2)[10:] + "\n\nbroken\n" + line % 3 + "\n")
    other.write_text(line % 9 + "\n")
    for _ in range(6):
        second = run()
    n = len(line % 1) + 1
    assert second == [("j1", 0, 1), ("j1", n, 2), ("j1", 2 * n + 8, 3), ("j2", 0, 9)]
    assert run() == second


def test_a_tail_that_ends(spark, tmp_path):
    log = tmp_path / "in" / "j.ndjson"
    log.parent.mkdir()
    log.write_text('{"state":"queued"}\n{"state":"running"}\n')
    seen = []

    def emit(row):
        seen.append((row.offset, row.state))
        if len(seen) == 2:  # the job goes on while it is watched
            with log.open("a") as f:
                f.write('{"state":"completed"}\n{"state":"late"}\n')

    stream = lambda: events.stream(spark, str(log.parent))
    assert jobs.tail_until(stream(), "none", emit, str(tmp_path / "cp0"), deadline=3, poll=0.2) == "" and not seen
    assert jobs.tail_until(stream(), "j", emit, str(tmp_path / "cp"), deadline=90, poll=0.2) == "completed"
    assert [s for _, s in seen] == ["queued", "running", "completed"]


def test_lifecycle_is_the_same_however_it_is_split(spark):
    rng = random.Random(4)
    ops = [*{e for to in lifecycle.ORDER.values() for e in to}, "unknown", None]
    likely = ["create", "pay", "enqueue", "start", "fail", "enqueue", "start", "finish"]
    rows, want = [], {}
    for key in range(60):
        state, refused = "", 0
        for at in range(rng.randrange(1, 40)):
            op = likely[at] if at < len(likely) and rng.random() < 0.8 else rng.choice(ops)
            rows.append((key, at, op))
            to = lifecycle.ORDER.get(state, {}).get(op)
            state, refused = (to, refused) if to else (state, refused + 1)
        want[key] = (state, refused)
    df = spark.createDataFrame(rows, "key int, at int, event string").repartition(5)
    for size in (None, 1, 3, 1000):
        at = None if size is None else F.floor(F.col("at") / size)
        got = {r.key: (r.state, r.refused) for r in lifecycle.states(df, ["key"], ["at"], lifecycle.ORDER, at).collect()}
        assert got == want
    assert len({s for s, _ in want.values()}) > 5 and lifecycle.states(df.limit(0), ["key"], ["at"]).count() == 0


def simulate(log, lease):
    """Jobs one by one: what happens to each, the lease looked at before every event and at the end of all."""
    out = {}
    for job in {j for j, *_ in log}:
        state, attempt, until, acts = "", 0, None, []
        for _, time, event, own in sorted((x for x in log if x[0] == job), key=lambda x: (x[1], x[2])):
            if until is not None and time >= until:
                state, attempt, until = "queued", attempt + 1, None
                acts.append(("requeued", attempt))
            to = None if own is not None and event != "enqueue" and own != attempt else lifecycle.JOB.get(state, {}).get(event)
            if to is None:
                continue
            attempt += event == "enqueue"
            state, until = to, time + lease if to == "running" else None
            if event != "beat":
                acts.append((to, attempt))
        if until is not None:
            acts.append(("requeued", attempt + 1))
        out[job] = acts
    return out


@pytest.mark.parametrize("seed", [1])
def test_queue_over_restarts(spark, tmp_path, seed):
    """Jobs, reports and repeats in files that come one after another; the stream is started anew for each. Nothing is lost
    or run twice: the actions are those of a plain simulation."""
    rng = random.Random(seed)
    t0, lease = datetime(2024, 1, 1), timedelta(seconds=60)
    log = []
    for j in range(12):
        at = t0 + timedelta(seconds=rng.randrange(30))
        log.append((f"j{j}", at, "enqueue", None))
        for k in range(rng.randrange(1, 9)):
            at += timedelta(seconds=rng.choice((5, 20, 50, 70, 130)))
            log.append((f"j{j}", at, rng.choice(("start", "start", "beat", "beat", "finish", "fail", "cancel", "enqueue")), rng.choice((None, None, 1, 2))))
    log += [x for x in log if rng.random() < 0.2 and x[2] in ("enqueue", "finish")]  # repeats
    log.append(("end", t0 + timedelta(hours=2), "enqueue", None))  # takes the watermark beyond all leases
    log.sort(key=lambda x: x[1])
    queue.session(spark)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("job_id string, time timestamp, event string, attempt int").parquet(str(tmp_path / "in"))
    for i in range(4):
        part = log[len(log) * i // 4 : len(log) * (i + 1) // 4]
        spark.createDataFrame(part, "job_id string, time timestamp, event string, attempt int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = queue.actions(source, 60, "0 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(180)
    done = spark.read.schema(queue.ACTIONS).parquet(str(tmp_path / "out"))
    got = {}
    for r in done.orderBy("attempt", F.expr("CASE WHEN state = 'queued' THEN 0 WHEN state = 'running' THEN 1 ELSE 2 END"), "time").collect():
        if not r.action.startswith("refused"):
            got.setdefault(r.job_id, []).append((r.action, r.attempt))
    want = simulate(log, lease)
    assert {j: sorted(a) for j, a in got.items()} == {j: sorted(a) for j, a in want.items()}
    assert any(a == "requeued" for acts in got.values() for a, _ in acts)
    last = {r.job_id: (r.state, r.attempt) for r in queue.waiting(done).collect()}
    state = lambda a: "queued" if a == "requeued" else a
    assert last == {j: (state(a[-1][0]), a[-1][1]) for j, a in want.items()}
    assert {r.action for r in done.where("action LIKE 'refused%'").collect()}


def test_what_workers_may_take(spark):
    rows = [("a", "queued", 1, 3), ("b", "queued", 1, 1), ("c", "queued", 2, 2), ("d", "running", 1, 0), ("e", "completed", 1, 0), ("f", "queued", 1, 9)]
    got = {r.job_id: (r.run, r.refuse) for r in queue.taken(spark.createDataFrame(rows, "job_id string, state string, attempt int, since int"), 2, 2).collect()}
    assert got == {"b": (True, False), "c": (False, False), "a": (False, False), "f": (False, True)}
