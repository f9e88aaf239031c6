"""Job state from event streams: status, tails, admission, cancellation. Each works on a batch frame as well."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")  # fixed values


def status(events: DataFrame, key: str = "job_id", order: str = "offset", columns: tuple[str, ...] = ("state", "stage", "percent", "message")) -> DataFrame:
    """The latest event of each job: a grouped maximum, so its state is one row for each job."""
    last = F.max_by(F.struct(order, *columns), order)
    return events.groupBy(key).agg(last.alias("s"), F.count(F.lit(1)).alias("n_events")).select(key, "s.*", "n_events")


def merged_status(events: DataFrame, columns: tuple[str, ...], key: str = "job_id", order: str = "offset") -> DataFrame:
    """Each column's latest value that is not null: the fold of partial updates."""
    return events.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def tail(events: DataFrame, after: int, order: str = "offset") -> DataFrame:
    return events.where(F.col(order) >= after)


def log_tail(log: Column, most: int = 20_000) -> Column:
    """The last characters of a log."""
    return F.right(log, F.lit(most))


def admitted(requests: DataFrame, running: DataFrame, bound: int, key: str = "job_id", at: str = "time") -> DataFrame:
    """Requests that a bounded queue takes, oldest first, each job once and none that runs; `admitted` says whether it fits."""
    from pyspark.sql.window import Window

    first = requests.groupBy(key).agg(F.min_by(F.struct(*requests.columns), at).alias("r")).select("r.*")
    waiting = first.join(running.select(key), key, "left_anti")
    # a queue is bounded by what it admits: one window over the oldest `bound` requests and a count
    oldest = waiting.orderBy(at, key).limit(bound).select(key).withColumn("admitted", F.lit(True))
    return waiting.join(oldest, key, "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def once(requests: DataFrame, key: str = "job_id", at: str = "time", within: str = "1 hour") -> DataFrame:
    """A stream's requests without repeats of a key inside the watermark."""
    return requests.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def not_cancelled(requests: DataFrame, cancelled: DataFrame, key: str = "job_id") -> DataFrame:
    return requests.join(cancelled.select(key), key, "left_anti")


def progress(batches: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """Rows done so far and in all, after each batch."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys)
    return batches.withColumn("done", F.sum(size).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum(size).over(w))


def _pointer(spark, path: str):
    """The file that says which version of each bucket counts, and what it says."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/current.json")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return {}
    return json.loads("".join(r.value for r in spark.read.text(str(where.toString())).collect()))  # one line


def _point(spark, path: str, versions: dict[str, str]) -> None:
    """Puts a new pointer in the place of the old one, in one step."""
    jvm, name = spark._jvm, f"{path}/_next-{uuid.uuid4().hex}"
    where = jvm.org.apache.hadoop.fs.Path(name)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(json.dumps(versions).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(where, jvm.org.apache.hadoop.fs.Path(f"{path}/current.json"), options)


def status_table(spark, path: str) -> DataFrame | None:
    """The table that `follow` keeps, or none before its first rows."""
    pointer = _pointer(spark, path)
    if not pointer:
        return None
    versions = sorted(set(pointer.values()))
    rows = spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/version={v}" for v in versions))
    live = F.concat_ws("@", F.col("bucket").cast("string"), F.col("version").cast("string")).isin(*(f"{b}@{v}" for b, v in pointer.items()))
    return rows.where(live).drop("version")


def follow(events: DataFrame, checkpoint: str, path: str, available_now: bool = True, key: str = "job_id", order: str = "offset", buckets: int = 64):
    """Keep the status table of a stream of events, one row for each job, in `buckets` folders by a hash of the job.

    A micro-batch reads the folders of the jobs that it touches, takes the latest row of each job and writes those folders as a
    new version; a pointer is then moved to it in one step, and versions that no bucket points to are deleted. So a crash at
    any place leaves the old table or the new one, and a repeated micro-batch changes nothing. Read it with status_table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        before = _pointer(spark, path)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # `buckets` at most
        if not touched:
            return
        old = status_table(spark, path)
        if old is not None:
            new = old.where(F.col("bucket").isin(touched)).select(*new.columns).unionByName(new)
        last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
        version = f"v{number:012d}-{uuid.uuid4().hex[:8]}"  # no number, whatever its digits
        last.write.partitionBy("bucket").parquet(f"{path}/data/version={version}")
        after = {**before, **{str(b): version for b in touched}}
        _point(spark, path, after)
        for gone in set(before.values()) - set(after.values()):
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/version={gone}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    writer = status(events, key, order).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def tail_until(events: DataFrame, job: str, emit, checkpoint: str, deadline: float = 60.0, poll: float = 1.0, key: str = "job_id", order: str = "offset") -> str:
    """Hand the events of one job to `emit`, in order, as they come, until one is of a terminal state or the time is over.

    Returns that state, or an empty string. A later call with the same checkpoint goes on behind the last event handed out.
    """
    import time

    ended: list[str] = []

    def batch(rows: DataFrame, number: int) -> None:
        for r in rows.orderBy(order).toLocalIterator():  # the events of one job
            if not ended:
                emit(r)
                ended.extend([r["state"]] if r["state"] in TERMINAL else [])

    query = events.where(F.col(key) == job).writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(processingTime=f"{poll} seconds").start()
    until = time.monotonic() + deadline
    try:
        while not ended and time.monotonic() < until and not query.awaitTermination(min(poll, 0.5)):
            pass
    finally:
        query.stop()
    return ended[0] if ended else ""
