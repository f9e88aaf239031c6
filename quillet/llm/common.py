"""Helpers that the operators share: table access, stashing to the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_UNSET: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where the session names none, a temporary
    folder under a local master (tests) and the warehouse elsewhere."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and spark.sparkContext.master.startswith("local"):
        where = _UNSET.setdefault("dir", "") or _UNSET.update(dir=tempfile.mkdtemp(prefix="quillet-")) or _UNSET["dir"]
    return (where or f"{spark.conf.get('spark.sql.warehouse.dir')}/quillet").rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is cut, and a lost executor costs a reread.

    The table outlives the call because the returned frame is lazy; the folder belongs to the
    cluster's own expiry of spark.checkpoint.dir. `drop` removes one that is no longer read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*stashes: DataFrame) -> None:
    """Delete the files of stashes that nothing will read again."""
    for df in stashes:
        for name in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs as a table in the shared folder, its columns renamed c0, c1, ..., with a row id `rid`, and the number of its buckets.

    Rows stay where they were read: buckets are those of `part`, the number of the task that read a row, so writing the
    table moves nothing, and a table of (part, rid) dealt to the same buckets joins it without moving a text (see in_place).
    """
    spark = docs.sparkSession
    name, buckets = f"quillet_{uuid.uuid4().hex}", min(4 * docs.rdd.getNumPartitions() or 1, 65_536)
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("part", F.shiftright("rid", 33).cast("int"))
    out = rows.write.bucketBy(buckets, "part").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd")
    out.saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog alone: the files stay, and found knows them
    return found, buckets


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """While a plan is made inside, a join on (part, rid) may use the buckets of `part` as they lie; the session's own
    setting comes back afterwards. What is planned outside moves both sides, with the same result."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    """df(rid, ...) with its rid's part, dealt as a placed table is."""
    return df.withColumn("part", F.shiftright("rid", 33).cast("int")).repartition(buckets, "part").hint("shuffle_hash")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long) as (node, root), root the smallest node; nodes without edge are absent.

    Alternating large-star and small-star rounds: every step is a grouped minimum (combined before the
    shuffle), written as a table, and a join of two tables, whose skew AQE can split: a hub never has to fit one task. Tables
    of rounds that are over are deleted. Self-loops are ignored.
    """
    e = stash(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = stash(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        least = stash(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        small = (
            joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
            .unionByName(joined.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        last, e = e, stash(small)
        drop(last, low, large, least)
        now = e.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
    raise RuntimeError("connected components did not converge")
