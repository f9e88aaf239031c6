"""A store of finished translations: appended to batch by batch, read back as the latest row of each paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_idx {}, id int, translation string, saved long"


def save(done: DataFrame, path: str, run: int = 0, kind: str = "int") -> None:
    """Append done(doc_idx, id, translation); of rows saved for one paragraph that of the highest run counts. kind: the type of doc_idx."""
    rows = done.select(F.col("doc_idx").cast(kind), F.col("id").cast("int"), "translation", F.lit(run).cast("long").alias("saved"))
    rows.write.mode("append").parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def load(spark: SparkSession, path: str, kind: str = "int") -> DataFrame:
    """(doc_idx, id, translation) of all that is saved; nothing where no store is."""
    where, files = _at(spark, path)
    if not files.exists(where):
        return spark.createDataFrame([], SCHEMA.format(kind)).drop("saved")
    rows = spark.read.schema(SCHEMA.format(kind)).parquet(path)
    return rows.groupBy("doc_idx", "id").agg(F.max_by("translation", F.struct("saved", "translation")).alias("translation"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete the store, if there is one."""
    where, files = _at(spark, path)
    files.delete(where, True)
