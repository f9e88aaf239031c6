"""Tables in the folder that driver and executors share: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_UNSET: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where the session names none, a temporary folder
    under a local master (tests) and the warehouse elsewhere."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and spark.sparkContext.master.startswith("local"):
        if "dir" not in _UNSET:
            _UNSET["dir"] = tempfile.mkdtemp(prefix="quillet-")
        where = _UNSET["dir"]
    return (where or f"{spark.conf.get('spark.sql.warehouse.dir')}/quillet").rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` that nothing will read again."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
