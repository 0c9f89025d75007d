"""Tables written to the folder that driver and executors share: they cut lineage, outlive executors and have a known size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder below the warehouse, which on a cluster must not be a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if spark.sparkContext.master.split("[")[0] != "local" and warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{warehouse}/_shared"
    return found


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(table: DataFrame, name: str) -> DataFrame:
    """``table``, written once and read back; the planner knows its size from the files."""
    path = folder(table.sparkSession, name)
    table.write.option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a ``folder`` that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
