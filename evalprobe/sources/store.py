"""The activation store: vectors by mode and feature (folders) and signature (buckets), so that lookups do not move them.

A store is written as a bucketed table at a path. Its settings stand beside it, so that any session can open it; a join
on ``sig`` then shuffles the wanted keys into the store's buckets and reads the vectors where they lie. Two stores with
as many buckets, and keys that have been dealt out once, meet without a further shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BY = ("mode", "feature")


def _name(path: str) -> str:
    return f"store_{hashlib.md5(path.encode()).hexdigest()}"


def write_store(vectors: DataFrame, path: str, buckets: int | None = None) -> None:
    """One vector a (mode, feature, signature), from ``vectors`` with these and further columns; one shuffle.

    ``buckets`` defaults to the session's number of shuffle partitions.
    """
    spark = vectors.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = [c for c in vectors.columns if c not in BY]
    # dealt out by signature alone: that is the order of the buckets, and good for dropping repeats too
    rows = vectors.select(*first, *BY).repartition(buckets, "sig").dropDuplicates([*BY, "sig"]).sortWithinPartitions(*BY, "sig")
    rows.write.mode("overwrite").partitionBy(*BY).bucketBy(buckets, "sig").sortBy("sig").option("path", path).saveAsTable(_name(path))
    columns = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(columns).alias("columns")).write.mode("overwrite").parquet(f"{path}_settings")


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The store at ``path``, also where another session wrote it."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        buckets, columns = spark.read.parquet(f"{path}_settings").first()
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({', '.join(BY)}) CLUSTERED BY (sig) SORTED BY (sig) INTO {buckets} BUCKETS LOCATION '{path}'")
        spark.catalog.recoverPartitions(name)
    return spark.table(name)


def read_store(spark: SparkSession, path: str, mode: str, features: list[str], keys: DataFrame) -> DataFrame:
    """Vectors of the requested features and signatures; folders of other modes and features are not read, vectors not moved."""
    wanted = open_store(spark, path).filter((F.col("mode") == mode) & F.col("feature").isin(*features))
    return wanted.join(keys.select("sig").distinct(), "sig", "left_semi")
