"""What several operators share: the word rule, stable word fingerprints, shared storage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: A word is a maximal run of anything but space and U+0009..U+000D; ``bytes.split()`` splits by the same set.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine, one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not spark.sparkContext.master.split("[")[0] == "local" and warehouse.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{warehouse}/_shared"
    return found


def stored(df: DataFrame, name: str, drop: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut of the lineage that outlives executors.

    Tables in ``drop``, themselves from ``stored``, are deleted once ``df`` is written: what no later step reads need
    not stay.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for old in drop:
        discard(old)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and that nothing reads any more."""
    spark = table.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not use, made from ``stems``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Base of the rolling polynomial.
FACTOR = 0x9E3779B97F4A7C15


def windows(words: np.ndarray, size: int, factor: int = FACTOR) -> np.ndarray:
    """Fingerprints of every ``size`` consecutive words, by a rolling polynomial modulo 2**64."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if size <= 8:
            total = np.zeros(n, np.uint64)
            for k in range(size):
                total = total * np.uint64(factor) + words[k : k + n]
            return mix(total)
        up = np.cumprod(np.full(len(words), factor, np.uint64))
        down = np.cumprod(np.full(n, pow(factor, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
        return mix((sums[size:] - sums[:n]) * down)


#: White space, and a 64-bit value for every byte.
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Fingerprints:
    """64-bit fingerprints of words, equal on every worker: a polynomial over the bytes of each, by one sum over the text."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        """The fingerprints of the words of a text (null: none), in order."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.zeros(0, np.uint8)
        inside = np.concatenate([[False], ~_BLANK[data], [False]])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        n = len(data)
        with np.errstate(over="ignore"):
            if n >= len(self.up):
                size = max(2 * n, 1 << 16)
                self.up = np.cumprod(np.full(size, FACTOR, np.uint64))
                self.down = np.cumprod(np.full(size, pow(FACTOR, -1, 1 << 64), np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.up[:n])])
            return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
