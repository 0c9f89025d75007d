"""Balanced sampling: allocations over datasets, and draws that depend on seed and key alone.

Allocations run on tables of counts (a row a dataset), never on rows, so their windows hold few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import draw, drawn, matched, parted


def first_n(rows: DataFrame, by: list[str], n: Column | int, *order: Column | str, most: int | None = None) -> DataFrame:
    """The first ``n`` rows of each bucket; ``most`` bounds a column ``n``, so that each task passes on no more than that."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    top = rows.withColumn("_rn", rank).filter(F.col("_rn") <= (n if isinstance(n, int) else most))
    return (top if isinstance(n, int) else top.filter(F.col("_rn") <= n)).drop("_rn")


def class_counts(rows: DataFrame, by: str = "dataset", label: str = "label") -> DataFrame:
    """Rows by class and the pairs they allow."""
    c = rows.groupBy(by).agg(F.count_if(F.col(label) == 0).alias("class0"), F.count_if(F.col(label) == 1).alias("class1"))
    return c.withColumn("pair_cap", F.least("class0", "class1"))


def largest_remainder(caps: DataFrame, target: int, key: str = "dataset", cap: str = "pair_cap", run: list[str] | None = None) -> DataFrame:
    """``target`` shared in proportion to capacity: floors, then one more by largest remainder, ties by name."""
    run = run or []
    caps = caps.filter(F.col(cap) > 0)
    every = Window.partitionBy(*run) if run else Window.partitionBy(F.lit(1))
    whole = F.least(F.lit(target).cast("long"), F.sum(cap).over(every))
    raw = whole * F.col(cap) / F.sum(cap).over(every)
    caps = caps.withColumns({"_t": whole, "_raw": raw, "_low": F.floor(raw)})
    left = F.col("_t") - F.sum("_low").over(every)
    order = (Window.partitionBy(*run) if run else Window.partitionBy(F.lit(1))).orderBy((F.col("_raw") - F.col("_low")).desc(), key)
    caps = caps.withColumns({"_left": left, "_rank": F.row_number().over(order)})
    return caps.withColumn("n", (F.col("_low") + F.when((F.col("_rank") <= F.col("_left")) & (F.col("_low") < F.col(cap)), 1).otherwise(0)).cast("long")).drop("_t", "_raw", "_low", "_left", "_rank")


def with_floor(caps: DataFrame, target: int, floor: int = 3, key: str = "dataset", cap: str = "pair_cap") -> DataFrame:
    """``floor`` for every dataset that has as many, the rest by largest remainder; too small a target gives the floors."""
    caps = caps.filter(F.col(cap) >= floor)
    every = Window.partitionBy(F.lit(1))
    rest = F.least(F.lit(target).cast("long"), F.sum(cap).over(every)) - floor * F.count("*").over(every)
    spare = F.sum(F.col(cap) - floor).over(every)
    raw = F.when((rest > 0) & (spare > 0), rest * (F.col(cap) - floor) / spare).otherwise(0.0)
    caps = caps.withColumns({"_rest": F.greatest(rest, F.lit(0)), "_raw": raw, "_low": F.floor(raw)})
    left = F.when(F.col("_rest") > 0, F.col("_rest") - F.sum("_low").over(every)).otherwise(0)
    order = Window.partitionBy(F.lit(1)).orderBy((F.col("_raw") - F.col("_low")).desc(), key)
    caps = caps.withColumns({"_left": left, "_rank": F.row_number().over(order)})
    more = F.when((F.col("_rank") <= F.col("_left")) & (F.col("_low") + floor < F.col(cap)), 1).otherwise(0)
    return caps.withColumn("n", (F.col("_low") + floor + more).cast("long")).drop("_rest", "_raw", "_low", "_left", "_rank")


def sample_by_plan(rows: DataFrame, plan: DataFrame, seed: str | int, by: list[str], key: str, also: list[str] | None = None, most: int | None = None) -> DataFrame:
    """``n`` (of the plan) random rows of every bucket.

    ``most`` bounds ``n``: then each task passes on no more than that of a bucket, and the sample takes two scans and no
    job of its own. Without it a bucket's share may be of any size.
    """
    buckets = by + (also or [])
    if most is not None:
        told = matched(rows, plan.select(*by, F.col("n").alias("_plan")), by)
        return first_n(told.withColumn("_d", draw(seed, key)), buckets, F.col("_plan"), "_d", key, most=most).drop("_d", "_plan")
    planned = lambda counts: matched(counts, plan.select(*by, F.col("n").alias("in")), by)
    return parted(drawn(rows, seed, key), buckets, ["_d", key], planned, ["in"], "out").filter("part = 'in'").drop("_d", "part")


def equal_shares(sizes: DataFrame, by: str, target: int) -> DataFrame:
    """Equal shares of buckets of ``size`` rows, the rest one by one from the fullest: ``n`` for each; a table of buckets.

    Rows are taken in rounds, one of each bucket that has any left. Of buckets in the order of their sizes, the first
    that the level reached by sharing what is left does not empty tells the number of whole rounds.
    """
    every = Window.partitionBy(F.lit(1))
    up = every.orderBy("size", by)
    rank, below = F.row_number().over(up), F.sum("size").over(up) - F.col("size")
    level = F.floor((F.lit(target) - below) / (F.count("*").over(every) - rank + 1))
    leveled = sizes.withColumn("_level", level)
    rounds = F.min(F.when(F.col("_level") < F.col("size"), F.struct("size", by, "_level"))).over(every)
    leveled = leveled.withColumn("_rounds", F.greatest(F.coalesce(rounds["_level"], F.max("size").over(every)), F.lit(0)))
    spread = leveled.withColumns({"n": F.least("size", "_rounds"), "_room": F.col("size") - F.col("_rounds")})
    more = F.row_number().over(every.orderBy(F.desc("_room"), by))
    spread = spread.withColumns({"_more": more, "_left": F.lit(target) - F.sum("n").over(every)})
    return spread.withColumn("n", (F.col("n") + F.when((F.col("_room") > 0) & (F.col("_more") <= F.col("_left")), 1).otherwise(0)).cast("long")).drop("_level", "_rounds", "_room", "_more", "_left")


def equal_share(rows: DataFrame, by: str, target: int, order: str) -> DataFrame:
    """Equal shares of the buckets (``equal_shares``), of each the first rows by the number ``order``."""
    planned = lambda counts: equal_shares(counts.withColumnRenamed("n", "size"), by, target).select(by, F.col("n").alias("in"), F.col("size").alias("n"))
    return parted(rows, [by], [order], planned, ["in"], "out").filter("part = 'in'").drop("part")


def class_targets(counts: dict[int, int], targets: dict[int, int], total: int = 0) -> dict[int, int]:
    """Rows to take of class 1 and class 0: their targets, if they are there.

    With a ``total`` that both targets together exceed, class 1 gets no more than half of it and class 0 what is left.
    """
    one, zero = max(0, targets[1]), max(0, targets[0])
    if 0 < total < one + zero:
        one = min(one, total // 2)
        zero = min(zero, total - one)
    return {1: min(one, counts.get(1, 0)), 0: min(zero, counts.get(0, 0))}


def class_head(rows: DataFrame, targets: dict[int, int], order: str, total: int = 0, label: str = "label") -> DataFrame:
    """The first rows of both classes in order, as many as ``class_targets`` says."""
    counts = {r[0]: r[1] for r in rows.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    wanted = class_targets(counts, targets, total)
    return first_n(rows.filter(F.col(label).isin(0, 1)), [label], F.when(F.col(label) == 1, wanted[1]).otherwise(wanted[0]), F.col(order), most=max(1, *wanted.values()))


def class_quota(rows: DataFrame, quota: int, seed: str | int, key: str = "src_ord", neutral: str = "is_neutral") -> DataFrame:
    """Class 0 rows up to a quota, those that are not neutral first; a top-n, merged from the tops of the partitions."""
    return rows.orderBy(F.col(neutral).cast("int"), draw(seed, key), key).limit(quota)
