"""Seeded splits of samples, pairs and groups into train, validation and test parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import draw, drawn, matched, parted, small


def part_sizes(n: Column, validation: float, test: float, shrink_test_first: bool) -> tuple[Column, Column]:
    """Validation and test sizes of a bucket of ``n`` (3 or more): at least one each, and one row left for training.

    Rounding is half to even. Only a bucket of 3 can be short, and then both parts are 1.
    """
    v, t = (F.greatest(F.lit(1), F.bround(n * f).cast("int")) for f in (validation, test))
    over = F.greatest(F.lit(0), v + t - (n - 1)).cast("int")
    if shrink_test_first:
        cut_t = F.least(over, t - 1)
        return v - (over - cut_t), t - cut_t
    cut_v = F.least(over, v - 1)
    return v - cut_v, t - (over - cut_v)


def three_way(rows: DataFrame, by: list[str], key: str, seed: str | int | Column, validation: float = 0.1, test: float = 0.2, shrink_test_first: bool = True, group: list[str] | None = None) -> DataFrame:
    """``rows`` with ``part``: within each bucket of ``by``; buckets under 3 rows drop out, as no part of them could be empty."""
    buckets = by + (group or [])
    own = drawn(rows, seed, key)
    v, t = part_sizes(F.col("n"), validation, test, shrink_test_first)
    return parted(own, buckets, ["_d", key], lambda counts: counts.filter("n >= 3").withColumns({"test": t, "val": v}), ["test", "val"], "train").drop("_d")


def test_size(n: Column, test: float) -> Column:
    """Test rows of a bucket of ``n``: half-even rounding, at least one, and of two or more one left for training."""
    size = F.greatest(F.lit(1), F.bround(n * test))
    return F.when(size >= n, F.greatest(F.lit(1), n - 1)).otherwise(size)


def by_class(rows: DataFrame, key: str, seed: str | int | Column, test: float = 0.2, label: str = "label", group: list[str] | None = None) -> DataFrame:
    """``rows`` with ``part`` train or test, within each class: half-even rounding, at least one test row and, of two or more, one training row."""
    buckets = [label] + (group or [])
    own = drawn(rows, seed, key)
    return parted(own, buckets, ["_d", key], lambda counts: counts.withColumn("test", test_size(F.col("n"), test)), ["test"], "train").drop("_d")


def few_by_class(rows: DataFrame, key: str, seeds: tuple[int, ...], most: int, test: float = 0.2, by: list[str] | None = None) -> DataFrame:
    """The splits of ``by_class`` for many seeds at once, over a sample of no more than ``most`` rows a bucket: ``tested``, the seeds for which a row is a test row.

    A bucket that holds more rows raises. One window a seed over the same buckets, so rows are shuffled once.
    """
    buckets = Window.partitionBy(*(by or []))
    n = F.count("*").over(buckets)
    n = F.when(n > most, F.raise_error(F.concat(F.lit(f"a bucket holds more than {most} rows: "), n))).otherwise(n)
    sized = rows.withColumn("_size", test_size(n, test))
    ranks = {f"_r{s}": F.row_number().over(buckets.orderBy(draw(s, key), key)) for s in seeds}
    return sized.withColumns(ranks).withColumn("tested", F.filter(F.array(*(F.when(F.col(f"_r{s}") <= F.col("_size"), s) for s in seeds)), lambda s: s.isNotNull())).drop("_size", *ranks)


def by_group(rows: DataFrame, group: str, seed: str | int, test: float = 0.2) -> DataFrame:
    """Whole groups go to test: the split is drawn on a table of groups."""
    groups = drawn(rows.select(group).distinct(), seed, group)
    sizes = lambda counts: counts.withColumn("test", F.greatest(F.lit(1), F.bround(F.col("n") * test)))
    return matched(rows, small(parted(groups, [], ["_d", group], sizes, ["test"], "train").select(group, "part")), [group])


def pair_validation(pairs: DataFrame, key: str, seed: str | int, fixed: int | None = None, per: str | None = None, count: int | None = None, fraction: float | None = None, benchmarks: int | None = None) -> DataFrame:
    """``pairs`` with ``part`` val or train: a fixed number of all, or a number or share of each benchmark (at least one, never all).

    ``benchmarks``: the number of benchmarks there must be; any other raises.
    """
    own, by = drawn(pairs, seed, key), [per] if per else []
    if benchmarks is not None and (found := own.select(*by).distinct().count()) != benchmarks:
        raise ValueError(f"{found} benchmarks instead of {benchmarks}")
    size = F.lit(fixed) if fixed is not None else F.lit(count) if count is not None else F.least(F.greatest(F.lit(1), F.bround(F.col("n") * fraction)), F.col("n") - 1)
    return parted(own, by, ["_d", key], lambda counts: counts.withColumn("val", size), ["val"], "train").drop("_d")


def round_robin(seeds: DataFrame, splits: DataFrame, seed_order: str, split_order: str) -> DataFrame:
    """Evaluation seed i gets split i mod n; both are tables of seeds."""
    w = lambda c: Window.partitionBy(F.lit(1)).orderBy(c)
    n = splits.count()
    a = seeds.withColumn("_i", F.pmod(F.row_number().over(w(seed_order)) - 1, F.lit(n)))
    return a.join(splits.withColumn("_i", F.row_number().over(w(split_order)) - 1), "_i").drop("_i")
