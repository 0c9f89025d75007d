"""Ranks, running sums and cuts in an order, without a task that holds a whole bucket.

``dealt`` sorts rows by (bucket, order) over pieces whose borders Spark draws from a sample of the rows themselves, so
pieces are of like size whatever the distribution: an outlier takes no room, a value that a third of the rows hold is
divided by the next order column and, where rows agree in all of them, by their place in the input. A bucket may lie in
many pieces and a piece hold many buckets. What a bucket has in earlier pieces is known from a table with a row a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def draw(seed: str | int | Column, key: str | Column) -> Column:
    """A draw that depends on seed and key alone: order by it and take the first."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")))


def drawn(rows: DataFrame, seed: str | int | Column, key: str) -> DataFrame:
    """``rows`` with the draw as ``_d`` and its first four digits as the number ``_cell``: 65,536 even cells."""
    return rows.withColumn("_d", draw(seed, key)).withColumn("_cell", F.conv(F.substring("_d", 1, 4), 16, 10).cast("int"))


def small(table: DataFrame) -> DataFrame:
    """``table``, computed once and stored: from the size of its files the planner broadcasts it, or else shuffles."""
    return stored(table, "small")


def matched(rows: DataFrame, table: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on ``by`` in which nulls are equal; the columns of ``by`` stay once."""
    if not by:
        return rows.crossJoin(F.broadcast(table)) if how == "inner" else rows.join(F.broadcast(table), F.lit(True), how)  # one row
    own = table.withColumnsRenamed({c: f"_k_{c}" for c in by})
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by))
    return rows.join(own, on, how).drop(*(f"_k_{c}" for c in by))


def _window(by: Iterable[str]):
    by = list(by)
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def dealt(rows: DataFrame, by: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """``rows``, stored, with ``_piece``: pieces of like size in the order of ``by`` and ``order``; ``_tie`` tells rows apart that agree in all of it.

    Nulls come first. ``pieces`` defaults to the session's number of shuffle partitions, less where they would be tiny.
    """
    told = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*by, *order, "_tie"]
    spread = told.repartitionByRange(pieces, *keys) if pieces else told.repartitionByRange(*keys)
    return stored(spread.withColumn("_piece", F.spark_partition_id()), "ordering-dealt")


def _carried(pieces: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Buckets that begin in an earlier piece: ``by``, ``_piece`` and ``_before``, the sum of ``value`` there; a row a piece at most."""
    key = F.struct(*by) if by else F.struct(F.lit(1).alias("_one"))
    ends = pieces.groupBy("_piece").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    earlier = F.lag("_last").over(Window.partitionBy(F.lit(1)).orderBy("_piece"))
    crossing = ends.withColumn("_earlier", earlier).filter(F.col("_earlier").isNotNull() & F.col("_earlier").eqNullSafe(F.col("_first")))
    held = _semi(pieces, crossing.select("_first.*").distinct(), by) if by else pieces
    sums = held.groupBy(*by, "_piece").agg(F.sum(value).alias("_n"))
    return sums.withColumn("_before", F.sum("_n").over(_window(by).orderBy("_piece")) - F.col("_n")).drop("_n")


def _semi(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose ``by`` stands in ``few``, a table with no more rows than there are pieces; nulls are equal."""
    own = few.withColumnsRenamed({c: f"_k_{c}" for c in by})
    return rows.join(F.broadcast(own), reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by)), "left_semi")


def running(rows: DataFrame, by: list[str], order: list[str], name: str, value: Column | None = None, pieces: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` (default 1) up to and with the row, in the order of its bucket.

    Nulls come first. Rows that tie in all of ``order`` are taken one by one. An empty table gives an empty result.
    """
    table = dealt(rows.withColumn("_v", F.lit(1).cast("long") if value is None else value), by, order, pieces)
    inside = F.sum("_v").over(_window([*by, "_piece"]).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0))
    before = F.broadcast(_carried(table, by, F.col("_v")))  # no more rows than pieces
    return matched(table.withColumn("_in", inside), before, [*by, "_piece"], "left").withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_in")).select(*rows.columns, name)


def counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """The cells of ``rows`` (``by``, ``_cell``) with ``_n``, their rows, and ``_before``, the rows of their bucket in earlier cells."""
    cells = rows.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    return cells.withColumn("_before", F.sum("_n").over(_window(by).orderBy("_cell")) - F.col("_n"))


def cuts(rows: DataFrame, cells: DataFrame, by: list[str], order: list[str], wanted: DataFrame) -> DataFrame:
    """The rows at given places: ``wanted`` (``by``, ``cut``, ``k`` from 1) to ``by``, ``cut``, ``at`` (a struct of ``order``).

    ``rows`` has a column ``_cell`` that rises with the order of a bucket, ``cells`` counts them (``counted``): only the
    rows of the cells that hold a wanted place are ordered. A place beyond the bucket gives no row.
    """
    hit = matched(cells, wanted, by).filter((F.col("k") > F.col("_before")) & (F.col("k") <= F.col("_before") + F.col("_n")))
    hit = hit.select(*by, "_cell", "cut", (F.col("k") - F.col("_before")).alias("_k"))
    near = matched(rows, hit, [*by, "_cell"])
    rank = F.row_number().over(_window([*by, "_cell", "cut"]).orderBy(*order))
    return near.withColumn("_rank", rank).filter("_rank = _k").select(*by, "cut", F.struct(*order).alias("at"))


def parted(rows: DataFrame, by: list[str], order: list[str], sizes: Callable[[DataFrame], DataFrame], parts: list[str], rest: str) -> DataFrame:
    """``rows`` with ``part``: the first of each bucket's order go to the first of ``parts``, and so on, all others to ``rest``.

    ``sizes`` turns the table of buckets (``by``, ``n``) into one with a column of sizes for each part; rows of buckets
    that it leaves out go. Rows that tie in all of ``order`` fall together. Draws (``drawn``) come with their cells;
    other orders are dealt. The cuts, a row a bucket, are stored; rows are marked where they stand.
    """
    if "_cell" in rows.columns:
        narrow = rows.select(*by, *order, "_cell")
    else:
        narrow = dealt(rows.select(*by, *order), by, order).withColumnRenamed("_piece", "_cell")
    cells = counted(narrow, by)
    buckets = sizes(cells.groupBy(*by).agg(F.sum("_n").alias("n")))
    ends = [reduce(lambda a, b: a + b, (F.col(p) for p in parts[: i + 1])) for i in range(len(parts))]
    wanted = buckets.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias("cut"), F.least(e, F.col("n")).cast("long").alias("k")) for i, e in enumerate(ends)))).alias("_w")).select(*by, "_w.*")
    found = cuts(narrow, cells, by, order, wanted.filter("k > 0"))
    table = matched(buckets.select(*by), found.groupBy(*by).agg(*(F.max(F.when(F.col("cut") == i, F.col("at"))).alias(f"_end{i}") for i in range(len(parts)))), by, "left")
    own = F.struct(*order)
    part = reduce(lambda c, i: c.when(own <= F.col(f"_end{i}"), parts[i]), range(1, len(parts)), F.when(own <= F.col("_end0"), parts[0]))
    return matched(rows, small(table), by).withColumn("part", part.otherwise(rest)).drop("_cell", *(f"_end{i}" for i in range(len(parts))))
