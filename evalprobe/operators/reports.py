"""Roll-up of result files: metric overrides, best by family, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .metrics import best


def overridden(rows: DataFrame, keys: list[str], **sources: DataFrame) -> DataFrame:
    """``rows`` with ``metric`` from the first source that has one, and ``metric_source``."""
    for name, source in sources.items():
        rows = rows.join(source.select(*keys, F.col("metric").alias(f"_{name}")), keys, "left")
    taken = F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in sources))
    return rows.withColumns({"metric": F.coalesce(*(F.col(f"_{n}") for n in sources)), "metric_source": taken}).drop(*(f"_{n}" for n in sources))


def section(lines: DataFrame, modes: list[str], primary: DataFrame, extra: DataFrame, replaced: Column) -> DataFrame:
    """The cells of one section of the result tables: a row a line and mode, with ``metric`` and its ``metric_source``.

    ``lines`` has ``line``, ``stage``, ``family`` and ``only_extra``; ``primary`` and ``extra`` have ``stage``, ``mode``,
    ``family`` and ``metric``, a row a cell. Lines with ``only_extra`` take the extra run or nothing. Others take the
    primary run, but where ``replaced`` is true (a condition on the line) the extra run comes first if it has a metric.
    """
    keys = ["stage", "mode", "family"]
    cells = lines.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    for name, source in (("primary", primary), ("extra", extra)):
        cells = cells.join(source.select(*keys, F.col("metric").alias(f"_{name}")), keys, "left")
    first = F.col("only_extra") | (replaced & F.col("_extra").isNotNull())
    taken = F.when(first, F.when(F.col("_extra").isNotNull(), F.lit("extra"))).when(F.col("_primary").isNotNull(), "primary")
    return cells.withColumns({"metric": F.when(first, F.col("_extra")).otherwise(F.col("_primary")), "metric_source": taken}).drop("_primary", "_extra")


def layer_order(name: Column) -> list[Column]:
    """Component, layer, part below it, head, name."""
    component = F.element_at(F.split(name, "/"), 1)
    part = F.when(F.contains(name, F.lit("attention_head_")), 2).when(F.contains(name, F.lit("/mlp")), 1).when(F.contains(name, F.lit("/post_attention")), 0).otherwise(-1)
    return [component, F.coalesce(T.layer(name), F.lit(-1)), part, F.coalesce(T.head(name), F.lit(-1)), name]


def experiment_order(stage: Column, mode: Column, name: Column, modes: list[str]) -> list[Column]:
    """Stage, mode in the stated order (others after), name."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, modes)), mode), F.lit(0))
    return [stage, F.when(place == 0, len(modes) + 1).otherwise(place), mode, name]


def best_by_family(rows: DataFrame, by: list[str], name: str = "feature", metric: str = "metric") -> DataFrame:
    """The best feature of each family (and experiment), ties by name."""
    placed = rows.withColumns({"family": T.family(F.col(name)), "layer": T.layer(F.col(name)), "strategy": T.strategy(F.col(name))})
    return best(placed, [*by, "family"], F.desc_nulls_last(metric), F.asc(name))


def table(rows: DataFrame, row: str, column: str, columns: list[str], metric: str = "metric") -> DataFrame:
    """Percent cells, one column a value of ``column``; empty cells read N/A."""
    wide = rows.groupBy(row).pivot(column, columns).agg(F.first(metric))
    return wide.select(row, *(T.percent(F.col(f"`{c}`")).alias(c) for c in columns))


def with_config(files: DataFrame, configs: DataFrame, path: str = "path") -> DataFrame:
    """Result files with the configuration in the same folder, the first by name if there are several."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    first = configs.groupBy(folder(F.col(path)).alias("_folder")).agg(F.min(path).alias("config_path"))
    return files.join(first, folder(F.col(path)) == F.col("_folder"), "left").drop("_folder")
