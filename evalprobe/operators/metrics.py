"""Accuracies, seed aggregates, correlation and AUC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running


def accuracies(rows: DataFrame, right: Column, label: str = "label", benchmark: str = "dataset", by: list[str] | None = None) -> DataFrame:
    """Accuracy overall, per class, per benchmark and per both; a blank benchmark is ``unknown``. ``by`` keeps runs apart."""
    by = by or []
    named = rows.withColumns({"_r": right.cast("int"), "bench": F.coalesce(F.nullif(F.trim(benchmark), F.lit("")), F.lit("unknown")), "class": F.col(label)})
    sets = [[F.col(c) for c in by + own] for own in ([], ["class"], ["bench"], ["bench", "class"])]
    keys = [F.col(c) for c in [*by, "bench", "class"]]
    return named.groupingSets(sets, *keys).agg(F.count("*").alias("n"), F.round(F.avg("_r"), 6).alias("accuracy"))


def over_seeds(runs: DataFrame, by: list[str], *metrics: str) -> DataFrame:
    """Mean and population deviation over the runs of a group; 0 for a single run."""
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), *(F.round(F.avg(m), 6).alias(f"{m}_mean") for m in metrics), *(F.round(F.stddev_pop(m), 6).alias(f"{m}_std") for m in metrics))


def map_means(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean of each key of a map over the runs that have it, as numbers, and the mean of these means."""
    each = runs.select(*by, F.explode(metric).alias("key", "value")).withColumn("value", F.col("value").cast("string").try_cast("double")).filter("value IS NOT NULL")
    means = each.groupBy(*by, "key").agg(F.avg("value").alias("mean"))
    return means.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "mean")))).alias("means"), F.avg("mean").alias("macro"))


def modal(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of a group, ties to the smallest."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias(value))


def best(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null under two pairs or without variance."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    # merged central moments: raw sums lose the variance of values with a large mean
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((F.count(x) >= 2) & (vx > 0) & (vy > 0), F.covar_pop(x, y) / (F.sqrt(vx) * F.sqrt(vy)))


def auc(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by mean ranks, ties one half; null without both classes.

    Ranks come from the distinct scores of a group with their counts, so rows of equal scores are summed before they meet.
    """
    scores = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    wins = running(scores, by, [score], "_upto", F.col("q")).withColumn("w", F.col("p") * (F.col("_upto") - F.col("q") / 2))
    return wins.groupBy(*by).agg(F.try_divide(F.sum("w"), (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))
