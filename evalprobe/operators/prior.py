"""Prior-index summaries of scored log-probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import auc, correlation, finite


def summary(rows: DataFrame, score: str, label: str, by: str = "dataset") -> DataFrame:
    """Counts, means by class, correlation and AUC for each dataset and for ``all``; scores that are not finite drop out."""
    rows = rows.select(by, finite(F.col(score)).alias(score), label).filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    both = rows.withColumn(by, F.explode(F.array(F.col(by), F.lit("all"))))
    own = lambda k: F.round(F.avg(F.when(F.col(label) == k, F.col(score))), 6)
    means = both.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_mirage"), own(1).alias("mean_mirage"), own(0).alias("mean_other"), F.round(correlation(F.col(score), F.col(label).cast("double")), 6).alias("r"))
    return means.join(auc(both, [by], score, label), by, "left").withColumn("auc", F.round("auc", 6))
