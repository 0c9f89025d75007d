"""Plans of experiments: seeds without replacement, and jobs of stages and modes with what they wait for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seeds are numbers below 2**30.
SEED_BITS = 30
_FACTORS = (668_265_263, 374_761_393, 246_822_519)


def seed_at(index: Column, key: Column | int) -> Column:
    """The ``index``-th seed of an experiment: a permutation of all numbers below 2**30 that ``key`` chooses.

    Every round is a bijection (an odd factor and an addend, then the upper half mixed into the lower), so the seeds of
    different indices differ, without a list of those that are taken. An index is a whole number below 2**30.
    """
    size = 1 << SEED_BITS
    key = key if isinstance(key, Column) else F.lit(key)
    x = F.pmod(index.cast("long"), F.lit(size))
    for k, factor in enumerate(_FACTORS):
        x = F.pmod(x * factor + F.pmod(key.cast("long"), F.lit(size)) * _FACTORS[k - 1] + k, F.lit(size))
        x = x.bitwiseXOR(F.shiftright(x, SEED_BITS // 2))
    return x


def init_seed(split_seed: Column, init: Column, c: Column) -> Column:
    """The seed of a start: that of its split, the number of the start, and the penalty in ten-thousandths (half to even)."""
    return split_seed + 100_003 * init + F.bround(10_000 * c).cast("long")


def job_plan(stages: DataFrame, modes: DataFrame, models: DataFrame, skipped: Column) -> DataFrame:
    """A row a job: every stage (``stage_no``, ``stage``, ``family``) in every mode (``mode_no``, ``mode``) for every ``model``, without those of which ``skipped`` is true.

    ``tag`` names the job; ``waits_for`` is the number of the nearest earlier stage in which the model has a job (null
    for the first): a stage without a job in any mode is passed over. All three are tables of settings with few rows.
    """
    jobs = stages.crossJoin(F.broadcast(modes)).crossJoin(F.broadcast(models)).filter(~F.coalesce(skipped, F.lit(False)))
    tag = F.concat_ws("_", F.lpad(F.col("stage_no").cast("string"), 2, "0"), F.lpad(F.col("mode_no").cast("string"), 2, "0"), "stage", "mode", "model")
    there = jobs.select("model", "stage_no").distinct().withColumn("waits_for", F.lag("stage_no").over(Window.partitionBy("model").orderBy("stage_no")))
    return jobs.withColumn("tag", tag).join(there, ["model", "stage_no"])
