"""The stateless operators on streams: the same projections over a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def parsed_answers(stream: DataFrame) -> DataFrame:
    """A stream (or table) of ``task``, ``response``, ``options``, ``truth`` with the parsed answer and whether it is right."""
    pred = F.when(F.col("task") == "mcq", T.option_letter(F.col("response"), F.col("options"))).otherwise(T.open_answer(F.col("response")))
    return stream.withColumn("pred", pred).withColumn("correct", T.correct(F.col("task"), F.col("pred"), F.col("truth")))
