"""The pipeline over ``documents``: quality rules, line dedup, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Stages that change a text set
``n_chars`` to its new length. In every stage an empty table gives an empty result, further columns pass through under
any name (packing leaves them out), texts are read whole, and null ids are allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalprobe.llm import lines, minhash, mixing, packing, quality
from evalprobe.llm.common import stored


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that the rules reject go, null and empty texts among them. Repeated rows are judged alike."""
    return _measured(quality.cleaned(docs))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or nearly equal lines the earliest stays; documents without a line of their own go.

    Null ids come last, ties in id go by the text's fingerprint, and rows that agree in both count as one document. A
    null text stays.
    """
    return _measured(lines.deduplicated(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: a null id first, then the least id, ties by a fingerprint of id and text.

    A null text counts as empty; empty texts are one class. Of repeated rows one stays.
    """
    return minhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source, null and empty texts have no words and get no drawn copy.

    Rows that agree in id and text are taken together.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null text is the end id alone, repeated rows are packed one by one."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", clean), ("line_dedup", distinct_lines), ("near_duplicates", distinct_documents), ("mixing", mix), ("packing", pack)]

#: Consistent weighted sampling and tokenising are beyond SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
