"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, kdtree, lines, minhash, mixing, packing, quality, repair, scoring, secrets, spelling, substrings, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest, _ = mixing.copies(_table(spark, sf_dir, "documents"))
    return digest.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.neighbours(_table(spark, sf_dir, "embeddings"))


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_table(spark, sf_dir, "documents"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts spell marks of chat templates, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(*chat.packed(rows.unionByName(more)))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with planted typing errors, which the operator has to lead back to their forms."""
    return spelling.grouped(_table(spark, sf_dir, "documents"), spelling.mistyped)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with planted faults, repaired."""
    return repair.digest(repair.damaged(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_lines": op1_lines, "op2_warc": op2_warc, "op3_mixing": op3_mixing, "op4_minhash": op4_minhash, "op5_packing": op5_packing, "op6_quality": op6_quality, "op7_kdtree": op7_kdtree, "op8_scoring": op8_scoring, "op9_secrets": op9_secrets, "op10_substrings": op10_substrings, "op11_chat": op11_chat, "op12_spelling": op12_spelling, "op13_repair": op13_repair}
ORACLE: dict[str, str] = {"op3_mixing": mixing.SQL, "op6_quality": quality.SQL, "op7_kdtree": kdtree.SQL}
