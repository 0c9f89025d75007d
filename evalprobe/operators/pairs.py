"""Contrastive pairs: length filters, numbering, unpivoting and selection by predicted labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import running


def short_reason(pairs: DataFrame, sides: dict[str, tuple[str, str]], least: int = 10) -> Column:
    """Why a pair goes: the first of ``sides`` (name to the columns of its texts) that has a text of fewer than ``least`` words, else ``kept``."""
    reason = None
    for name, texts in sides.items():
        short = F.greatest(*((T.word_count(F.col(t)) < least).cast("int") for t in texts), F.lit(0)) > 0
        reason = F.when(short, name) if reason is None else reason.when(short, name)
    return reason.otherwise("kept")


def numbered(pairs: DataFrame, *texts: str, least: int = 10, order: tuple[str, ...] = ("a_ord", "b_ord")) -> DataFrame:
    """The pairs of which every text has ``least`` words, numbered from 0 in order; the first order column is a number."""
    kept = pairs.filter(F.least(*(T.word_count(F.col(t)) for t in texts)) >= least if len(texts) > 1 else T.word_count(F.col(texts[0])) >= least)
    return running(kept, [], list(order), "_n").withColumn("k", (F.col("_n") - 1).cast("int")).drop("_n")


def unpivoted(pairs: DataFrame) -> DataFrame:
    """Two labelled samples a pair, named after its number; both sides keep ``k``."""
    side = lambda s, label, name: F.struct(F.concat(F.lit("pair_"), "k", F.lit(f"_{name}")).alias("name"), F.lit(label).alias("label"), F.col(f"{s}_id").alias("variant_id"), F.col(f"{s}_text").alias("text"))
    return pairs.withColumn("_s", F.explode(F.array(side("a", 0, "non_mirage"), side("b", 1, "mirage")))).select(*[c for c in pairs.columns if c[:2] not in ("a_", "b_")], "_s.*")


def same_label_reason(pairs: DataFrame, predicted: DataFrame, right_without: DataFrame | None, target: str) -> DataFrame:
    """``pairs`` with the reason why they are not kept: a side with another predicted label, or wrong without the evidence."""
    wide = predicted.groupBy("pair").pivot("side", ["a", "b"]).agg(F.first("predicted"))
    joined = pairs.join(wide.select("pair", F.col("a").alias("_a"), F.col("b").alias("_b")), "pair", "left")
    right: Column = F.lit(True)
    if right_without is not None:
        joined = joined.join(right_without.distinct().withColumn("_r", F.lit(True)), "b_id", "left")
        right = F.coalesce("_r", F.lit(False))
    reason = F.when(F.coalesce(F.col("_a") != target, F.lit(True)), "first_other").when(F.coalesce(F.col("_b") != target, F.lit(True)), "second_other").when(~right, "wrong_without").otherwise("kept")
    return joined.withColumn("reason", reason)


def conversation(system: Column, user: Column, image: Column, answer: Column) -> Column:
    """Messages with parts: system, user (text, and an image reference if there is one), assistant."""
    part = lambda kind, t, ref: F.struct(F.lit(kind).alias("type"), t.alias("text"), ref.alias("image_ref"))
    none = F.lit(None).cast("string")
    message = lambda role, parts: F.struct(F.lit(role).alias("role"), parts.alias("content"))
    users = F.when(image.isNotNull(), F.array(part("image_url", none, image), part("text", user, none))).otherwise(F.array(part("text", user, none)))
    turns = F.array(message("user", users), message("assistant", F.array(part("text", answer, none))))
    return F.when(system.isNotNull() & (system != ""), F.concat(F.array(message("system", F.array(part("text", system, none)))), turns)).otherwise(turns)


def has_image(messages: Column) -> Column:
    return F.exists(messages, lambda m: (m["role"] == "user") & F.exists(m["content"], lambda p: p["type"].isin("image_url", "image")))


def appended(messages: Column, role: str, text: Column) -> Column:
    """``messages`` with one more turn."""
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image_ref"))
    return F.concat(messages, F.array(F.struct(F.lit(role).alias("role"), F.array(part).alias("content"))))


def reused_rewrites(questions: DataFrame, rewrites: DataFrame, n: int, key: str = "unique_id", question: str = "question", order: str = "idx", text: str = "text") -> DataFrame:
    """A row for each of the first ``n`` rewrites of every question, as ``variant`` (from 1) and ``rewrite``.

    Rewrites are stripped; blank ones, repeats and copies of the question do not count. A question without rewrites, or
    with fewer than ``n`` that count, raises when its rows are read. Rewrites of unknown questions are left out. Only
    the first of equal texts go on to a question's row, so repeats of a rewrite are never gathered.
    """
    own = rewrites.select(key, T.strip(F.col(text)).alias("_text"), order).filter("_text <> ''").groupBy(key, "_text").agg(F.min(order).alias("_at"))
    met = questions.select(key, T.strip(F.col(question)).alias("_question")).join(own, key, "left")
    fresh = F.when(F.col("_text") != F.col("_question"), F.struct("_at", "_text"))
    folded = met.groupBy(key).agg(F.count("_text").alias("_any"), F.sort_array(F.collect_list(fresh)).alias("_all"))
    few = F.when(F.col("_any") == 0, F.concat(F.lit("no rewrites of "), F.col(key).cast("string"))).when(F.size("_all") < n, F.concat(F.lit("only "), F.size("_all").cast("string"), F.lit(f" rewrites, not {n}, of "), F.col(key).cast("string")))
    kept = F.when(few.isNotNull(), F.raise_error(few)).otherwise(F.slice("_all", 1, n))
    told = folded.select(key, F.posexplode(kept).alias("_i", "_x")).select(key, (F.col("_i") + 1).alias("variant"), F.col("_x._text").alias("rewrite"))
    return questions.join(told, key)
