"""Signatures of conversations, first-wins dedupe, and pools that share nothing with training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .bloom import anti, built, checked, maybe


def last_of(conversation: Column, role: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(conversation, lambda m: m["role"] == role), F.lit(-1))["content"], F.lit(""))


def first_of(conversation: Column, role: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(conversation, lambda m: m["role"] == role), F.lit(1))["content"], F.lit(""))


def signature(*parts: Column) -> Column:
    """MD5 of the JSON array of squeezed texts (system, user, assistant)."""
    return F.md5(F.to_json(F.array(*map(T.squeeze, parts))))


def conversation_signature(conversation: Column) -> Column:
    return signature(*(last_of(conversation, r) for r in ("system", "user", "assistant")))


def first_wins(rows: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The first row of every key, by ``order``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def last_wins(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value of the last row of every key; one row a key, so a join with it never fans out."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def overlap_reason(train: DataFrame, pool: DataFrame, dataset: str = "dataset", uid: str = "unique_id", qid: str = "question_id") -> DataFrame:
    """``pool`` with ``reason``: uid or qid if the training rows hold it, the uid first; null is kept. Blank keys never match.

    One Bloom filter holds the training rows' keys of both kinds: of the pool, rows neither of whose keys can be in it
    are kept where they stand, the others are joined with the keys themselves.
    """
    key = lambda c: F.when((F.col(dataset) != "") & (F.trim(c) != ""), F.trim(c))
    told = lambda rows: rows.withColumns({"_set": F.col(dataset), "_u": key(uid), "_q": key(qid)})
    kinds = F.explode(F.array(F.struct(F.lit("u").alias("_kind"), F.col("_u").alias("_key")), F.struct(F.lit("q").alias("_kind"), F.col("_q").alias("_key")))).alias("_k")
    names = told(train).select("_set", kinds).select("_set", "_k.*").filter("_key IS NOT NULL")
    filters = built(names, ["_kind", "_set", "_key"])
    rows = told(pool)
    for kind in ("u", "q"):
        rows = maybe(rows.withColumns({"_kind": F.lit(kind), "_key": F.col(f"_{kind}")}), ["_kind", "_set", "_key"], filters, f"_may_{kind}").withColumn(f"_may_{kind}", F.col(f"_may_{kind}") & F.col("_key").isNotNull()).drop("_kind", "_key")
    drop = ["_set", "_u", "_q", "_may_u", "_may_q"]
    free = rows.filter("NOT (_may_u OR _may_q)").drop(*drop).withColumn("reason", F.lit(None).cast("string"))
    distinct = names.distinct()
    of = lambda kind: distinct.filter(F.col("_kind") == kind).select(F.col("_set").alias(f"_set_{kind}"), F.col("_key").alias(f"_key_{kind}"))
    joined = rows.filter("_may_u OR _may_q")
    for kind in ("u", "q"):
        joined = joined.join(of(kind), (F.col("_set") == F.col(f"_set_{kind}")) & (F.col(f"_{kind}") == F.col(f"_key_{kind}")), "left")
    joined = joined.withColumn("reason", F.when(F.col("_key_u").isNotNull(), "uid").when(F.col("_key_q").isNotNull(), "qid")).drop(*drop, "_set_u", "_set_q", "_key_u", "_key_q")
    return free.unionByName(joined)


def holdout(pool: DataFrame, train: DataFrame, passes: Column, key: str = "sig", order: str = "src_ord") -> DataFrame:
    """Rows that pass and are not in training, first of each signature; a row that fails does not use up its signature."""
    return first_wins(anti(pool.filter(passes), train, [key]), [key], order)


def available(rows: DataFrame, store: DataFrame, by: list[str | Column], key: str = "sig") -> DataFrame:
    """Rows before and after the filter to the signatures of a store, by class; rows that the store rules out are not joined."""
    there = checked(rows, store, [key], lambda few: few.join(store.select(key).distinct().withColumn("_there", F.lit(True)), key, "left"), lambda rest: rest.withColumn("_there", F.lit(None).cast("boolean")))
    return there.groupBy(*by).agg(F.count("*").alias("n_before"), F.count_if(F.col("_there")).alias("n_after"))


def added(train: DataFrame, more: DataFrame, key: str = "sig", order: str | Column = "src_ord") -> DataFrame:
    """The training rows and, of ``more``, the rows whose signature they lack; of equal signatures on a side the first."""
    return first_wins(train, [key], order).unionByName(first_wins(anti(more, train, [key]), [key], order))


def with_fallback(rows: DataFrame, key: str, *stores: tuple[str, DataFrame], value: str = "vec") -> DataFrame:
    """``rows`` with a value from the first store that has the key, and the store's name."""
    for name, store in stores:
        rows = rows.join(store.select(F.col(key), F.col(value).alias(f"_{name}")), key, "left")
    names = [n for n, _ in stores]
    source = F.coalesce(*(F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in names))
    return rows.withColumn("store", source).withColumn(value, F.coalesce(*(F.col(f"_{n}") for n in names))).drop(*(f"_{n}" for n in names))


def attach_images(rows: DataFrame, images: DataFrame, dataset: str = "dataset", uid: str = "unique_id", qid: str = "question_id", order: str = "src_ord", value: str = "images", require: bool = False) -> DataFrame:
    """Images by unique id, else by question id; of repeated question ids the last wins. An empty list by unique id stays."""
    by_uid = last_wins(images, [dataset, uid], value, order).select(F.col(dataset).alias("_d1"), F.col(uid).alias("_u"), F.col(value).alias("_v1"))
    by_qid = last_wins(images, [dataset, qid], value, order).select(F.col(dataset).alias("_d2"), F.col(qid).alias("_q"), F.col(value).alias("_v2"))
    joined = rows.join(by_uid, (F.col(dataset) == F.col("_d1")) & (F.col(uid) == F.col("_u")), "left").join(by_qid, (F.col(dataset) == F.col("_d2")) & (F.col(qid) == F.col("_q")), "left")
    joined = joined.withColumn(value, F.coalesce("_v1", "_v2")).drop("_d1", "_u", "_v1", "_d2", "_q", "_v2").filter(F.col(value).isNotNull())
    return joined.filter(F.size(value) > 0) if require else joined


def required(rows: DataFrame, column: str, message: str = "missing") -> DataFrame:
    """``rows``; one that lacks the column's value raises."""
    return rows.filter(F.assert_true(F.col(column).isNotNull(), F.lit(f"{message}: {column}")).isNull())


def images_by_name(rows: DataFrame, images: DataFrame, name: str = "image_name") -> DataFrame:
    """``rows`` with ``image`` by the base name of a path; null if there is no such file."""
    own = images.select(F.col("name").alias("_n"), "image")
    return rows.join(own, T.file_name(F.col(name)) == F.col("_n"), "left").drop("_n")
