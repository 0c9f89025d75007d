"""The relations of the data model, as views over the given tables; each with the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts: documents with labels; the language is the dataset, the source the question."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id")
    return joined.select(F.col("doc_id").alias("src_ord"), F.col("lang").alias("dataset"), F.col("toxic").alias("label"), "quality", "text", F.col("doc_id").cast("string").alias("unique_id"), F.col("source").alias("question_id"), F.concat("lang", F.lit("::"), "source").alias("group_id"))


EX = "ex AS (SELECT d.doc_id AS src_ord, lang AS dataset, toxic AS label, quality, text, d.doc_id::VARCHAR AS unique_id, source AS question_id, lang || '::' || source AS group_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in the forms that models give them: the whole text of each document (ASCII) with a mark of the form, and options made from its words."""
    docs = table(spark, sf_dir, "documents").withColumn("body", F.regexp_replace("text", r"[^\x20-\x7E\n]", ""))
    w = F.regexp_extract_all("body", F.lit("[A-Za-z]+"), F.lit(0))
    word = lambda i: F.coalesce(F.try_element_at(w, F.lit(i)), F.lit("x"))
    kind, body = F.col("doc_id") % 8, F.col("body")
    response = F.when(kind == 0, F.concat(F.lit("[[ b ]] "), body)).when(kind == 1, F.concat(body, F.lit(" Final answer: C"))).when(kind == 2, F.concat(body, F.lit("\nOption D is best"))).when(kind == 3, F.concat(F.lit("A) "), body)).when(kind == 4, F.concat(body, F.lit("!"))).when(kind == 5, "").when(kind == 6, F.concat(F.lit("yes, there is "), body)).otherwise(F.concat(body, F.lit(" [["), word(1), F.lit(" "), word(2), F.lit("]] end")))
    options = F.concat(F.lit("A. "), word(1), F.lit("\nB) "), word(2), F.lit("\n c: "), word(3), F.lit("\nplain line: "), F.replace(body, F.lit("\n"), F.lit(" ")), F.lit("\nD. "), word(4))
    truth = F.when(F.col("doc_id") % 3 == 0, "B").when(F.col("doc_id") % 3 == 1, "Yes.").otherwise(word(1))
    return docs.select("doc_id", "lang", "source", response.alias("response"), options.alias("options"), truth.alias("truth"), F.when(F.col("doc_id") % 2 == 0, "mcq").otherwise("open").alias("task"))


ANS = r"""w AS (SELECT doc_id, lang, source, regexp_replace(text, '[^\x20-\x7E\n]', '', 'g') AS body FROM documents),
w1 AS (SELECT *, regexp_extract_all(body, '[A-Za-z]+') AS w FROM w),
w2 AS (SELECT *, coalesce(w[1], 'x') AS a, coalesce(w[2], 'x') AS b, coalesce(w[3], 'x') AS c, coalesce(w[4], 'x') AS d FROM w1),
ans AS (SELECT doc_id, lang, source, body, CASE doc_id % 8 WHEN 0 THEN '[[ b ]] ' || body WHEN 1 THEN body || ' Final answer: C' WHEN 2 THEN body || chr(10) || 'Option D is best' WHEN 3 THEN 'A) ' || body WHEN 4 THEN body || '!' WHEN 5 THEN '' WHEN 6 THEN 'yes, there is ' || body ELSE body || ' [[' || a || ' ' || b || ']] end' END AS response,
    'A. ' || a || chr(10) || 'B) ' || b || chr(10) || ' c: ' || c || chr(10) || 'plain line: ' || replace(body, chr(10), ' ') || chr(10) || 'D. ' || d AS options, CASE doc_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'Yes.' ELSE a END AS truth, CASE WHEN doc_id % 2 = 0 THEN 'mcq' ELSE 'open' END AS task, a, b, c, d FROM w2)"""


def paired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of question k with and without its evidence, whole texts: document 2k's, and by turns the same answer again, document 2k + 1's, and that one with a remark about the image in prose or as an answer option."""
    own = answers(spark, sf_dir)
    k = F.floor(F.col("doc_id") / 2).alias("k")
    one = own.filter("doc_id % 2 = 0").select(k, F.col("lang").alias("dataset"), F.col("source").alias("question_id"), "options", "truth", F.col("response").alias("with_text"))
    two = own.filter("doc_id % 2 = 1").select(k, F.col("response").alias("other"))
    kind = F.floor(F.col("k") / 8) % 4
    without = F.when(kind == 0, F.col("with_text")).when(kind == 1, F.concat("other", F.lit(" I cannot see the image."))).when(kind == 2, F.concat("other", F.lit("\nB. no image"))).otherwise(F.col("other"))
    return one.join(two, "k").select("k", "dataset", "question_id", F.when(F.col("k") % 2 == 0, "mcq").otherwise("open").alias("task"), "options", "truth", "with_text", without.alias("without_text"))


PAIRED = ANS + """, pa AS (SELECT e.doc_id // 2 AS k, e.lang AS dataset, e.source AS question_id, CASE WHEN e.doc_id // 2 % 2 = 0 THEN 'mcq' ELSE 'open' END AS task, e.a, e.b, e.c, e.d, e.truth, e.response AS with_text,
    CASE e.doc_id // 16 % 4 WHEN 0 THEN e.response WHEN 1 THEN o.response || ' I cannot see the image.' WHEN 2 THEN o.response || chr(10) || 'B. no image' ELSE o.response END AS without_text FROM ans e JOIN ans o ON o.doc_id = e.doc_id + 1 WHERE e.doc_id % 2 = 0)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired answers: documents 2k and 2k+1 are the answers of question k with and without its evidence."""
    docs = table(spark, sf_dir, "documents")
    k = F.floor(F.col("doc_id") / 2)
    one = docs.filter("doc_id % 2 = 0").select(k.alias("k"), F.col("lang").alias("dataset"), F.col("source").alias("question_id"), F.col("text").alias("with_text"))
    two = docs.filter("doc_id % 2 = 1").select(k.alias("k"), F.col("text").alias("without_text"))
    return one.join(two, "k")


RESP = "resp AS (SELECT a.doc_id // 2 AS k, a.lang AS dataset, a.source AS question_id, a.text AS with_text, b.text AS without_text FROM documents a JOIN documents b ON a.doc_id // 2 = b.doc_id // 2 AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of questions: a source is a question, its labelled documents the variants; no quality means neutral."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    state = F.when(F.col("quality").isNull(), "neutral").when(F.col("quality") == 1, "mirage").otherwise("non_mirage")
    return docs.join(labels, "doc_id", "left").select(F.col("lang").alias("dataset"), F.col("source").alias("question_id"), F.col("doc_id").cast("string").alias("variant_id"), state.alias("state"), (F.col("doc_id") % 5 == 0).alias("is_original"), "text", F.col("doc_id").alias("src_ord"), (F.col("doc_id") % 7 < 4).alias("with_correct"), (F.col("doc_id") % 5 < 2).alias("without_correct"))


VAR = "var AS (SELECT lang AS dataset, source AS question_id, d.doc_id::VARCHAR AS variant_id, CASE WHEN quality IS NULL THEN 'neutral' WHEN quality = 1 THEN 'mirage' ELSE 'non_mirage' END AS state, d.doc_id % 5 = 0 AS is_original, text, d.doc_id AS src_ord, d.doc_id % 7 < 4 AS with_correct, d.doc_id % 5 < 2 AS without_correct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as arrays of (role, content), in the order of their turns."""
    turns = table(spark, sf_dir, "conversations")
    folded = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return folded.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("conversation"))


def draw(seed: Column | str | int, key: Column) -> Column:
    """A draw that depends on seed and key alone: order by it and take the first."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrastive pairs: the first variant of each state of every question that has both."""
    v = variants(spark, sf_dir)
    w = Window.partitionBy("dataset", "question_id", "state").orderBy("variant_id")
    first = v.filter("state <> 'neutral'").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    a, b = first.filter("state = 'non_mirage'"), first.filter("state = 'mirage'")
    return a.select("dataset", "question_id", F.col("variant_id").alias("a_id"), F.col("text").alias("a_text"), F.col("src_ord").alias("a_ord")).join(b.select("dataset", "question_id", F.col("variant_id").alias("b_id"), F.col("text").alias("b_text"), F.col("src_ord").alias("b_ord")), ["dataset", "question_id"])


PAIRS = VAR + """, f AS (SELECT *, row_number() OVER (PARTITION BY dataset, question_id, state ORDER BY variant_id) AS rn FROM var WHERE state <> 'neutral'),
pairs AS (SELECT a.dataset, a.question_id, a.variant_id AS a_id, a.text AS a_text, a.src_ord AS a_ord, b.variant_id AS b_id, b.text AS b_text, b.src_ord AS b_ord FROM f a JOIN f b ON a.dataset = b.dataset AND a.question_id = b.question_id AND a.state = 'non_mirage' AND b.state = 'mirage' AND a.rn = 1 AND b.rn = 1)"""


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in long form: embeddings cut into four layers of sixteen dimensions."""
    e = table(spark, sf_dir, "embeddings")
    layer = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("layer")
    e = e.select("vec_id", "label", "embedding", layer)
    return e.select("vec_id", (F.col("label") >= 5).cast("int").alias("label"), "layer", F.concat(F.lit("language_model/layer_"), "layer", F.lit("__mean")).alias("feature"), F.slice("embedding", F.col("layer") * 16 + 1, F.lit(16)).alias("vec"))


ACT = "act AS (SELECT vec_id, (label >= 5)::INT AS label, layer, 'language_model/layer_' || layer || '__mean' AS feature, embedding[layer * 16 + 1 : layer * 16 + 16] AS vec FROM (SELECT *, unnest([0, 1, 2, 3]) AS layer FROM embeddings))"


def told(vec: str = "vec") -> Column:
    """A whole vector as text, every component in whole ten-thousandths."""
    return F.array_join(F.transform(vec, lambda x: F.round(x.cast("double") * 10000).cast("long").cast("string")), ",")


def told_sql(vec: str) -> str:
    return f"array_to_string(list_transform({vec}, lambda x: round(x::DOUBLE * 10000)::BIGINT), ',')"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe runs: line items by feature, seed and C, with the mean discount as accuracy."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_returnflag").alias("feature"), F.col("l_linenumber").alias("split_seed"), F.when(F.col("l_linestatus") == "O", 0.1).otherwise(1.0).alias("c_value"), (F.col("l_orderkey") % 3).cast("int").alias("init_index")).agg(F.round(F.avg(F.col("l_discount").cast("double")), 3).alias("validation_accuracy"), F.round(F.avg(F.col("l_tax").cast("double")), 3).alias("train_accuracy"), F.round(F.avg(F.col("l_quantity").cast("double")) / 50, 3).alias("test_accuracy"))


RUNS = "runs AS (SELECT l_returnflag AS feature, l_linenumber AS split_seed, CASE WHEN l_linestatus = 'O' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS c_value, (l_orderkey % 3)::INT AS init_index, round(avg(l_discount::DOUBLE), 3) AS validation_accuracy, round(avg(l_tax::DOUBLE), 3) AS train_accuracy, round(avg(l_quantity::DOUBLE) / 50, 3) AS test_accuracy FROM lineitem GROUP BY ALL)"


def phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored log-probabilities: four dimensions of each embedding, the upper labels as outcome."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("set"), F.col("label") % 3).alias("dataset"), F.col("vec_id").alias("unique_id"), at(1).alias("with_q"), at(2).alias("with_null"), at(3).alias("without_q"), at(4).alias("without_null"), (F.col("label") >= 5).cast("int").alias("mirage"))


PHI = "phi AS (SELECT 'set' || (label % 3) AS dataset, vec_id AS unique_id, embedding[1]::DOUBLE AS with_q, embedding[2]::DOUBLE AS with_null, embedding[3]::DOUBLE AS without_q, embedding[4]::DOUBLE AS without_null, (label >= 5)::INT AS mirage FROM embeddings)"
