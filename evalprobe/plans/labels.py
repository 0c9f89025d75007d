"""Queries over labels, groups, pairs and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keys as K
from ..operators import labels as L
from . import views as V
from .answers import _normal
from .registry import query

_BAGS = r"""a AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all(lower(with_text), '[a-z0-9]+')) AS w FROM resp) GROUP BY ALL),
b AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all(lower(without_text), '[a-z0-9]+')) AS w FROM resp) GROUP BY ALL),
cos AS (SELECT resp.k, coalesce((SELECT sum(a.n * b.n) FROM a JOIN b USING (k, w) WHERE k = resp.k) / (sqrt((SELECT sum(n * n) FROM a WHERE k = resp.k)::DOUBLE) * sqrt((SELECT sum(n * n) FROM b WHERE k = resp.k)::DOUBLE)), 0) AS cosine FROM resp)"""
_STATE = "CASE WHEN length(without_text) < 200 THEN 'neutral_missing_response' WHEN contains(without_text, 'tion') THEN 'non_mirage' WHEN cosine >= 0.7 THEN 'mirage' ELSE 'neutral' END"


@query(f"WITH {V.RESP}, {_BAGS} SELECT k, round(cosine, 6) AS cosine FROM cos")
def a24_text_cosine(spark, sf_dir):
    return V.responses(spark, sf_dir).select("k", F.round(L.token_cosine(F.col("with_text"), F.col("without_text")), 6).alias("cosine"))


@query(f"WITH {V.RESP}, {_BAGS} SELECT k, round(cosine, 6) >= 0.7 AND left(with_text, 1) = left(without_text, 1) AS alike FROM resp JOIN cos USING (k)")
def f10_similar_answers(spark, sf_dir):
    # the first letters stand for parsed answers that are there
    first = lambda c: F.concat(F.lit("z"), F.ascii(c))
    cosine = F.round(L.token_cosine(F.col("with_text"), F.col("without_text")), 6)
    rows = V.responses(spark, sf_dir).select("k", first("with_text").alias("a"), first("without_text").alias("b"), cosine.alias("cosine"))
    return rows.select("k", L.similar(F.lit("open"), F.col("a"), F.col("b"), F.col("cosine")).alias("alike"))


@query(f"WITH {V.RESP}, {_BAGS} SELECT k, {_STATE} AS label, CASE {_STATE} WHEN 'mirage' THEN true WHEN 'non_mirage' THEN false END AS mirage_like FROM resp JOIN cos USING (k)")
def f11_mirage_label(spark, sf_dir):
    rows = V.responses(spark, sf_dir).withColumn("cosine", L.token_cosine(F.col("with_text"), F.col("without_text")))
    state, label = L.mirage(F.length("without_text") < 200, F.contains("without_text", F.lit("tion")), F.col("cosine") >= 0.7)
    return rows.select("k", label.alias("label"), state.alias("mirage_like"))


_SUM = "count(*) AS n, count(*) FILTER (state = 'mirage') AS n_mirage, count(*) FILTER (state = 'non_mirage') AS n_non_mirage, count(*) FILTER (state = 'neutral') AS n_neutral, round(count(*) FILTER (state = 'mirage')::DOUBLE / nullif(count(*) FILTER (state <> 'neutral'), 0), 6) AS mirage_rate, round(avg(with_correct::INT), 6) AS with_accuracy, round(avg(without_correct::INT), 6) AS without_accuracy"


def _chain_sql() -> str:
    """The label chain in SQL: both sides parsed and scored as rows of their own, then compared."""
    from .answers import _CORRECT, _PRED

    says = lambda ps: " OR ".join("regexp_matches(bare, '" + p.replace("'", "''") + "')" for p in ps)
    return f"""{V.PAIRED}, si AS (SELECT k, 'w' AS side, task, with_text AS response, a, b, c, d, truth FROM pa UNION ALL SELECT k, 'o', task, without_text, a, b, c, d, truth FROM pa),
pr AS (SELECT *, {_PRED} AS pred FROM si), co AS (SELECT *, {_CORRECT} AS correct, {_normal("pred")} AS plain FROM pr),
resp AS (SELECT k, with_text, without_text FROM pa), {_BAGS},
ack AS (SELECT k, {says(T.NO_IMAGE)} AS no_image, {says(T.UNCERTAIN)} AS uncertain FROM (SELECT k, regexp_replace(lower(without_text), '\\n[a-j]\\. no image', '', 'g') AS bare FROM pa)),
jo AS (SELECT pa.*, w.pred AS with_pred, o.pred AS without_pred, w.correct AS with_correct, o.correct AS without_correct, no_image, uncertain, round(cosine, 6) AS cosine,
    CASE WHEN pa.task = 'mcq' THEN coalesce(w.pred = o.pred, false) WHEN w.plain IS NOT NULL AND o.plain IS NOT NULL THEN w.plain = o.plain ELSE true END AND round(cosine, 6) >= 0.7 AS alike
    FROM pa JOIN co w ON w.k = pa.k AND w.side = 'w' JOIN co o ON o.k = pa.k AND o.side = 'o' JOIN ack ON ack.k = pa.k JOIN cos ON cos.k = pa.k),
lab AS (SELECT *, CASE WHEN with_text = '' OR without_text = '' THEN 'neutral_missing_response' WHEN no_image OR uncertain THEN 'non_mirage' WHEN alike THEN 'mirage' ELSE 'neutral' END AS label FROM jo),
st AS (SELECT *, CASE label WHEN 'mirage' THEN 'mirage' WHEN 'non_mirage' THEN 'non_mirage' ELSE 'neutral' END AS state, len(regexp_extract_all(with_text, '\\S+')) AS wn, len(regexp_extract_all(without_text, '\\S+')) AS own FROM lab)"""


@query(f"WITH {_chain_sql()} SELECT k, with_pred, without_pred, with_correct, without_correct, no_image, uncertain, cosine, alike, label FROM st")
def f11_label_chain(spark, sf_dir):
    """From answer texts to labels: parsed, scored, searched for admissions, compared."""
    return L.labelled(V.paired_answers(spark, sf_dir)).select("k", "with_pred", "without_pred", "with_correct", "without_correct", "no_image", "uncertain", "cosine", "alike", "label")


@query(f"""WITH {_chain_sql()}, q AS (SELECT dataset, question_id, count(*) FILTER (state = 'mirage') > 0 AND count(*) FILTER (state = 'non_mirage') > 0 AS flip FROM st GROUP BY ALL),
f AS (SELECT dataset, count(*) AS n_questions, count(*) FILTER (flip) AS n_flips, round(avg(flip::INT), 6) AS flip_rate FROM q GROUP BY dataset),
s AS (SELECT dataset, {_SUM}, count(*) FILTER (with_text = '') AS missing_with, count(*) FILTER (without_text = '') AS missing_without, count(*) FILTER (with_text = '' OR without_text = '') AS missing_pairs, count(*) FILTER (wn < 10) AS short_with, count(*) FILTER (own < 10) AS short_without, count(*) FILTER (wn < 10 OR own < 10) AS short_pairs FROM st GROUP BY dataset)
SELECT * FROM s JOIN f USING (dataset)""")
def a2_label_chain_summary(spark, sf_dir):
    """The whole chain, from answer texts to the summary of each data set."""
    return L.label_summary(L.labelled(V.paired_answers(spark, sf_dir)), ["dataset"], ["question_id"])


_MIR = "CASE state WHEN 'mirage' THEN true WHEN 'non_mirage' THEN false END"


def _mirage_like():
    return F.when(F.col("state") == "mirage", True).when(F.col("state") == "non_mirage", False)


@query(f"WITH {V.VAR} SELECT variant_id, CASE state WHEN 'mirage' THEN 1 WHEN 'non_mirage' THEN 0 END AS strict, CASE state WHEN 'mirage' THEN 1 ELSE 0 END AS with_neutral, CASE WHEN state = 'mirage' THEN 1 WHEN NOT without_correct AND with_correct THEN 0 END AS clean_b FROM var")
def p6_p7_p8_labels(spark, sf_dir):
    return V.variants(spark, sf_dir).select("variant_id", L.strict(_mirage_like()).alias("strict"), L.with_neutral(_mirage_like(), F.col("state")).alias("with_neutral"), L.clean_b(_mirage_like(), F.col("with_correct"), F.col("without_correct")).alias("clean_b"))


@query(f"WITH {V.VAR} SELECT dataset, question_id, count(*) AS n_variants, count(*) FILTER (state = 'mirage') AS n_mirage, count(*) FILTER (state = 'non_mirage') AS n_non_mirage, count(*) FILTER (state = 'neutral') AS n_neutral, count(*) FILTER (state = 'mirage') > 0 AND count(*) FILTER (state = 'non_mirage') > 0 AS flip FROM var GROUP BY ALL")
def a1_question_groups(spark, sf_dir):
    return L.question_groups(V.variants(spark, sf_dir), ["dataset", "question_id"])


@query(f"WITH {V.VAR} SELECT dataset, question_id, string_agg(variant_id || ':' || state, ',' ORDER BY src_ord) AS nested FROM var GROUP BY ALL")
def a1_nested_variants(spark, sf_dir):
    groups = L.question_groups(V.variants(spark, sf_dir), ["dataset", "question_id"], nested=["src_ord", "variant_id", "state"])
    return groups.select("dataset", "question_id", F.array_join(F.transform("variants", lambda v: F.concat(v["variant_id"], F.lit(":"), v["state"])), ",").alias("nested"))


@query(f"WITH {V.VAR}, q AS (SELECT dataset, question_id, count(*) FILTER (state = 'mirage') > 0 AND count(*) FILTER (state = 'non_mirage') > 0 AS flip FROM var GROUP BY ALL) SELECT dataset, count(*) AS n_questions, count(*) FILTER (flip) AS n_flips, round(avg(flip::INT), 6) AS flip_rate FROM q GROUP BY dataset")
def a2_flip_rates(spark, sf_dir):
    return L.flip_rates(L.question_groups(V.variants(spark, sf_dir), ["dataset", "question_id"]), ["dataset"])


_LEN = "len(regexp_extract_all({0}_text, '\\S+'))"


@query(f"WITH {V.RESP}, r AS (SELECT dataset, CASE WHEN k % 7 = 0 THEN 0 ELSE {_LEN.format('with')} END AS w, {_LEN.format('without')} AS o FROM resp) SELECT dataset, count(*) FILTER (w = 0) AS missing_with, count(*) FILTER (o = 0) AS missing_without, count(*) FILTER (w < 120) AS short_with, count(*) FILTER (o < 120) AS short_without, count(*) FILTER (w = 0 OR o = 0) AS missing_pairs, count(*) FILTER (w < 120 OR o < 120) AS short_pairs FROM r GROUP BY dataset")
def a2_missing_and_short(spark, sf_dir):
    rows = V.responses(spark, sf_dir).withColumn("with_text", F.when(F.col("k") % 7 != 0, F.col("with_text")))
    return L.length_counts(rows, ["dataset"], "with_text", "without_text", 120)




@query(f"WITH {V.VAR} SELECT dataset, {_SUM} FROM var GROUP BY dataset")
def a2_dataset_summary(spark, sf_dir):
    return L.summary(V.variants(spark, sf_dir), ["dataset"])


@query(f"WITH {V.VAR} SELECT dataset, grouping(dataset)::BIGINT AS level, {_SUM} FROM var GROUP BY ROLLUP (dataset)")
def a3_rollup_summary(spark, sf_dir):
    return L.summary(V.variants(spark, sf_dir), ["dataset"], rollup=True)


@query(f"WITH {V.PAIRS} SELECT dataset, question_id, a_id, b_id FROM pairs")
def w1_first_variants(spark, sf_dir):
    return V.pairs(spark, sf_dir).select("dataset", "question_id", "a_id", "b_id")


@query(f"WITH {V.PAIRS} SELECT dataset, question_id FROM pairs WHERE dataset IN ('en', 'de')")
def p1_selected_benchmarks(spark, sf_dir):
    return V.pairs(spark, sf_dir).filter(F.col("dataset").isin("en", "de")).select("dataset", "question_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def p2_block_list(spark, sf_dir):
    blocked = V.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    return V.table(spark, sf_dir, "documents").join(blocked, "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE upper(source) = 'SRC3' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def p3_j1_closed_test_split(spark, sf_dir):
    split = V.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return V.table(spark, sf_dir, "documents").filter(F.upper("source") == "SRC3").join(split, "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id, lang || '_' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS id FROM documents WHERE n_chars > 500")
def p4_sequential_ids(spark, sf_dir):
    from ..operators.ordering import running

    rows = V.table(spark, sf_dir, "documents").filter("n_chars > 500").select("doc_id", "lang")
    return running(rows, ["lang"], ["doc_id"], "rn").select("doc_id", F.concat("lang", F.lit("_"), F.col("rn") - 1).alias("id"))


@query("SELECT lang, count(*) AS n_rows, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS n_skipped FROM documents GROUP BY lang")
def p2_skip_counts(spark, sf_dir):
    blocked = V.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("blocked", F.lit(True))
    marked = V.table(spark, sf_dir, "documents").select("doc_id", "lang").join(blocked, "doc_id", "left")
    return marked.groupBy("lang").agg(F.count("*").alias("n_rows"), F.count_if(F.col("blocked")).alias("n_skipped"))


@query(f"WITH {V.PAIRS} SELECT CASE WHEN len(regexp_extract_all(a_text, '\\S+')) < 150 OR length(a_id) < 2 THEN 'first_short' WHEN len(regexp_extract_all(b_text, '\\S+')) < 150 THEN 'second_short' ELSE 'kept' END AS reason, count(*) AS n FROM pairs GROUP BY ALL")
def p11_short_sides(spark, sf_dir):
    from ..operators.pairs import short_reason

    rows = V.pairs(spark, sf_dir).withColumn("a_more", F.when(F.length("a_id") < 2, "few").otherwise(F.repeat(F.lit("word "), 150)))
    return rows.groupBy(short_reason(rows, {"first_short": ("a_text", "a_more"), "second_short": ("b_text",)}, 150).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 7")
def p5_first_n(spark, sf_dir):
    from ..operators.sampling import first_n

    return first_n(V.table(spark, sf_dir, "documents"), ["lang"], 7, F.col("doc_id")).select("doc_id", "lang")


@query(f"WITH {V.EX} SELECT dataset, count(*) AS n_before, count(*) FILTER (len(regexp_extract_all(text, '\\S+')) >= 10) AS n_after FROM ex GROUP BY dataset")
def p10_p18_minimum_length(spark, sf_dir):
    kept = T.word_count(F.col("text")) >= 10
    return V.examples(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("n_before"), F.count_if(kept).alias("n_after"))


@query(f"WITH {V.PAIRS}, k AS (SELECT *, row_number() OVER (ORDER BY a_ord, b_ord) - 1 AS k FROM pairs WHERE least(len(regexp_extract_all(a_text, '\\S+')), len(regexp_extract_all(b_text, '\\S+'))) >= 10) SELECT 'pair_' || k || '_non_mirage' AS name, 0 AS label, a_id AS variant_id FROM k UNION ALL SELECT 'pair_' || k || '_mirage', 1, b_id FROM k")
def p11_p12_w10_pair_samples(spark, sf_dir):
    from ..operators.pairs import numbered, unpivoted

    return unpivoted(numbered(V.pairs(spark, sf_dir), "a_text", "b_text")).select("name", "label", "variant_id")


@query(f"WITH {V.PAIRS}, r AS (SELECT CASE WHEN len(regexp_extract_all(a_text, '\\S+')) >= 300 THEN 'first_long' WHEN len(regexp_extract_all(b_text, '\\S+')) >= 300 THEN 'second_long' ELSE 'kept' END AS reason FROM pairs) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def p14_short_questions(spark, sf_dir):
    n = lambda c: T.word_count(F.col(c))
    reason = F.when(n("a_text") >= 300, "first_long").when(n("b_text") >= 300, "second_long").otherwise("kept")
    return V.pairs(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_AB = "ab AS (SELECT p.*, CASE WHEN a_ord % 2 = 0 THEN 'A' ELSE 'B' END AS la, CASE WHEN b_ord % 2 = 0 THEN 'A' ELSE 'B' END AS lb FROM pairs p)"


@query(f"WITH {V.PAIRS}, {_AB} SELECT CASE WHEN la <> 'A' THEN 'first_other' WHEN lb <> 'A' THEN 'second_other' WHEN NOT (b_ord % 5 < 2) THEN 'wrong_without' ELSE 'kept' END AS reason, count(*) AS n FROM ab GROUP BY ALL")
def p15_j8_j10_same_label_pairs(spark, sf_dir):
    from ..operators.pairs import same_label_reason

    pairs = V.pairs(spark, sf_dir).withColumn("pair", F.concat("dataset", F.lit(":"), "question_id"))
    side = lambda s: pairs.select("pair", F.lit(s).alias("side"), F.when(F.col(f"{s}_ord") % 2 == 0, "A").otherwise("B").alias("predicted"))
    right = V.variants(spark, sf_dir).filter("without_correct").select(F.col("variant_id").alias("b_id"))
    reason = same_label_reason(pairs, side("a").unionByName(side("b")), right, "A")
    return reason.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {V.VAR} SELECT variant_id FROM var WHERE is_original")
def p13_originals(spark, sf_dir):
    return V.variants(spark, sf_dir).filter("is_original").select("variant_id")


@query("SELECT md5(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS h, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def w11_a23_first_wins(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("h"))
    return K.first_wins(rows, ["h"], "doc_id").select("h", "doc_id")


_SIG = """cv AS (SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'system'), '') AS s, coalesce(max_by(text, turn) FILTER (role = 'user'), '') AS u, coalesce(max_by(text, turn) FILTER (role = 'assistant'), '') AS a FROM conversations GROUP BY conv_id),
sq AS (SELECT conv_id, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS s, trim(regexp_replace(u, '\\s+', ' ', 'g')) AS u, trim(regexp_replace(a, '\\s+', ' ', 'g')) AS a FROM cv),
sig AS (SELECT conv_id, md5(to_json([s, u, a])) AS sig FROM sq)"""


def _signed(spark, sf_dir):
    return V.conversations(spark, sf_dir).select("conv_id", K.conversation_signature(F.col("conversation")).alias("sig"))


@query(f"WITH {_SIG} SELECT conv_id, sig FROM sig")
def f18_signature(spark, sf_dir):
    return _signed(spark, sf_dir)


@query("SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'assistant'), '') AS last_answer, coalesce(min_by(text, turn) FILTER (role = 'user'), '') AS first_question FROM conversations GROUP BY conv_id")
def f17_conversation_parts(spark, sf_dir):
    c = F.col("conversation")
    return V.conversations(spark, sf_dir).select("conv_id", K.last_of(c, "assistant").alias("last_answer"), K.first_of(c, "user").alias("first_question"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'microvqa' WHEN 1 THEN 'medxpertqa_mm' WHEN 2 THEN 'mmmu_pro' WHEN 3 THEN 'vqa_rad' ELSE 'unknown' END AS benchmark FROM documents")
def f19_benchmark(spark, sf_dir):
    marks = F.array(*map(F.lit, ("a MICROSCOPY image expert", "an expert medical professional", "multiple academic disciplines", "an expert radiologist", "plain")))
    said = F.concat("text", F.lit(" "), F.element_at(marks, (F.col("doc_id") % 5 + 1).cast("int")))
    return V.table(spark, sf_dir, "documents").select("doc_id", T.benchmark(said).alias("benchmark"))


@query(f"WITH {_SIG} SELECT min(conv_id) AS conv_id, sig FROM sig WHERE conv_id % 3 <> 0 AND conv_id % 7 <> 0 AND sig NOT IN (SELECT sig FROM sig WHERE conv_id % 3 = 0) GROUP BY sig")
def j4_signature_holdout(spark, sf_dir):
    rows = _signed(spark, sf_dir)
    return K.holdout(rows.filter("conv_id % 3 <> 0"), rows.filter("conv_id % 3 = 0"), F.col("conv_id") % 7 != 0, order="conv_id").select("conv_id", "sig")


@query(f"WITH {_SIG} SELECT conv_id % 2 AS class, count(*) AS n_before, count(*) FILTER (sig IN (SELECT sig FROM sig WHERE conv_id % 4 < 3)) AS n_after FROM sig GROUP BY ALL")
def j5_available_signatures(spark, sf_dir):
    rows = _signed(spark, sf_dir)
    return K.available(rows, rows.filter("conv_id % 4 < 3"), [(F.col("conv_id") % 2).alias("class")])


@query("WITH t AS (SELECT * FROM documents WHERE doc_id % 3 = 0), p AS (SELECT * FROM documents WHERE doc_id % 3 <> 0), r AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.lang = p.lang AND t.doc_id = p.doc_id - p.doc_id % 3) AND doc_id % 4 = 0 THEN 'uid' WHEN EXISTS (SELECT 1 FROM t WHERE t.lang = p.lang AND t.source = p.source) AND source <> 'src7' THEN 'qid' END AS reason FROM p) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY ALL")
def j3_train_overlap_anti(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    train = docs.filter("doc_id % 3 = 0").select(F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("unique_id"), F.col("source").alias("question_id"))
    pool = docs.filter("doc_id % 3 <> 0").select(F.col("lang").alias("dataset"), F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") - F.col("doc_id") % 3).cast("string")).otherwise(" ").alias("unique_id"), F.when(F.col("source") == "src7", "").otherwise(F.col("source")).alias("question_id"))
    marked = K.overlap_reason(train, pool)
    return marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, coalesce(u.v, q.v) AS images FROM documents d LEFT JOIN (SELECT doc_id, n_chars AS v FROM documents WHERE doc_id % 2 = 0) u ON u.doc_id = d.doc_id LEFT JOIN (SELECT lang, source, max_by(n_chars, doc_id) AS v FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL) q ON q.lang = d.lang AND q.source = d.source WHERE coalesce(u.v, q.v) IS NOT NULL")
def j2_attach_images(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("unique_id"), F.col("source").alias("question_id"), "n_chars")
    images = docs.filter("doc_id % 2 = 0").select("dataset", "unique_id", "question_id", F.col("doc_id").alias("src_ord"), F.array("n_chars").alias("images"))
    return K.attach_images(docs.drop("n_chars"), images).select("doc_id", F.col("images")[0].alias("images"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'all_examples' WHEN vec_id % 2 = 0 THEN 'contrastive' END AS store FROM embeddings")
def j7_store_precedence(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return K.with_fallback(e.select("vec_id"), "vec_id", ("all_examples", e.filter("vec_id % 3 = 0")), ("contrastive", e.filter("vec_id % 2 = 0"))).select("vec_id", "store")


@query("SELECT CASE WHEN vec_id % 3 = 0 THEN 'all_examples' WHEN vec_id % 2 = 0 THEN 'contrastive' ELSE 'none' END AS store, count(*) AS n FROM embeddings GROUP BY ALL")
def j7_store_counts(spark, sf_dir):
    return j7_store_precedence(spark, sf_dir).groupBy(F.coalesce("store", F.lit("none")).alias("store")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN n_chars END AS size FROM documents WHERE text IS NOT NULL")
def j13_p17_images_by_name(spark, sf_dir):
    """Rows without a text would raise; the image is found by the base name of a path."""
    docs = K.required(V.table(spark, sf_dir, "documents").filter("text IS NOT NULL"), "text")
    images = docs.filter("doc_id % 4 <> 1").select(F.concat(F.lit("p"), "doc_id", F.lit(".png")).alias("name"), F.col("n_chars").alias("image"))
    named = docs.withColumn("image_name", F.concat(F.lit("some/folder/p"), "doc_id", F.lit(".png")))
    return K.images_by_name(named, images).select("doc_id", F.col("image").alias("size"))


@query(f"WITH {V.VAR} SELECT dataset, variant_id, CASE WHEN l.quality = 1 THEN 'A' ELSE 'B' END AS predicted FROM var JOIN labels l ON l.doc_id::VARCHAR = variant_id")
def j9_label_lookup(spark, sf_dir):
    told = V.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("variant_id"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("predicted"))
    return V.variants(spark, sf_dir).join(told, "variant_id").select("dataset", "variant_id", "predicted")


@query("SELECT d.doc_id, coalesce(nullif(b.text, ''), string_split(d.text, chr(10))[1]) AS question FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def j11_question_text(spark, sf_dir):
    items = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("q"))
    return V.table(spark, sf_dir, "documents").join(items, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("q", F.lit("")), F.split("text", "\n")[0]).alias("question"))


@query(f"WITH {_SIG}, u AS (SELECT *, 0 AS p FROM sig WHERE conv_id % 2 = 0 UNION ALL SELECT *, 1 FROM sig WHERE conv_id % 2 = 1) SELECT sig, min_by(conv_id, p * 1000000 + conv_id) AS conv_id FROM u GROUP BY sig")
def j23_added_pair_samples(spark, sf_dir):
    rows = _signed(spark, sf_dir)
    return K.added(rows.filter("conv_id % 2 = 0"), rows.filter("conv_id % 2 = 1"), order="conv_id").select("sig", "conv_id")


@query("SELECT DISTINCT lang, source FROM documents WHERE doc_id % 2 = 0 UNION SELECT DISTINCT lang, source FROM documents WHERE n_chars > 1000")
def u1_u2_union_of_keys(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.filter("doc_id % 2 = 0").select("lang", "source").unionByName(d.filter("n_chars > 1000").select("lang", "source")).distinct()


@query("WITH a AS (SELECT DISTINCT lang, source FROM documents WHERE doc_id % 9 = 0), b AS (SELECT DISTINCT lang, source FROM documents WHERE doc_id % 7 = 0) SELECT *, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def u3_u4_common_and_missing(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    a, b = (d.filter(f"doc_id % {k} = 0").select("lang", "source").distinct() for k in (9, 7))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("first")))
