"""Queries over readers, sinks and cleaning; what they read back Spark has written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pairs as Pairs
from ..operators.storage import folder
from ..sources import questions as Q
from ..sources.json_array import read_json_array
from ..sources.store import read_store, write_store
from . import views as V
from .registry import query


def _questions(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("unique_id"), F.col("source").alias("question_id"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("category"), F.col("text").alias("question"), F.when(F.col("doc_id") % 3 != 0, F.lit("A. x")).alias("options"), F.when(F.col("doc_id") % 5 == 0, F.lit("")).when(F.col("doc_id") % 5 == 1, F.lit("not json")).otherwise(F.concat(F.lit('["'), F.base64(F.col("source").cast("binary")), F.lit('"]'))).alias("images"), F.lit("A").alias("ground_truth"))


@query("SELECT 'documents' AS dataset, doc_id AS src_ord, doc_id FROM documents WHERE doc_id < 100000000")
def s1_ordered_parquet(spark, sf_dir):
    return Q.read_parquet(spark, f"{sf_dir}/documents.parquet", "documents").select("dataset", F.col("src_ord").cast("long").alias("src_ord"), "doc_id")


@query("SELECT doc_id::VARCHAR AS unique_id, coalesce(CASE WHEN doc_id % 4 <> 0 THEN lang END, '') AS category, CASE WHEN doc_id % 3 <> 0 THEN 'A. x' ELSE '' END AS options, CASE WHEN doc_id % 5 < 2 THEN 0 ELSE 1 END AS n_images, CASE WHEN doc_id % 5 < 2 THEN NULL ELSE source END AS image, length(text) AS n_chars FROM documents")
def s6_s7_conform_and_clean(spark, sf_dir):
    path = folder(spark, "questions")
    Q.build(_questions(spark, sf_dir), path)
    rows = Q.cleaned(spark.read.parquet(path))
    return rows.select("unique_id", "category", "options", F.size("images").alias("n_images"), F.decode(F.try_element_at("images", F.lit(1)), "UTF-8").alias("image"), F.length("question").cast("long").alias("n_chars"))


@query("SELECT lang AS dataset, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def s2_s10_json_sink(spark, sf_dir):
    path = folder(spark, "json")
    Q.write_json(V.table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset"), "doc_id", "n_chars"), path)
    return Q.read_json_lines(spark, path, "dataset string, doc_id long, n_chars long").groupBy("dataset").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"WITH {V.ACT} SELECT 's' || vec_id AS sig, layer, len(vec) AS dims FROM act WHERE layer IN (1, 3) AND vec_id % 4 = 0 AND vec_id % 2 = 0")
def s11_s12_activation_store(spark, sf_dir):
    path = folder(spark, "store")
    act = V.activations(spark, sf_dir)
    write_store(act.select(F.when(F.col("vec_id") % 2 == 0, "with").otherwise("without").alias("mode"), "feature", F.concat(F.lit("s"), "vec_id").alias("sig"), "vec"), path)
    keys = V.table(spark, sf_dir, "embeddings").filter("vec_id % 4 = 0").select(F.concat(F.lit("s"), "vec_id").alias("sig"))
    found = read_store(spark, path, "with", [f"language_model/layer_{k}__mean" for k in (1, 3)], keys)
    return found.select("sig", T.layer(F.col("feature")).alias("layer"), F.size("vec").alias("dims"))


@query(f"WITH {V.RUNS}, m AS (SELECT feature, split_seed, round(avg(validation_accuracy), 4) AS v, round(avg(test_accuracy), 4) AS t FROM runs GROUP BY ALL) SELECT '0' || split_seed || '_probe' AS stage, CASE split_seed % 3 WHEN 0 THEN 'vqa_rad' WHEN 1 THEN 'mmmu_pro' ELSE 'all' END AS mode, 'ovis' AS model, feature, v AS validation_accuracy, t AS test_accuracy FROM m")
def s13_s14_s15_result_files(spark, sf_dir):
    rows = V.runs(spark, sf_dir).groupBy("feature", "split_seed").agg(F.round(F.avg("validation_accuracy"), 4).alias("validation_accuracy"), F.round(F.avg("test_accuracy"), 4).alias("test_accuracy"))
    row = F.struct("feature", "validation_accuracy", "test_accuracy")
    listed = rows.groupBy("split_seed").agg(F.collect_list(row).alias("l"))  # a row a feature: few
    short = lambda r: F.struct(r["validation_accuracy"].alias("validation_accuracy"), r["test_accuracy"].alias("test_accuracy"))
    payload = F.when(F.col("split_seed") % 3 == 0, F.to_json("l")).when(F.col("split_seed") % 3 == 1, F.to_json(F.struct(F.col("l").alias("feature_probe_accuracies")))).otherwise(F.to_json(F.map_from_entries(F.transform("l", lambda r: F.struct(r["feature"].alias("key"), short(r).alias("value"))))))
    mode = F.element_at(F.array(F.lit("vqa_rad"), F.lit("mmmu_pro"), F.lit("all")), (F.col("split_seed") % 3 + 1).cast("int"))
    path = folder(spark, "results")
    stage = F.concat(F.lit("0"), "split_seed", F.lit("_probe"))
    listed.select(payload.alias("value"), stage.alias("stage"), F.concat(F.lit("run_"), mode, F.lit("_ovis")).alias("run")).write.partitionBy("stage", "run").text(path)
    files = Q.result_files(spark, path, "*.txt").withColumn("path", F.regexp_replace(F.regexp_replace("path", "stage=", ""), "run=", ""))
    return Q.path_columns(Q.payload_rows(files)).select("stage", "mode", "model", "feature", "validation_accuracy", "test_accuracy")


_WORDS = r"""w0 AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), u0 AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM w0),
w AS (SELECT w0.doc_id, any_value(w0.w) AS w, list(x ORDER BY p) AS v FROM w0 JOIN (SELECT doc_id, x, min(p) AS p FROM u0 GROUP BY ALL) f ON f.doc_id = w0.doc_id GROUP BY w0.doc_id)"""


def _words(spark, sf_dir):
    """Documents with the first three different words of their texts, in lower case, and all words."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "source", w.alias("w"), F.array_distinct(w).alias("v"))
    return docs.filter(F.size("v") >= 3).select("*", *(F.col("v")[i].alias(f"w{i}") for i in range(3)))


@query(rf"WITH {_WORDS} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'A' ELSE 'B' END AS label, 3 AS n FROM w WHERE len(v) >= 3 AND (length(v[1]) > 1 AND length(v[2]) > 1 OR doc_id % 4 < 2)")
def f2_options_and_labels(spark, sf_dir):
    """Option lists in every form that a set may have, made from the words of each document, and their labels."""
    k, docs = F.col("doc_id") % 4, _words(spark, sf_dir)
    three = [F.col(f"w{i}") for i in range(3)]
    led = [F.concat(F.lit(f"{x}: "), c) for x, c in zip("ABC", three, strict=True)]
    raw = F.when(k == 0, F.to_json(F.struct(*(c.alias(x) for x, c in zip("ABC", three, strict=True))))).when(k == 1, F.to_json(F.array(*led))).when(k == 2, F.concat(F.lit("['"), F.array_join(F.array(*three), "', '"), F.lit("']"))).otherwise(F.to_json(F.array(*three)))
    answer = F.when(k == 0, "b").when(k == 1, led[2]).when(k == 2, F.concat(F.upper("w0"), F.lit("  "))).otherwise(F.col("w1"))
    docs = docs.withColumns({"raw": raw, "answer": answer}).filter("length(w0) > 1 AND length(w1) > 1 OR doc_id % 4 < 2")
    options = Q.choices(F.col("raw"))
    return docs.select("doc_id", Q.label_of(F.col("answer"), options).alias("label"), F.size(options).alias("n"))


@query(rf"WITH {_WORDS} SELECT d.doc_id, CASE d.doc_id % 4 WHEN 0 THEN a || '|' || b WHEN 1 THEN a || ' one|' || b WHEN 2 THEN 'Please what ' || source || '?|What ' || source || '? Please answer briefly.' ELSE array_to_string(w.w, ' ') || '|Please what ' || source || '?' END AS texts FROM documents d JOIN (SELECT *, v[1] AS a, v[2] AS b FROM w WHERE len(v) >= 3) w ON w.doc_id = d.doc_id")
def f13_rewrites(spark, sf_dir):
    """Model outputs in every form that rewrites come in, made from the words of each document."""
    k, docs = F.col("doc_id") % 4, _words(spark, sf_dir)
    question = F.concat(F.lit("What "), "source", F.lit("?"))
    fenced = F.concat(F.lit('ok:\n```json\n{"mutations": ["'), "w0", F.lit('", " '), "w1", F.lit(' ", "'), "w0", F.lit('"]}\n``` done'))
    said = F.when(k == 0, fenced).when(k == 1, F.concat(F.lit("1. "), "w0", F.lit(" one\n- "), "w1", F.lit("\n3) third"))).when(k == 2, "").otherwise(F.concat(F.array_join("w", " "), F.lit("\n"), question))
    return docs.select("doc_id", F.array_join(T.rewrites(said, question, 2), "|").alias("texts"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 4 END AS n_messages, text AS last FROM documents")
def f15_appended_turn(spark, sf_dir):
    k = F.col("doc_id")
    made = Pairs.conversation(F.when(k % 3 != 0, F.lit("be brief")), F.col("source"), F.lit(None).cast("string"), F.lit("yes"))
    longer = Pairs.appended(made, "user", F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(longer).alias("n_messages"), F.element_at(longer, -1)["content"][0]["text"].alias("last"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 3 END AS n_messages, doc_id % 2 = 0 AS has_image, CASE doc_id % 4 WHEN 0 THEN 'data:image/png;base64,iVBORw0KGgo=' WHEN 1 THEN 'data:image/jpeg;base64,/9j/4A==' WHEN 2 THEN 'data:image/gif;base64,R0lGODk=' ELSE 'data:image/bmp;base64,Qk0A' END AS url FROM documents")
def f15_f16_conversations_and_images(spark, sf_dir):
    k = F.col("doc_id")
    made = Pairs.conversation(F.when(k % 3 != 0, F.lit("be brief")), F.col("source"), F.when(k % 2 == 0, F.concat(F.lit("img_"), k)), F.lit("yes"))
    data = F.unhex(F.when(k % 4 == 0, "89504E470D0A1A0A").when(k % 4 == 1, "FFD8FFE0").when(k % 4 == 2, "4749463839").otherwise("424D00"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(made).alias("n_messages"), Pairs.has_image(made).alias("has_image"), T.data_url(data).alias("url"))


@query("WITH m AS (SELECT item_id AS k, unnest(range(2)) AS i FROM benchmark) SELECT b.item_id AS k, 'v' || b.item_id || '_' || i AS variant_id, text AS question FROM benchmark b JOIN m ON m.k = b.item_id")
def j12_s8_joined_rewrites(spark, sf_dir):
    items = V.table(spark, sf_dir, "benchmark")
    told = items.select(F.col("item_id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i"))
    enough = told.groupBy("k").agg(F.count("*").alias("n"))
    checked = told.join(enough, "k").filter(F.assert_true(F.col("n") >= 2, F.lit("too few rewrites")).isNull())
    return items.join(checked, items.item_id == checked.k).select("k", F.concat(F.lit("v"), "k", F.lit("_"), "i").alias("variant_id"), F.col("text").alias("question"))


@query(r"""WITH q AS (SELECT item_id AS k, CASE WHEN item_id % 4 = 0 THEN d.line ELSE text END AS question FROM benchmark JOIN (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS line FROM documents) d ON d.doc_id = item_id WHERE item_id < 20),
r AS (SELECT doc_id % 20 AS k, trim(string_split(text, chr(10))[1]) AS t, min(doc_id) AS first_at FROM documents GROUP BY ALL), f AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY first_at)::INT AS variant FROM r JOIN q USING (k) WHERE t <> '' AND t <> question)
SELECT k, question, variant, t AS rewrite FROM q JOIN f USING (k) WHERE variant <= 3""")
def j12_joined_rewrites(spark, sf_dir):
    """First lines of documents as rewrites of benchmark items: stripped, without repeats and copies of the question; too few would raise."""
    line = F.split("text", "\n")[0]
    docs = V.table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))
    items = V.table(spark, sf_dir, "benchmark").filter("item_id < 20").join(docs, F.col("item_id") == F.col("doc_id"))
    questions = items.select(F.col("item_id").alias("k"), F.when(F.col("item_id") % 4 == 0, F.trim("line")).otherwise(F.col("text")).alias("question"))
    rewrites = docs.select((F.col("doc_id") % 20).alias("k"), F.col("doc_id").alias("idx"), F.col("line").alias("text"))
    return Pairs.reused_rewrites(questions, rewrites, 3, key="k")


@query("SELECT doc_id, lang, text FROM documents")
def s3_json_arrays(spark, sf_dir):
    """Files of one JSON array each, a thousand ids a file."""
    path = folder(spark, "arrays")
    docs = V.table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 1000).alias("file"), F.struct("doc_id", "lang", "text").alias("row"))
    docs.groupBy("file").agg(F.to_json(F.collect_list("row")).alias("value")).write.partitionBy("file").text(path)
    return read_json_array(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", "text")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def s4_tab_separated(spark, sf_dir):
    path = folder(spark, "tsv")
    V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").write.option("sep", "\t").option("header", True).csv(path)
    return Q.read_tsv(spark, path, "doc_id long, lang string, source string, n_chars long")


@query("SELECT 'documents' AS dataset, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'failed:benchmark', 1")
def s8_named_sets(spark, sf_dir):
    """The sets that can be built, counted; one lacks a column and is listed as failed."""
    made = lambda name, *columns: lambda: Q.conformed(V.table(spark, sf_dir, name), columns)
    built, failed = Q.registered({"documents": made("documents", "doc_id", "text"), "pages": made("pages", "page_id", "html"), "benchmark": made("benchmark", "item_id", "missing")})
    counts = [df.groupBy().agg(F.lit(name).alias("dataset"), F.count("*").alias("n")) for name, df in built.items()]
    counts += [V.table(spark, sf_dir, name).groupBy().agg(F.lit(f"failed:{name}").alias("dataset"), F.count_distinct(F.lit(1)).alias("n")) for name in failed]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT doc_id, lang FROM documents WHERE n_chars > 500")
def s9_fallback_read(spark, sf_dir):
    """No clean copy at first, then one: the raw table is read once and the clean one after."""
    clean, raw = folder(spark, "clean"), f"{sf_dir}/documents.parquet"
    Q.build(_kept(Q.first_found(spark, clean, raw)), clean)
    return Q.first_found(spark, clean, raw).select(F.col("unique_id").cast("long").alias("doc_id"), F.col("category").alias("lang"))


def _kept(docs):
    rows = docs.filter("n_chars > 500")
    return rows.select(F.col("doc_id").cast("string").alias("unique_id"), F.col("source").alias("question_id"), F.col("lang").alias("category"), F.col("text").alias("question"), F.lit("").alias("options"), F.array().cast("array<binary>").alias("images"), F.lit("").alias("ground_truth"))


@query("SELECT vec_id % 5 = 0 OR vec_id % 3 = 0 AS mismatch, count(*) AS n FROM embeddings GROUP BY ALL")
def s12_store_mismatches(spark, sf_dir):
    kind = F.when(F.col("vec_id") % 3 == 0, "other").otherwise("mean")
    store = V.table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 5 != 0, "models/a").alias("model_path"), kind.alias("cache_type"))
    return Q.store_mismatches(store, "models/a", "mean")


@query("SELECT 'overall' AS part, count(*) AS n FROM documents UNION ALL SELECT 'summary', count(DISTINCT lang) FROM documents UNION ALL SELECT 'metadata', count(*) FROM documents UNION ALL SELECT 'datasets', count(*) FROM documents")
def s10_result_folder(spark, sf_dir):
    path = folder(spark, "results")
    rows = V.table(spark, sf_dir, "documents").select(F.col("lang").alias("dataset"), "doc_id", "text")
    Q.write_results(rows, rows.groupBy("dataset").agg(F.count("*").alias("n")), {"model": "a", "setting": "b"}, path)
    row, n = "dataset string, doc_id long, text string", F.count("*").alias("n")
    parts = [Q.read_json_lines(spark, f"{path}/{p}", row).groupBy().agg(F.lit(p).alias("part"), n) for p in ("overall", "datasets")]
    parts.append(Q.read_json_lines(spark, f"{path}/summary", "dataset string, n long").groupBy().agg(F.lit("summary").alias("part"), n))
    parts.append(Q.read_json_lines(spark, f"{path}/metadata", "n_rows long, model string").groupBy().agg(F.lit("metadata").alias("part"), F.sum("n_rows").alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT s_suppkey, s_nationkey % 4 <> 0 AS has_config FROM supplier")
def j18_sibling_config(spark, sf_dir):
    """Result files with the first configuration of their folder."""
    from ..operators.reports import with_config

    s = V.table(spark, sf_dir, "supplier")
    folder = F.concat(F.lit("runs/"), "s_nationkey")
    files = s.select("s_suppkey", F.concat(folder, F.lit("/result_"), "s_suppkey", F.lit(".json")).alias("path"))
    configs = s.filter("s_nationkey % 4 <> 0").select(F.concat(folder, F.lit("/config_"), "s_suppkey", F.lit(".json")).alias("path"))
    return with_config(files, configs).select("s_suppkey", F.col("config_path").isNotNull().alias("has_config"))
