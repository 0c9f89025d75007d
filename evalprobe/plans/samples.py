"""Queries over sampling, splits, metrics, text confounds, vectors and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import confounds as C
from ..operators import keys as K
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators import splits as P
from ..operators import vectors as X
from ..operators.storage import folder
from ..sources.store import open_store, write_store
from . import views as V
from .registry import query

#: Pairs that a balanced sample aims at.
PAIRS = 500

_COUNTS = "cc AS (SELECT dataset, count(*) FILTER (label = 0) AS class0, count(*) FILTER (label = 1) AS class1, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS pair_cap FROM ex GROUP BY dataset)"


def _largest(target: int, floor: int = 0) -> str:
    """Largest remainder over cc in SQL."""
    return f"""c0 AS (SELECT * FROM cc WHERE pair_cap >= greatest({floor}, 1)),
c1 AS (SELECT *, least({target}, sum(pair_cap) OVER ()) - {floor} * count(*) OVER () AS t, sum(pair_cap - {floor}) OVER () AS spare FROM c0),
c2 AS (SELECT *, CASE WHEN t > 0 AND spare > 0 THEN (t * (pair_cap - {floor}))::DOUBLE / spare ELSE 0 END AS raw, greatest(t, 0) AS tt FROM c1),
c3 AS (SELECT *, floor(raw)::BIGINT AS low, row_number() OVER (ORDER BY raw - floor(raw) DESC, dataset) AS rk, tt - sum(floor(raw)) OVER () AS left_over FROM c2),
alloc AS (SELECT dataset, pair_cap, (low + {floor} + CASE WHEN rk <= left_over AND low + {floor} < pair_cap THEN 1 ELSE 0 END)::BIGINT AS n FROM c3)"""


@query(f"WITH {V.EX}, {_COUNTS} SELECT * FROM cc")
def a4_class_counts(spark, sf_dir):
    return S.class_counts(V.examples(spark, sf_dir))


@query(f"WITH {V.EX}, {_COUNTS}, {_largest(30)} SELECT dataset, pair_cap, n FROM alloc")
def w14_largest_remainder(spark, sf_dir):
    return S.largest_remainder(S.class_counts(V.examples(spark, sf_dir)), 30).select("dataset", "pair_cap", "n")


@query(f"WITH {V.EX}, {_COUNTS}, {_largest(30, 3)} SELECT dataset, pair_cap, n FROM alloc")
def w15_allocation_with_floor(spark, sf_dir):
    return S.with_floor(S.class_counts(V.examples(spark, sf_dir)), 30).select("dataset", "pair_cap", "n")


_SAMPLE = f"{V.EX}, {_COUNTS}, {_largest(500, 3)}, sm AS (SELECT * EXCLUDE (rn, n) FROM (SELECT ex.*, n, row_number() OVER (PARTITION BY ex.dataset, label ORDER BY md5('42:' || unique_id), unique_id) AS rn FROM ex JOIN alloc USING (dataset)) WHERE rn <= n)"


def _sample(spark, sf_dir):
    """A balanced sample of labelled documents: ids, no texts."""
    ex = V.examples(spark, sf_dir).drop("text")
    return S.sample_by_plan(ex, S.with_floor(S.class_counts(ex), PAIRS), 42, ["dataset"], "unique_id", ["label"], most=PAIRS)


def texts(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unique_id"), "text")


@query(f"WITH {_SAMPLE} SELECT dataset, label, unique_id FROM sm")
def w3_balanced_sample(spark, sf_dir):
    return _sample(spark, sf_dir).select("dataset", "label", "unique_id")


@query(f"WITH {V.EX} SELECT dataset, question_id, label, unique_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, question_id, label ORDER BY md5('7:' || unique_id), unique_id) AS rn FROM ex) WHERE rn = 1")
def w2_one_per_question_and_label(spark, sf_dir):
    return S.first_n(V.examples(spark, sf_dir), ["dataset", "question_id", "label"], 1, S.draw(7, "unique_id"), "unique_id").select("dataset", "question_id", "label", "unique_id")


def _by_class_sql(rows: str, buckets: str, seed: str = "'1'") -> str:
    return f"(SELECT *, CASE WHEN rn <= CASE WHEN greatest(1, round_even(n_ * 0.2::DOUBLE, 0)) >= n_ THEN greatest(1, n_ - 1) ELSE greatest(1, round_even(n_ * 0.2::DOUBLE, 0)) END THEN 'test' ELSE 'train' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY {buckets}) AS n_, row_number() OVER (PARTITION BY {buckets} ORDER BY md5({seed} || ':' || unique_id), unique_id) AS rn FROM {rows}))"


@query(f"WITH {V.EX} SELECT unique_id, part FROM {_by_class_sql('ex', 'label')}")
def w4_split_by_class(spark, sf_dir):
    return P.by_class(V.examples(spark, sf_dir), "unique_id", 1).select("unique_id", "part")


_SIZES = "greatest(1, round_even(n_ * 0.1::DOUBLE, 0))::INT AS v0, greatest(1, round_even(n_ * 0.2::DOUBLE, 0))::INT AS t0"


@query(f"""WITH {V.EX}, b AS (SELECT *, count(*) OVER (PARTITION BY label, dataset) AS n_, row_number() OVER (PARTITION BY label, dataset ORDER BY md5('1:' || unique_id), unique_id) AS rn FROM ex),
s AS (SELECT *, {_SIZES} FROM b WHERE n_ >= 3), o AS (SELECT *, greatest(0, v0 + t0 - (n_ - 1)) AS over_ FROM s),
z AS (SELECT *, t0 - least(over_, t0 - 1) AS t, v0 - (over_ - least(over_, t0 - 1)) AS v FROM o)
SELECT unique_id, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'val' ELSE 'train' END AS part FROM z""")
def w5_class_dataset_split(spark, sf_dir):
    return P.three_way(V.examples(spark, sf_dir), ["label", "dataset"], "unique_id", 1).select("unique_id", "part")


@query(f"""WITH {V.EX}, b AS (SELECT *, count(*) OVER (PARTITION BY label) AS n_, row_number() OVER (PARTITION BY label ORDER BY md5('1:' || unique_id), unique_id) AS rn FROM ex),
s AS (SELECT *, {_SIZES} FROM b WHERE n_ >= 3), o AS (SELECT *, greatest(0, v0 + t0 - (n_ - 1)) AS over_ FROM s),
z AS (SELECT *, v0 - least(over_, v0 - 1) AS v, t0 - (over_ - least(over_, v0 - 1)) AS t FROM o)
SELECT unique_id, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'val' ELSE 'train' END AS part FROM z""")
def w5_class_split(spark, sf_dir):
    """By class alone; where a part must shrink, validation goes first."""
    return P.three_way(V.examples(spark, sf_dir), ["label"], "unique_id", 1, shrink_test_first=False).select("unique_id", "part")


def _pairs(spark, sf_dir):
    return V.pairs(spark, sf_dir).select("dataset", F.concat("dataset", F.lit(":"), "question_id").alias("pair"))


def _pair_sql(by: str, size: str) -> str:
    return f"WITH {V.PAIRS}, r AS (SELECT dataset || ':' || question_id AS pair, dataset, row_number() OVER ({by} ORDER BY md5('3:' || dataset || ':' || question_id), dataset || ':' || question_id) AS rn, count(*) OVER ({by}) AS n_ FROM pairs) SELECT pair, CASE WHEN rn <= {size} THEN 'val' ELSE 'train' END AS part FROM r"


@query(_pair_sql("", "8"))
def w6_fixed_pair_validation(spark, sf_dir):
    return P.pair_validation(_pairs(spark, sf_dir), "pair", 3, fixed=8).select("pair", "part")


@query(_pair_sql("PARTITION BY dataset", "3"))
def w7_pairs_per_benchmark(spark, sf_dir):
    return P.pair_validation(_pairs(spark, sf_dir), "pair", 3, per="dataset", count=3).select("pair", "part")


@query(f"WITH {V.PAIRS}, p3 AS (SELECT * FROM pairs WHERE dataset <> 'en'), r AS (SELECT dataset || ':' || question_id AS pair, row_number() OVER (PARTITION BY dataset ORDER BY md5('3:' || dataset || ':' || question_id), dataset || ':' || question_id) AS rn FROM p3) SELECT pair, CASE WHEN rn <= 3 THEN 'val' ELSE 'train' END AS part FROM r")
def w7_of_exactly_three_benchmarks(spark, sf_dir):
    """As many pairs of each of three benchmarks; another number of benchmarks raises."""
    pairs = _pairs(spark, sf_dir).filter("dataset <> 'en'")
    return P.pair_validation(pairs, "pair", 3, per="dataset", count=3, benchmarks=3).select("pair", "part")


@query(_pair_sql("PARTITION BY dataset", "least(greatest(1, round_even(n_ * 0.2::DOUBLE, 0)), n_ - 1)"))
def w8_pair_fraction_validation(spark, sf_dir):
    return P.pair_validation(_pairs(spark, sf_dir), "pair", 3, per="dataset", fraction=0.2).select("pair", "part")


@query(f"WITH {V.EX}, g AS (SELECT group_id, row_number() OVER (ORDER BY md5('5:' || group_id), group_id) AS rn, count(*) OVER () AS n_ FROM (SELECT DISTINCT group_id FROM ex)) SELECT unique_id, CASE WHEN rn <= greatest(1, round_even(n_ * 0.2::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS part FROM ex JOIN g USING (group_id)")
def w9_group_split(spark, sf_dir):
    return P.by_group(V.examples(spark, sf_dir), "group_id", 5).select("unique_id", "part")


@query(f"WITH {V.RUNS}, b AS (SELECT *, row_number() OVER (PARTITION BY feature, split_seed, c_value ORDER BY validation_accuracy DESC, train_accuracy DESC, init_index) AS rn FROM runs), c AS (SELECT *, row_number() OVER (PARTITION BY feature, split_seed ORDER BY validation_accuracy DESC, c_value) AS rc FROM b WHERE rn = 1) SELECT feature, split_seed, c_value, init_index, validation_accuracy FROM c WHERE rc = 1")
def w12_best_probe(spark, sf_dir):
    from ..operators.probes import selected

    return selected(V.runs(spark, sf_dir)).select("feature", "split_seed", "c_value", "init_index", "validation_accuracy")


@query(f"WITH {V.RUNS}, s AS (SELECT DISTINCT split_seed FROM runs), e AS (SELECT n_nationkey AS eval_seed FROM nation), a AS (SELECT eval_seed, (row_number() OVER (ORDER BY eval_seed) - 1) % (SELECT count(*) FROM s) AS i FROM e), b AS (SELECT split_seed, row_number() OVER (ORDER BY split_seed) - 1 AS i FROM s) SELECT eval_seed, split_seed FROM a JOIN b USING (i)")
def w13_round_robin(spark, sf_dir):
    seeds = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("eval_seed"))
    return P.round_robin(seeds, V.runs(spark, sf_dir).select("split_seed").distinct(), "eval_seed", "split_seed").select("eval_seed", "split_seed")


@query(f"WITH {V.EX}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY src_ord) AS rn, count(*) OVER (PARTITION BY dataset) AS size FROM ex), o AS (SELECT *, row_number() OVER (ORDER BY rn, size - rn + 1 DESC, dataset) AS k FROM r) SELECT dataset, unique_id FROM o WHERE k <= 150")
def w16_equal_share(spark, sf_dir):
    return S.equal_share(V.examples(spark, sf_dir), "dataset", 150, "src_ord").select("dataset", "unique_id")


@query(f"WITH {V.EX} SELECT unique_id FROM (SELECT *, row_number() OVER (ORDER BY (quality = 0)::INT, md5('9:' || src_ord), src_ord) AS rn FROM ex WHERE label = 0) WHERE rn <= 60")
def w17_class_quota(spark, sf_dir):
    rows = V.examples(spark, sf_dir).filter("label = 0").withColumn("is_neutral", F.col("quality") == 0)
    return S.class_quota(rows, 60, 9).select("unique_id")


@query(f"WITH {V.EX} SELECT label, unique_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY src_ord) AS rn FROM ex) WHERE rn <= CASE WHEN label = 1 THEN 20 ELSE 21 END")
def w18_class_targets(spark, sf_dir):
    """Targets of 30 and 60 rows, 41 in all: class 1 gets half, class 0 what is left."""
    return S.class_head(V.examples(spark, sf_dir), {1: 30, 0: 60}, "src_ord", total=41).select("label", "unique_id")


@query("WITH r AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'mean' ELSE 'last' END AS strategy, l_linenumber::INT AS layer, l_linestatus, l_orderkey % 3 AS i, avg(l_discount::DOUBLE) AS v FROM lineitem GROUP BY ALL) SELECT strategy, layer, round(max(v), 6) AS top FROM r GROUP BY ALL")
def w19_layer_curve(spark, sf_dir):
    """The best value of each strategy at each layer, read from the names of the features."""
    items = V.table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("language_model/layer_"), F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "N", "__mean").otherwise("__last"))
    runs = items.groupBy(name.alias("feature"), "l_linestatus", (F.col("l_orderkey") % 3).alias("i")).agg(F.avg(F.col("l_discount").cast("double")).alias("v"))
    return runs.groupBy(T.strategy(F.col("feature")).alias("strategy"), T.layer(F.col("feature")).alias("layer")).agg(F.round(F.max("v"), 6).alias("top"))


@query(f"WITH {V.RUNS} SELECT feature, split_seed, c_value, i AS init_index, split_seed + 100003 * i + round_even(10000 * c_value, 0)::BIGINT AS init_seed FROM (SELECT DISTINCT feature, split_seed, c_value FROM runs), (VALUES (0), (1), (2)) AS t(i)")
def w20_j20_run_grid(spark, sf_dir):
    runs = V.runs(spark, sf_dir).select("feature", "split_seed", "c_value").distinct().withColumn("init_index", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return runs.withColumn("init_seed", F.col("split_seed") + 100003 * F.col("init_index") + F.bround(10000 * F.col("c_value")).cast("long"))


_RIGHT = "(src_ord % 3 <> label)::INT"


@query(f"WITH {V.EX} SELECT coalesce(nullif(trim(dataset), ''), 'unknown') AS bench, label AS class, count(*) AS n, round(avg({_RIGHT}), 6) AS accuracy FROM ex GROUP BY GROUPING SETS ((), (class), (bench), (bench, class))")
def a5_accuracy_grouping_sets(spark, sf_dir):
    return M.accuracies(V.examples(spark, sf_dir), F.col("src_ord") % 3 != F.col("label"))


@query(f"WITH {V.RUNS} SELECT feature, c_value, count(*) AS n_runs, round(avg(validation_accuracy), 6) AS validation_accuracy_mean, round(stddev_pop(validation_accuracy), 6) AS validation_accuracy_std FROM runs GROUP BY ALL")
def a6_seed_aggregates(spark, sf_dir):
    return M.over_seeds(V.runs(spark, sf_dir), ["feature", "c_value"], "validation_accuracy")


@query(f"WITH {V.RUNS}, m AS (SELECT feature, split_seed, avg(test_accuracy) AS a FROM runs GROUP BY ALL) SELECT feature, round(avg(a), 6) AS macro, count(*) AS n_keys FROM m GROUP BY feature")
def a7_a8_map_means(spark, sf_dir):
    maps = V.runs(spark, sf_dir).select("feature", F.create_map(F.col("split_seed").cast("string"), F.col("test_accuracy").cast("string")).alias("by_bench"))
    return M.map_means(maps, ["feature"], "by_bench").select("feature", F.round("macro", 6).alias("macro"), F.size("means").cast("long").alias("n_keys"))


@query(f"WITH {V.RUNS}, n AS (SELECT feature, init_index, c_value, count(*) AS k FROM runs WHERE validation_accuracy > 0.05 GROUP BY ALL) SELECT feature, init_index, arg_min(c_value, (-k, c_value)) AS c_value FROM n GROUP BY ALL")
def a9_modal_penalty(spark, sf_dir):
    return M.modal(V.runs(spark, sf_dir).filter("validation_accuracy > 0.05"), ["feature", "init_index"], "c_value")


_PHRASES = {"one": ["the ", " of "], "two": ["que", "der"], "three": ["zzzq", "12"]}


def _phrase_sql() -> str:
    squeezed = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
    rows = " UNION ALL ".join(f"SELECT dataset, label, '{g}' AS phrase, ({' OR '.join(f'contains({squeezed}, {chr(39)}{p}{chr(39)})' for p in ps)})::INT AS h FROM ex" for g, ps in _PHRASES.items())
    return f"WITH {V.EX}, h AS ({rows}) SELECT dataset, phrase, round(avg(h) FILTER (label = 0), 6) AS rate0, round(avg(h) FILTER (label = 1), 6) AS rate1, round(coalesce(avg(h) FILTER (label = 1), 0) - coalesce(avg(h) FILTER (label = 0), 0), 6) AS skew FROM h GROUP BY ALL"


@query(_phrase_sql())
def a10_phrase_rates(spark, sf_dir):
    found = C.phrase_rates(V.examples(spark, sf_dir), _PHRASES, ["dataset"])
    return found.select("dataset", "phrase", *(F.round(c, 6).alias(c) for c in ("rate0", "rate1", "skew")))


@query(f"SELECT * FROM ({_phrase_sql()}) ORDER BY abs(skew) DESC, phrase, dataset LIMIT 5")
def o1_top_phrases(spark, sf_dir):
    return a10_phrase_rates(spark, sf_dir).orderBy(F.desc(F.abs("skew")), "phrase", "dataset").limit(5)


_WINDOWS = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"


@query(rf"""WITH {V.EX}, b AS (SELECT item_id, string_split_regex(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') AS w FROM benchmark), ph AS (SELECT DISTINCT item_id AS phrase, unnest({_WINDOWS}) AS p FROM b),
sq AS (SELECT src_ord, label, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM ex), hit AS (SELECT DISTINCT phrase, src_ord, label FROM ph JOIN sq ON contains(t, p)), n AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM ex),
c AS (SELECT i.item_id AS phrase, count(*) FILTER (label = 0) AS h0, count(*) FILTER (label = 1) AS h1 FROM benchmark i LEFT JOIN hit ON hit.phrase = i.item_id GROUP BY ALL) SELECT phrase, round(h0 / n0, 6) AS rate0, round(h1 / n1, 6) AS rate1 FROM c, n""")
def a10_f24_phrase_table(spark, sf_dir):
    """Each benchmark item as a group of phrases, its three-word windows: thousands of phrases, one pass over the texts."""
    w = F.split(F.lower(T.squeeze(F.col("text"))), " ")
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))
    phrases = V.table(spark, sf_dir, "benchmark").filter(F.size(w) > 2).select(F.col("item_id").alias("group"), F.explode(windows).alias("phrase"))
    return C.phrase_rates_of_table(V.examples(spark, sf_dir), phrases).select("phrase", F.round("rate0", 6).alias("rate0"), F.round("rate1", 6).alias("rate1"))


_TOK = r"regexp_extract_all(lower(text), '[A-Za-z0-9_\[\]]+')"


@query(rf"WITH {V.EX} SELECT dataset, label, count(*) AS n, round(avg(len({_TOK})), 6) AS mean_tokens, median(len({_TOK})) AS median_tokens, round(avg(regexp_matches(text, '(?m)^\s*(?:[-*]\s*)?(?:[A-E][.)]|\([A-E]\))\s+')::INT), 6) AS option_rate, round(avg(regexp_matches(text, '\[\[\s*([^\]]+?)\s*\]\]')::INT), 6) AS bracket_rate FROM ex GROUP BY ALL")
def a11_text_summary(spark, sf_dir):
    return C.text_summary(V.examples(spark, sf_dir), ["dataset", "label"])


@query(f"WITH {V.EX}, a AS (SELECT dataset, lower(string_split(text, chr(10))[1]) AS answer, src_ord FROM ex), n AS (SELECT dataset, answer, count(*) AS n, min(src_ord) AS seen FROM a WHERE answer <> '' GROUP BY ALL) SELECT dataset, answer, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, seen)::INT AS rank FROM n) WHERE rank <= 10")
def a12_frequent_answers(spark, sf_dir):
    rows = V.examples(spark, sf_dir).withColumn("answer", F.lower(F.split("text", "\n")[0]))
    return C.frequent_answers(rows, ["dataset"], "answer", "src_ord")


_DF = f"t AS (SELECT label, {_TOK} AS t FROM ex), g AS (SELECT label, unnest(list_distinct(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram FROM t), df AS (SELECT gram, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM g GROUP BY gram)"
_ODDS = f"{V.EX}, {_DF}, z AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM ex), o AS (SELECT gram, c0, c1, round(ln(((c1 + 0.5::DOUBLE) / (n1 + 1)) / (1 - (c1 + 0.5::DOUBLE) / (n1 + 1))) - ln(((c0 + 0.5::DOUBLE) / (n0 + 1)) / (1 - (c0 + 0.5::DOUBLE) / (n0 + 1))), 6) AS log_odds FROM df, z WHERE length(gram) > 1 AND NOT regexp_matches(gram, '^[0-9]+$') AND c0 + c1 >= greatest(4, floor(0.02::DOUBLE * (n0 + n1))))"


@query(f"WITH {V.EX}, {_DF} SELECT * FROM df")
def a13_document_frequency(spark, sf_dir):
    return C.document_frequency(V.examples(spark, sf_dir))


@query(f"WITH {_ODDS} SELECT * FROM o")
def a14_ngram_log_odds(spark, sf_dir):
    return C.log_odds(V.examples(spark, sf_dir))


@query(f"WITH {_ODDS} SELECT * FROM (SELECT gram, c0, c1, log_odds, 1 AS label FROM o ORDER BY log_odds DESC, gram DESC LIMIT 12) UNION ALL SELECT * FROM (SELECT gram, c0, c1, log_odds, 0 AS label FROM o ORDER BY -log_odds DESC, gram DESC LIMIT 12)")
def o2_top_ngrams(spark, sf_dir):
    return C.top_grams(C.log_odds(V.examples(spark, sf_dir))).drop("score")


_CORR = "CASE WHEN count(*) >= 2 AND var_pop({0}) > 1e-12 AND var_pop({1}) > 1e-12 THEN round(corr({0}, {1}), 6) END"


@query(f"WITH {V.PHI} SELECT dataset, round(corr(with_q - with_null, mirage), 6) AS r FROM phi GROUP BY dataset")
def a16_correlation(spark, sf_dir):
    return V.phi(spark, sf_dir).groupBy("dataset").agg(F.round(M.correlation(F.col("with_q") - F.col("with_null"), F.col("mirage").cast("double")), 6).alias("r"))


_AUC = "(SELECT round(sum(CASE WHEN p.s > n.s THEN 1.0::DOUBLE WHEN p.s = n.s THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) FROM sc p JOIN sc n ON p.dataset = n.dataset AND p.y = 1 AND n.y = 0 WHERE p.dataset = d.dataset)"


@query(f"WITH {V.PHI}, sc AS (SELECT dataset, round(with_q - with_null, 1) AS s, mirage AS y FROM phi) SELECT dataset, {_AUC} AS auc FROM (SELECT DISTINCT dataset FROM sc) d")
def a17_auc_rank(spark, sf_dir):
    rows = V.phi(spark, sf_dir).select("dataset", F.round(F.col("with_q") - F.col("with_null"), 1).alias("s"), F.col("mirage").alias("y"))
    return M.auc(rows, ["dataset"], "s", "y").select("dataset", F.round("auc", 6).alias("auc"))


@query(f"WITH {V.PHI} SELECT unique_id, with_q - with_null AS phi_with, without_q - without_null AS phi_without FROM phi")
def f26_prior_index(spark, sf_dir):
    return V.phi(spark, sf_dir).select("unique_id", (F.col("with_q") - F.col("with_null")).alias("phi_with"), (F.col("without_q") - F.col("without_null")).alias("phi_without"))


@query(f"""WITH {V.PHI}, b AS (SELECT unique_id, dataset, with_q - with_null AS s, mirage AS y FROM phi), sc AS (SELECT dataset, s, y FROM b UNION ALL SELECT 'all', s, y FROM b)
SELECT d.dataset, count(*) AS n, count(*) FILTER (y = 1) AS n_mirage, round(avg(s) FILTER (y = 1), 6) AS mean_mirage, round(avg(s) FILTER (y = 0), 6) AS mean_other, round(corr(s, y), 6) AS r, {_AUC} AS auc FROM sc d GROUP BY d.dataset""")
def a18_m11_prior_summary(spark, sf_dir):
    from ..operators.prior import summary

    rows = V.phi(spark, sf_dir).select("dataset", (F.col("with_q") - F.col("with_null")).alias("s"), F.col("mirage").alias("y"))
    return summary(rows, "s", "y")


_CHAIN = f"""{V.EX}, h AS (SELECT *, row_number() OVER (PARTITION BY md5(regexp_replace(trim(text), '\\s+', ' ', 'g')) ORDER BY src_ord) AS rn_h FROM ex),
u AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY src_ord) AS rn_l FROM h WHERE rn_h = 1),
ch AS (SELECT dataset, unique_id, label, length(text) / 1000.0::DOUBLE AS s, nullif(trim(question_id), '') AS target FROM u WHERE rn_l <= CASE WHEN label = 1 THEN 150 ELSE 300 END)"""


def _prior_chain(spark, sf_dir):
    """First of equal texts, then the head of both classes by targets, with image and target token."""
    rows = V.examples(spark, sf_dir)
    once = K.first_wins(rows.select("src_ord", "dataset", "label", "unique_id", "question_id", F.length("text").alias("size"), F.md5(T.squeeze(F.col("text"))).alias("h")), ["h"], "src_ord")
    head = S.class_head(once, {1: 150, 0: 300}, "src_ord", total=450)
    images = rows.select("dataset", "unique_id", "question_id", "src_ord", F.array("quality").alias("images"))
    placed = K.attach_images(head, images)
    return placed.select("dataset", "unique_id", "label", (F.col("size") / 1000.0).alias("s"), T.target_token(F.lit("open"), F.col("question_id")).alias("target"))


@query(f"WITH {_CHAIN} SELECT * FROM ch")
def m11_prior_rows(spark, sf_dir):
    return _prior_chain(spark, sf_dir)


@query(f"""WITH {_CHAIN}, sc AS (SELECT dataset, s, label AS y FROM ch UNION ALL SELECT 'all', s, label FROM ch)
SELECT d.dataset, count(*) AS n, count(*) FILTER (y = 1) AS n_mirage, round(avg(s) FILTER (y = 1), 6) AS mean_mirage, round(avg(s) FILTER (y = 0), 6) AS mean_other, round(corr(s, y), 6) AS r, {_AUC} AS auc FROM sc d GROUP BY d.dataset""")
def m11_prior_pipeline(spark, sf_dir):
    """The whole chain to its summary: dedupe, class targets, images, target tokens, counts, correlation and AUC."""
    from ..operators.prior import summary

    return summary(_prior_chain(spark, sf_dir).select("dataset", "s", F.col("label").alias("y")), "s", "y")


@query(f"WITH {V.ACT} SELECT vec_id, {V.told_sql('v')} AS vec FROM (SELECT vec_id, flatten(list(vec ORDER BY layer)) AS v FROM act GROUP BY vec_id)")
def f32_vector_concat(spark, sf_dir):
    return X.concatenated(V.activations(spark, sf_dir), ["vec_id"]).select("vec_id", V.told().alias("vec"))


_HALVES = f"p AS (SELECT a.vec_id // 2 AS sample, a.feature, a.vec AS x, b.vec AS y FROM act a JOIN act b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1 AND a.feature = b.feature)"


def _halves(spark, sf_dir):
    act = V.activations(spark, sf_dir).withColumn("sample", F.floor(F.col("vec_id") / 2))
    return (act.filter(F.col("vec_id") % 2 == k).select("sample", "feature", "vec") for k in (0, 1))


@query(f"WITH {V.ACT}, {_HALVES} SELECT sample, feature, {V.told_sql('list_transform(list_zip(x, y), lambda z: z[1] - z[2])')} AS diff, {V.told_sql('x || y')} AS both FROM p")
def j14_f32_vector_difference(spark, sf_dir):
    return X.aligned(*_halves(spark, sf_dir), ["sample", "feature"]).select("sample", "feature", V.told("diff").alias("diff"), V.told("both").alias("both"))


@query(f"WITH {V.ACT}, o AS (SELECT vec_id // 2 AS sample, feature, count(*) FILTER (vec_id % 2 = 0) AS a, count(*) FILTER (vec_id % 2 = 1 AND vec_id % 3 <> 0) AS b FROM act GROUP BY ALL) SELECT feature, count(*) FILTER (a > 0 AND b > 0) AS both, count(*) FILTER (a > 0 AND b = 0) AS first_only, count(*) FILTER (a = 0 AND b > 0) AS second_only FROM o GROUP BY feature")
def j14_unmatched_sides(spark, sf_dir):
    one, two = _halves(spark, sf_dir)
    kept = V.activations(spark, sf_dir).filter("vec_id % 2 = 1 AND vec_id % 3 <> 0").select(F.floor(F.col("vec_id") / 2).alias("sample"), "feature")
    return X.alignment(one, two.join(kept, ["sample", "feature"], "left_semi"), ["sample", "feature"], ["feature"])


@query(f"WITH {V.ACT} SELECT vec_id, feature, {V.told_sql('vec')} AS vec FROM act WHERE layer % 2 = 1")
def p16_j6_s11_feature_selection(spark, sf_dir):
    """Vectors of the features that the flags ask for, from the keyed store, for all signatures; one that is missing raises."""
    path = folder(spark, "store")
    act = V.activations(spark, sf_dir)
    more = act.withColumn("feature", F.replace("feature", F.lit("__"), F.lit("/mlp__")))
    every = act.unionByName(more).unionByName(act.withColumn("feature", F.replace("feature", F.lit("__mean"), F.lit("__last"))))
    write_store(every.select(F.lit("with").alias("mode"), "feature", F.col("vec_id").cast("string").alias("sig"), "vec"), path)
    store = open_store(spark, path).filter((F.col("mode") == "with") & X.requested(F.col("feature"), ("mean", "last"), strategies="mean", odd_layers=True))
    wanted = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("sig"))
    return X.looked_up(wanted, store.select("sig", "feature", "vec"), "sig").select(F.col("sig").cast("long").alias("vec_id"), "feature", V.told().alias("vec"))


@query("WITH t AS (SELECT doc_id, unnest(w) AS w FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents)) SELECT doc_id, round(coalesce(avg(length(w)) FILTER (length(w) > 3), 0), 6) AS mean_length, round(coalesce(avg(ascii(w)) FILTER (length(w) > 3), 0), 6) AS mean_code FROM t GROUP BY doc_id")
def a19_masked_pooling(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("w"))
    tokens = tokens.select("doc_id", (F.length("w") > 3).alias("m"), F.array(F.length("w").cast("double"), F.ascii("w").cast("double")).alias("vec"))
    pooled = X.pooled(tokens, ["doc_id"], F.col("m"), 2)
    return pooled.select("doc_id", F.round(F.col("vec")[0], 6).alias("mean_length"), F.round(F.col("vec")[1], 6).alias("mean_code"))


@query(f"WITH {V.ACT}, e AS (SELECT feature, vec_id, unnest(range(1, 17)) AS i, unnest(vec)::DOUBLE AS x FROM act), s AS (SELECT feature, i, avg(x) FILTER (vec_id % 4 <> 0) AS m, stddev_pop(x) FILTER (vec_id % 4 <> 0) AS s FROM e GROUP BY ALL), z AS (SELECT feature, vec_id, list((x - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END ORDER BY i) AS v FROM e JOIN s USING (feature, i) GROUP BY ALL) SELECT feature, vec_id, {V.told_sql('v')} AS vec FROM z")
def a20_standardise(spark, sf_dir):
    return X.standardised(V.activations(spark, sf_dir), ["feature"], F.col("vec_id") % 4 != 0, "vec_id").select("feature", "vec_id", V.told().alias("vec"))


@query("WITH t AS (SELECT doc_id, w FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents) WHERE len(w) > 0) SELECT doc_id, length(w[-1])::INT AS last_length, length(w[1])::INT AS first_length FROM t")
def a19_last_token(spark, sf_dir):
    """The vector of the last token, and the vectors of two poolings as one."""
    docs = V.table(spark, sf_dir, "documents")
    tokens = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("tok_idx", "w")).select("doc_id", "tok_idx", F.array(F.length("w")).alias("vec"))
    last = X.last_token(tokens, ["doc_id"], dims=1).withColumn("layer", F.lit(0))
    first = X.last_token(tokens.withColumn("tok_idx", -F.col("tok_idx")), ["doc_id"], dims=1).withColumn("layer", F.lit(1))
    both = X.concatenated(last.unionByName(first), ["doc_id"])
    return both.select("doc_id", F.col("vec")[0].alias("last_length"), F.col("vec")[1].alias("first_length"))


@query(f"WITH {V.ACT}, e AS (SELECT feature, label, vec_id % 4 <> 0 AS tr, list_sum(list_transform(vec, lambda v: v::DOUBLE)) AS x FROM act), f AS (SELECT feature, avg(x) FILTER (tr AND label = 0) AS m0, avg(x) FILTER (tr AND label = 1) AS m1 FROM e GROUP BY feature), a AS (SELECT feature, count(*) AS n_test, round(avg(((CASE WHEN m1 >= m0 THEN x >= (m0 + m1) / 2 ELSE x < (m0 + m1) / 2 END)::INT = label)::INT), 6) AS accuracy FROM e JOIN f USING (feature) WHERE NOT tr GROUP BY feature) SELECT *, row_number() OVER (ORDER BY accuracy DESC, feature) = 1 AS best FROM a")
def a22_midpoint_threshold(spark, sf_dir):
    """Sums of whole vectors against the midpoint of the class means; the best layer is marked."""
    rows = V.activations(spark, sf_dir).withColumn("x", F.aggregate("vec", F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double")))
    found = X.midpoint_classifier(rows, ["feature"], "x", "label", F.col("vec_id") % 4 != 0)
    top = found.groupBy().agg(F.min_by("feature", F.struct((-F.col("accuracy")).alias("a"), "feature")).alias("top"))  # one row
    return found.crossJoin(F.broadcast(top)).select("feature", "n_test", "accuracy", (F.col("feature") == F.col("top")).alias("best"))


@query(f"WITH {V.EX} SELECT a.dataset AS train_set, b.dataset AS test_set FROM (SELECT DISTINCT dataset FROM ex) a, (SELECT DISTINCT dataset FROM ex) b WHERE a.dataset <> b.dataset")
def j19_ordered_pairs(spark, sf_dir):
    names = V.examples(spark, sf_dir).select("dataset").distinct()
    return names.select(F.col("dataset").alias("train_set")).crossJoin(names.select(F.col("dataset").alias("test_set"))).filter("train_set <> test_set")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'open' WHEN 'de' THEN 'mcq' END AS task FROM documents WHERE lang IN ('en', 'de')")
def j21_static_dimension(spark, sf_dir):
    kinds = spark.createDataFrame([("en", "open"), ("de", "mcq")], "lang string, task string")
    return V.table(spark, sf_dir, "documents").join(F.broadcast(kinds), "lang").select("doc_id", "task")


@query(f"WITH {V.RUNS}, r AS (SELECT *, feature || c_value AS model, row_number() OVER (PARTITION BY feature, c_value ORDER BY split_seed DESC, init_index DESC) AS rn FROM runs) SELECT feature, c_value, split_seed, test_accuracy FROM r WHERE rn = 1")
def j22_report_merge(spark, sf_dir):
    return K.first_wins(V.runs(spark, sf_dir), ["feature", "c_value"], F.struct((-F.col("split_seed")).alias("s"), (-F.col("init_index")).alias("i"))).select("feature", "c_value", "split_seed", "test_accuracy")


@query(f"WITH {V.RUNS}, h AS (SELECT feature, avg(test_accuracy) AS v FROM runs WHERE split_seed = 1 AND feature <> 'N' GROUP BY feature), n AS (SELECT feature, avg(validation_accuracy) AS v FROM runs WHERE c_value = 1.0 GROUP BY feature) SELECT DISTINCT r.feature, round(coalesce(h.v, n.v), 6) AS metric, CASE WHEN h.v IS NOT NULL THEN 'heldout' WHEN n.v IS NOT NULL THEN 'runs' END AS metric_source FROM runs r LEFT JOIN h USING (feature) LEFT JOIN n USING (feature)")
def j16_j17_metric_override(spark, sf_dir):
    from ..operators.reports import overridden

    runs = V.runs(spark, sf_dir)
    held = runs.filter("split_seed = 1 AND feature <> 'N'").groupBy("feature").agg(F.avg("test_accuracy").alias("metric"))
    nested = runs.filter("c_value = 1.0").groupBy("feature").agg(F.avg("validation_accuracy").alias("metric"))
    return overridden(runs.select("feature").distinct(), ["feature"], heldout=held, runs=nested).select("feature", F.round("metric", 6).alias("metric"), "metric_source")


@query(f"WITH {V.RUNS} SELECT feature, split_seed, c_value, init_index, rank FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY test_accuracy DESC, split_seed, c_value, init_index)::INT AS rank FROM runs) WHERE rank <= 3")
def o3_top_probes(spark, sf_dir):
    w = Window.partitionBy("feature").orderBy(F.desc("test_accuracy"), "split_seed", "c_value", "init_index")
    return V.runs(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("feature", "split_seed", "c_value", "init_index", "rank")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey % 60, p_partkey % 16, p_partkey)::INT AS place FROM part")
def o4_o6_layer_order(spark, sf_dir):
    from ..operators.ordering import running
    from ..operators.reports import layer_order

    k = F.col("p_partkey")
    names = V.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("language_model/layer_"), (k % 60).cast("string"), F.lit("/attention_head_"), (k % 16).cast("string"), F.lit("__x"), F.lpad(k.cast("string"), 12, "0")).alias("name"))
    component, layer, part, head, name = layer_order(F.col("name"))
    ordered = names.select("p_partkey", (layer * 64 + head).alias("o"), component.alias("c"), layer.alias("l"), part.alias("p"), head.alias("h"), name.alias("n"))
    return running(ordered, ["c"], ["o", "l", "p", "h", "n"], "place").select("p_partkey", F.col("place").cast("int").alias("place"))


@query("WITH r AS (SELECT l_linenumber AS stage, l_returnflag AS mode, l_linestatus AS id, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY ALL) SELECT stage, mode, id, row_number() OVER (ORDER BY stage, CASE mode WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, id)::INT AS place FROM r")
def o6_experiment_order(spark, sf_dir):
    """Experiments by stage, mode in a stated order, and id; the window holds a row an experiment."""
    from ..operators.reports import experiment_order

    rows = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("stage"), F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("id")).agg(F.count("*").alias("n"))
    order = experiment_order(F.col("stage"), F.col("mode"), F.col("id"), ["R", "A"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).select("stage", "mode", "id", "place")


@query(f"SELECT phrase, round(max(abs(skew)), 6) AS largest, row_number() OVER (ORDER BY max(abs(skew)) DESC, phrase)::INT AS rank FROM ({_phrase_sql()}) GROUP BY phrase")
def o5_ranked_phrase_groups(spark, sf_dir):
    top = a10_phrase_rates(spark, sf_dir).groupBy("phrase").agg(F.max(F.abs("skew")).alias("largest"))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("largest"), "phrase"))).select("phrase", F.round("largest", 6).alias("largest"), "rank")


_NB = f"""{_SAMPLE}, sp AS (SELECT * FROM {_by_class_sql('sm', 'label, dataset', "'1'")}),
tr AS (SELECT dataset, label, {_TOK} AS t FROM sp WHERE part = 'train'), te AS (SELECT dataset, unique_id, label, {_TOK} AS t FROM ex WHERE dataset IN (SELECT dataset FROM tr) AND unique_id NOT IN (SELECT unique_id FROM sp WHERE part = 'train')),
gr AS (SELECT dataset, label, unnest(list_distinct(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram FROM tr),
dn AS (SELECT dataset, gram, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM gr GROUP BY ALL),
tt AS (SELECT dataset, sum(c0) + count(*) AS d0, sum(c1) + count(*) AS d1 FROM dn GROUP BY dataset),
pr AS (SELECT dataset, ln((count(*) FILTER (label = 0) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE)) AS p0, ln((count(*) FILTER (label = 1) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE)) AS p1 FROM tr GROUP BY dataset),
tg AS (SELECT dataset, unique_id, unnest(list_distinct(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram FROM te),
sc AS (SELECT tg.dataset, unique_id, sum(ln((c0 + 1.0::DOUBLE) / d0)) AS s0, sum(ln((c1 + 1.0::DOUBLE) / d1)) AS s1 FROM tg JOIN dn USING (dataset, gram) JOIN tt USING (dataset) GROUP BY ALL),
nb AS (SELECT te.dataset, te.unique_id, te.label, (p1 + coalesce(s1, 0) > p0 + coalesce(s0, 0))::INT AS predicted FROM te LEFT JOIN sc USING (dataset, unique_id) JOIN pr USING (dataset))"""


def nb_predictions(spark, sf_dir):
    """Sample balanced by language, split by class, one Naive Bayes model per language; predictions for every labelled text outside its training part."""
    split = P.few_by_class(_sample(spark, sf_dir), "unique_id", (1,), PAIRS, by=["label", "dataset"])
    trained = split.filter(F.size("tested") == 0).select("unique_id", F.lit(True).alias("trained"))
    rows = V.examples(spark, sf_dir).select("dataset", "unique_id", "label").join(trained, "unique_id", "left")
    run = F.array(F.lit(0))
    roles = rows.select("unique_id", "label", F.array("dataset").alias("trains"), F.array("dataset").alias("tests"), F.when(F.col("trained"), run).otherwise(F.array()).cast("array<int>").alias("train"), F.when(F.col("trained"), F.array()).otherwise(run).cast("array<int>").alias("test"))
    return C.naive_bayes(roles, texts(spark, sf_dir), "unique_id", 1).select(F.col("scope").alias("dataset"), "unique_id", "label", "predicted")


@query(f"WITH {_NB} SELECT dataset, unique_id, label, predicted FROM nb")
def a15_j15_naive_bayes(spark, sf_dir):
    return nb_predictions(spark, sf_dir)


@query(f"WITH {_NB} SELECT dataset, count(*) AS n_test, round(avg((label = predicted)::INT), 6) AS accuracy FROM nb GROUP BY dataset")
def nb_accuracy(spark, sf_dir):
    return nb_predictions(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("n_test"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 6).alias("accuracy"))
