"""Queries that train and evaluate: text probes over many seeds and sets, activation probes, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import confounds as C
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import probes as P
from ..operators import reports as R
from ..operators import runs as Runs
from ..operators import sampling as S
from ..operators import splits as Sp
from ..operators import vectors as X
from ..operators.subspace import wide_principal
from . import views as V
from .registry import ORACLE, query
from .samples import _TOK, PAIRS, _sample, texts

#: Split seeds of every experiment, and the units of a hidden layer over sixteen inputs.
_SEEDS = (1, 2, 3, 4, 5)
_HIDDEN = 16


def text_probe_suite(spark, sf_dir):
    """Within each set, and over all sets mixed: a model per (scope, seed), in one job. The sample is split on ids; texts join last, once."""
    split = Sp.few_by_class(_sample(spark, sf_dir), "unique_id", _SEEDS, PAIRS, by=["label", "dataset"])
    scopes, runs = F.array("dataset", F.lit("all")), F.array(*map(F.lit, range(len(_SEEDS))))
    test = F.transform("tested", lambda s: F.array_position(F.array(*map(F.lit, _SEEDS)), s).cast("int") - 1)
    roles = split.select("unique_id", "label", scopes.alias("trains"), scopes.alias("tests"), F.array_except(runs, test).alias("train"), test.alias("test"))
    found = C.naive_bayes(roles, texts(spark, sf_dir), "unique_id", len(_SEEDS))
    return found.groupBy("scope", "run").agg(F.count("*").alias("n_test"), F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"))


def _nb_sql(train: str, test: str, run: str) -> str:
    """Naive Bayes in SQL over tables ``train`` and ``test`` with the run columns."""
    grams = "unnest(list_distinct(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))"
    return f"""gr AS (SELECT {run}, label, {grams} AS gram FROM {train}), dn AS (SELECT {run}, gram, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM gr GROUP BY ALL),
tt AS (SELECT {run}, sum(c0) + count(*) AS d0, sum(c1) + count(*) AS d1 FROM dn GROUP BY ALL),
pr AS (SELECT {run}, ln((count(*) FILTER (label = 0) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE)) AS p0, ln((count(*) FILTER (label = 1) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE)) AS p1 FROM {train} GROUP BY ALL),
tg AS (SELECT {run}, unique_id, {grams} AS gram FROM {test}),
sc AS (SELECT {run}, unique_id, sum(ln((c0 + 1.0::DOUBLE) / d0)) AS s0, sum(ln((c1 + 1.0::DOUBLE) / d1)) AS s1 FROM tg JOIN dn USING ({run}, gram) JOIN tt USING ({run}) GROUP BY ALL),
nb AS (SELECT {run}, unique_id, te.label, (p1 + coalesce(s1, 0) > p0 + coalesce(s0, 0))::INT AS predicted FROM {test} te LEFT JOIN sc USING ({run}, unique_id) JOIN pr USING ({run}))"""


def _suite_sql() -> str:
    from .samples import _SAMPLE, _by_class_sql

    return f"{_SAMPLE}, se AS (SELECT sm.*, seed FROM sm, (VALUES (1), (2), (3), (4), (5)) AS t(seed)), sp AS (SELECT * FROM {_by_class_sql('se', 'label, dataset, seed', 'seed')})"


_SCOPED = "so AS (SELECT *, dataset AS scope FROM sp UNION ALL SELECT *, 'all' FROM sp)"


@query(f"WITH {_suite_sql()}, {_SCOPED}, tr AS (SELECT scope, seed, label, {_TOK} AS t FROM so WHERE part = 'train'), te0 AS (SELECT scope, seed, unique_id, label, {_TOK} AS t FROM so WHERE part = 'test'), {_nb_sql('tr', 'te0', 'scope, seed')}, ac AS (SELECT scope, seed, avg((label = predicted)::INT) AS a, count(*) AS n FROM nb GROUP BY ALL) SELECT scope, count(*) AS n_runs, round(avg(a), 6) AS accuracy_mean, round(stddev_pop(a), 6) AS accuracy_std FROM ac GROUP BY scope")
def m8_text_probe_suite(spark, sf_dir):
    return M.over_seeds(text_probe_suite(spark, sf_dir), ["scope"], "accuracy")


@query(f"WITH {_suite_sql()}, cr AS (SELECT a.dataset AS train_set, b.dataset AS test_set FROM (SELECT DISTINCT dataset FROM sp) a, (SELECT DISTINCT dataset FROM sp) b WHERE a.dataset <> b.dataset), tr AS (SELECT train_set, test_set, label, {_TOK} AS t FROM sp JOIN cr ON dataset = train_set WHERE seed = 1), te0 AS (SELECT train_set, test_set, unique_id, label, {_TOK} AS t FROM sp JOIN cr ON dataset = test_set WHERE seed = 1), {_nb_sql('tr', 'te0', 'train_set, test_set')} SELECT train_set, test_set, count(*) AS n_test, round(avg((label = predicted)::INT), 6) AS accuracy FROM nb GROUP BY ALL")
def m8_cross_set_transfer(spark, sf_dir):
    """A text trains in its own set and is tested in all others; names of sets are the one thing that every row gets."""
    rows = _sample(spark, sf_dir).select("dataset", "unique_id", "label")
    names = rows.agg(F.collect_set("dataset").alias("names"))
    one = F.array(F.lit(0))
    roles = rows.crossJoin(F.broadcast(names)).select("unique_id", "label", F.array("dataset").alias("trains"), F.array_except("names", F.array("dataset")).alias("tests"), one.alias("train"), one.alias("test"))
    found = C.naive_bayes(roles, texts(spark, sf_dir), "unique_id", 1).withColumnRenamed("scope", "train_set")
    told = found.join(rows.select("unique_id", F.col("dataset").alias("test_set")), "unique_id")
    return told.groupBy("train_set", "test_set").agg(F.count("*").alias("n_test"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 6).alias("accuracy"))


def _m9_sql() -> str:
    from .samples import _ODDS

    squeezed = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
    said = lambda ps: " OR ".join("contains(sq, '" + p.replace("'", "''") + "')" for p in ps)
    hits = " UNION ALL ".join(f"SELECT label, '{g}' AS phrase, ({said(ps)})::INT AS h FROM sqz" for g, ps in C.PHRASES.items())
    phrases = f"WITH {V.EX}, sqz AS (SELECT label, {squeezed} AS sq FROM ex), h AS ({hits}) SELECT 'phrase' AS section, phrase AS name, round(coalesce(avg(h) FILTER (label = 1), 0) - coalesce(avg(h) FILTER (label = 0), 0), 6) AS value FROM h GROUP BY phrase"
    top = lambda k, sign: f"SELECT 'gram{k}' AS section, gram AS name, log_odds AS value FROM (WITH {_ODDS} SELECT * FROM o ORDER BY {sign}log_odds DESC, gram DESC LIMIT 12)"
    return f"SELECT * FROM ({phrases}) UNION ALL {top(1, '')} UNION ALL {top(0, '-')} UNION ALL SELECT 'probe', scope, accuracy_mean FROM ({ORACLE['m8_text_probe_suite']})"


@query(_m9_sql())
def m9_confound_report(spark, sf_dir):
    """Phrase skews, top grams and probe accuracies as one long table."""
    ex = V.examples(spark, sf_dir)
    odds = C.log_odds(ex)
    phrases = C.phrase_rates(ex, C.PHRASES).select(F.lit("phrase").alias("section"), F.col("phrase").alias("name"), F.round("skew", 6).alias("value"))
    grams = C.top_grams(odds).select(F.concat(F.lit("gram"), "label").alias("section"), F.col("gram").alias("name"), F.col("log_odds").alias("value"))
    probes = m8_text_probe_suite(spark, sf_dir).select(F.lit("probe").alias("section"), F.col("scope").alias("name"), F.col("accuracy_mean").alias("value"))
    return phrases.unionByName(grams).unionByName(probes)


def _probe_samples(spark, sf_dir, seeds: tuple[int, ...] = _SEEDS):
    """Vectors of every layer with a three-way split per seed; splits are drawn on ids, vectors join last."""
    e = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), (F.col("label") >= 5).cast("int").alias("label"))
    split = Sp.three_way(e.withColumn("split_seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds)))), ["label"], "key", F.col("split_seed"), group=["split_seed"])
    act = V.activations(spark, sf_dir).select(F.col("vec_id").alias("key"), "feature", F.col("vec").cast("array<double>").alias("vec"))
    return split.join(act, "key")


def _over_seeds(found):
    """The best start and penalty of each split, then mean and deviation over the splits."""
    return M.over_seeds(P.selected(found), ["feature"], "validation_accuracy", "test_accuracy")


@query()
def m1_m3_logistic_sweep(spark, sf_dir):
    """All features, five splits, the whole grid of penalties and starts."""
    return _over_seeds(P.sweep(_probe_samples(spark, sf_dir)))


@query()
def m2_hidden_layer_sweep(spark, sf_dir):
    return _over_seeds(P.sweep(_probe_samples(spark, sf_dir), hidden=_HIDDEN))


def _paired(spark, sf_dir):
    """Difference and concatenation of the vectors with and without the evidence, as features, and the label of the pair."""
    act = V.activations(spark, sf_dir).withColumn("key", F.floor(F.col("vec_id") / 2))
    one, two = (act.filter(F.col("vec_id") % 2 == k).select("key", "feature", "vec") for k in (0, 1))
    both = X.aligned(one, two, ["key", "feature"])
    shape = lambda kind: F.struct(F.concat("feature", F.lit(f"|{kind}")).alias("feature"), F.col(kind).cast("array<double>").alias("vec"))
    rows = both.select("key", F.explode(F.array(shape("diff"), shape("both"))).alias("x")).select("key", "x.*")
    return rows.join(act.filter("vec_id % 2 = 0").select("key", "label").distinct(), "key")


@query()
def m3_heldout_evaluation(spark, sf_dir):
    """Every fifth pair is held out: models are fitted and chosen on the others, per split seed; evaluation seed i takes split i mod n and the best feature by validation."""
    rows = _paired(spark, sf_dir)
    pool = rows.filter("key % 5 <> 0").select("key", "label").distinct().withColumn("split_seed", F.explode(F.array(*(F.lit(s).cast("long") for s in _SEEDS))))
    split = Sp.by_class(pool, "key", F.col("split_seed"), group=["split_seed"]).withColumn("part", F.when(F.col("part") == "test", "val").otherwise("train"))
    held = rows.filter("key % 5 = 0").select("key", "label").distinct().select("key", "label", F.explode(F.array(*(F.lit(s).cast("long") for s in _SEEDS))).alias("split_seed"), F.lit("test").alias("part"))
    samples = split.select("key", "label", "split_seed", "part").unionByName(held.select("key", "label", "split_seed", "part")).join(rows.drop("label"), "key")
    best = M.best(P.selected(P.sweep(samples)), ["split_seed"], F.desc("validation_accuracy"), F.asc("feature"))
    seeds = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("eval_seed"))
    given = Sp.round_robin(seeds, best.select("split_seed"), "eval_seed", "split_seed").join(best, "split_seed")
    return given.select("eval_seed", "split_seed", "feature", "c_value", "validation_accuracy", "test_accuracy")


@query()
def m3_difference_and_concat(spark, sf_dir):
    """The same experiment on differences and concatenations of aligned vectors."""
    rows = _paired(spark, sf_dir)
    keys = rows.select("key", "label").distinct().withColumn("split_seed", F.explode(F.array(*(F.lit(s).cast("long") for s in _SEEDS))))
    split = Sp.three_way(keys, ["label"], "key", F.col("split_seed"), group=["split_seed"])
    return _over_seeds(P.sweep(split.join(rows.drop("label"), "key")))


@query()
def m4_all_examples_experiment(spark, sf_dir):
    """One row per (group, label), balanced allocation, split, probe on concatenated layers, accuracy."""
    e = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), (F.col("label") >= 5).cast("int").alias("label"), F.concat(F.lit("g"), F.col("label") % 3).alias("dataset"))
    plan = S.with_floor(S.class_counts(e), PAIRS)
    chosen = S.sample_by_plan(e, plan, 42, ["dataset"], "key", ["label"]).select("key", "label")
    seeds = chosen.withColumn("split_seed", F.explode(F.array(*(F.lit(s).cast("long") for s in _SEEDS))))
    split = Sp.three_way(seeds, ["label"], "key", F.col("split_seed"), group=["split_seed"])
    vec = X.concatenated(V.activations(spark, sf_dir).withColumn("key", F.col("vec_id")), ["key"])
    samples = split.join(vec, "key").select(F.lit("language_model/all_layers_concat__mean").alias("feature"), "split_seed", "key", "part", "label", F.col("vec").cast("array<double>").alias("vec"))
    return _over_seeds(P.sweep(samples))


def _three_way_sql(rows: str, key: str, by: str, seed: str) -> str:
    """``three_way`` in SQL: ``rows`` with ``part``."""
    b = f"SELECT *, count(*) OVER (PARTITION BY {by}) AS n_, row_number() OVER (PARTITION BY {by} ORDER BY md5('{seed}:' || {key}), {key}) AS rn FROM {rows}"
    s = f"SELECT *, greatest(1, round_even(n_ * 0.1::DOUBLE, 0))::INT AS v0, greatest(1, round_even(n_ * 0.2::DOUBLE, 0))::INT AS t0 FROM ({b}) WHERE n_ >= 3"
    o = f"SELECT *, greatest(0, v0 + t0 - (n_ - 1)) AS over_ FROM ({s})"
    z = f"SELECT *, t0 - least(over_, t0 - 1) AS t_, v0 - (over_ - least(over_, t0 - 1)) AS v_ FROM ({o})"
    return f"(SELECT *, CASE WHEN rn <= t_ THEN 'test' WHEN rn <= t_ + v_ THEN 'val' ELSE 'train' END AS part FROM ({z}))"


def _cross_mode(spark, sf_dir):
    act = V.activations(spark, sf_dir).withColumn("key", F.floor(F.col("vec_id") / 2))
    label = act.filter("vec_id % 2 = 0").select("key", "label").distinct()
    split = Sp.three_way(label.withColumn("split_seed", F.lit(1).cast("long")), ["label"], "key", 1)
    wanted = F.when(F.col("part") == "test", 1).otherwise(0)
    return split.join(act.select("key", "feature", "vec", "vec_id", (F.col("vec_id") % 2).alias("mode")), "key").filter(F.col("mode") == wanted)


@query(f"WITH {V.ACT}, l AS (SELECT DISTINCT vec_id // 2 AS key, label FROM act WHERE vec_id % 2 = 0) SELECT s.key, a.feature, a.vec_id, s.part FROM {_three_way_sql('l', 'key', 'label', '1')} s JOIN act a ON a.vec_id = 2 * s.key + (s.part = 'test')::INT")
def p9_cross_mode_rows(spark, sf_dir):
    """Training and validation rows of one mode, test rows of the other mode of the same samples."""
    return _cross_mode(spark, sf_dir).select("key", "feature", "vec_id", "part")


@query()
def m5_p9_cross_mode(spark, sf_dir):
    """Train and validate on one mode's vectors, test on the other mode's of the same samples."""
    return P.selected(P.sweep(_cross_mode(spark, sf_dir).select("feature", "split_seed", "key", "part", "label", F.col("vec").cast("array<double>").alias("vec"))))


def _clean_rows(spark, sf_dir):
    """Vectors with the clean label of their variant."""
    state = F.when(F.col("state") == "mirage", True).when(F.col("state") == "non_mirage", False)
    told = V.variants(spark, sf_dir).select(F.col("src_ord").alias("vec_id"), L.clean_b(state, F.col("with_correct"), F.col("without_correct")).alias("clean")).filter("clean IS NOT NULL")
    return V.activations(spark, sf_dir).join(told, "vec_id").select(F.col("vec_id").alias("key"), "feature", F.col("clean").alias("label"), F.col("vec").cast("array<double>").alias("vec"))


@query(f"WITH {V.VAR} SELECT src_ord AS key, CASE WHEN state = 'mirage' THEN 1 ELSE 0 END AS label FROM var WHERE (state = 'mirage' OR NOT without_correct AND with_correct) AND src_ord IN (SELECT vec_id FROM embeddings)")
def m5_clean_b_rows(spark, sf_dir):
    return _clean_rows(spark, sf_dir).select("key", "label").distinct()


@query()
def m5_clean_b_experiment(spark, sf_dir):
    """Labels by the clean rule, split by class for five seeds, the whole grid."""
    rows = _clean_rows(spark, sf_dir)
    keys = rows.select("key", "label").distinct().withColumn("split_seed", F.explode(F.array(*(F.lit(s).cast("long") for s in _SEEDS))))
    return _over_seeds(P.sweep(Sp.three_way(keys, ["label"], "key", F.col("split_seed"), group=["split_seed"]).join(rows.drop("label"), "key")))


def _transfer(samples, sources: str, by: str | None = None):
    """Train on the samples of each source side, test on those of A and of B (and of each value of ``by``): the target is a column."""
    cases = F.explode(F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a in sources for b in "AB"))).alias("c")
    rows = samples.select("*", cases).filter(F.when(F.col("part") == "test", F.col("side") == F.col("c.target")).otherwise((F.col("side") == F.col("c.source")) & (F.col("c.target") == "A")))
    rows = rows.withColumn("feature", F.concat_ws("|", "feature", "c.source")).withColumn("target", F.when(F.col("part") == "test", F.col("c.target"))).drop("c", "side")
    told = [F.col("target")] + ([F.when(F.col("part") == "test", F.col(by))] if by else [])
    found = P.selected_with(P.sweep(rows, tested=told), [f"_t{k}" for k in range(len(told))])
    name = F.split("feature", r"\|")
    return found.select(name[0].alias("feature"), name[1].alias("source"), F.col("_t0").alias("target"), *([F.col("_t1").alias(by)] if by else []), "split_seed", "c_value", "n_test", "test_accuracy")


def _sided(spark, sf_dir):
    return _probe_samples(spark, sf_dir).withColumn("side", F.when(F.col("key") % 2 == 0, "A").otherwise("B"))


@query()
def m6_transfer_grid(spark, sf_dir):
    """Train on the samples of group A or B, test on A and on B."""
    return _transfer(_sided(spark, sf_dir), "AB")


@query()
def m6_transfer_from_b_only(spark, sf_dir):
    """Train on B alone, test on A and on B, for each benchmark by itself."""
    return _transfer(_sided(spark, sf_dir).withColumn("benchmark", F.concat(F.lit("set"), F.col("key") % 3)), "B", by="benchmark")


@query()
def m6_transfer_of_short_questions(spark, sf_dir):
    """The grid on the samples whose text is short."""
    short = V.table(spark, sf_dir, "documents").filter(T.word_count(F.col("text")) < 300).select(F.col("doc_id").alias("key"))
    return _transfer(_sided(spark, sf_dir).join(short, "key", "left_semi"), "AB")


@query("SELECT CASE WHEN len(regexp_extract_all(text, '\\S+')) >= 300 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) AND doc_id % 5 = 0 GROUP BY ALL")
def p14_short_holdout_pool(spark, sf_dir):
    """The hold-out pool by length: why its rows go, and how many stay."""
    pool = V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").filter("doc_id % 5 = 0")
    return pool.groupBy(F.when(T.word_count(F.col("text")) >= 300, "long").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


@query()
def m7_token_probe(spark, sf_dir):
    """Every chunk of a vector is a token row with its sample's label; tokens of a pair stay in one part. All layers in one job."""
    act = V.activations(spark, sf_dir)
    tokens = act.select("vec_id", "label", "feature", F.posexplode(F.array(*(F.slice("vec", 1 + 4 * k, 4) for k in range(4)))).alias("tok", "vec"))
    part = F.when(F.floor(F.col("vec_id") / 2) % 5 == 0, "test").when(F.floor(F.col("vec_id") / 2) % 5 == 1, "val").otherwise("train")
    return P.token_probe(tokens.select(F.col("feature").alias("layer"), (F.col("vec_id") * 4 + F.col("tok")).alias("key"), "label", F.col("vec").cast("array<double>").alias("vec"), part.alias("part")))


@query()
def a21_principal_components(spark, sf_dir):
    rows = V.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), (F.col("vec_id") % 4 != 0).alias("is_train"))
    return P.principal(rows, 4).select("vec_id", F.size("components").alias("n"), F.array_join(F.transform("components", lambda x: F.round(F.abs(x), 4).cast("string")), ",").alias("components"))


@query()
def a21_wide_components(spark, sf_dir):
    """Components of the concatenated layers, by passes over the rows: the way for vectors of any width."""
    vec = X.concatenated(V.activations(spark, sf_dir), ["vec_id"]).select("vec_id", F.col("vec").cast("array<double>").alias("vec"), (F.col("vec_id") % 4 != 0).alias("is_train"))
    return wide_principal(vec, 4).select("vec_id", F.size("components").alias("n"), F.array_join(F.transform("components", lambda x: F.round(F.abs(x), 4).cast("string")), ",").alias("components"))


@query(f"WITH {V.RUNS}, r AS (SELECT split_seed, feature, max(test_accuracy) AS m FROM runs GROUP BY ALL) SELECT feature, " + ", ".join(f"printf('%.2f%%', max(m) FILTER (split_seed = {k}) * 100) AS s{k}" for k in (1, 2, 3)) + " FROM r GROUP BY feature")
def m10_result_table(spark, sf_dir):
    runs = V.runs(spark, sf_dir).groupBy("feature", F.concat(F.lit("s"), "split_seed").alias("mode")).agg(F.max("test_accuracy").alias("metric"))
    return R.table(runs, "feature", "mode", ["s1", "s2", "s3"])


@query("SELECT p_partkey % 7 AS experiment, family, min(name) AS feature FROM (SELECT p_partkey, 'language_model/layer_' || (p_partkey % 60) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/mlp' ELSE '/post_attention' END || '__mean' AS name, CASE p_partkey % 3 WHEN 0 THEN 'residual' WHEN 1 THEN 'mlp' ELSE 'post_attention' END AS family FROM part) GROUP BY ALL")
def m10_best_by_family(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("language_model/layer_"), (k % 60).cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, "/mlp").otherwise("/post_attention"), F.lit("__mean"))
    rows = V.table(spark, sf_dir, "part").select((k % 7).alias("experiment"), name.alias("feature"), F.lit(0.5).alias("metric"))
    return R.best_by_family(rows, ["experiment"]).select("experiment", "family", "feature")


@query("SELECT s_suppkey, (4 * (s_suppkey % 3 + 1) * 3 + 4)::INT AS n, 'language_model/layer_' || (s_suppkey % 3) || '/post_attention__last' AS last_part FROM supplier")
def f29_candidate_names(spark, sf_dir):
    """Every feature name to try for as many layers as a model has."""
    layers = F.sequence(F.lit(0), (F.col("s_suppkey") % 3).cast("int"))
    names = T.candidates(layers, ("mean", "last", "max", "min"))
    wanted = F.concat(F.lit("language_model/layer_"), (F.col("s_suppkey") % 3).cast("string"), F.lit("/post_attention__last"))
    return V.table(spark, sf_dir, "supplier").select("s_suppkey", (F.size(names) - 4).alias("n"), F.element_at(F.filter(names, lambda x: x == wanted), 1).alias("last_part"))


def _seed_sql(i: str, key: str) -> str:
    """``seed_at`` in SQL, for a table with columns ``i`` and ``key``."""
    f = Runs._FACTORS
    x = f"({i}::BIGINT % 1073741824)"
    for k in range(3):
        y = f"(({x} * {f[k]} + ({key}::BIGINT % 1073741824) * {f[k - 1]} + {k}) % 1073741824)"
        x = f"xor({y}, {y} >> 15)"
    return x


@query(f"SELECT s_suppkey, n_nationkey, {_seed_sql('s_suppkey', 'n_nationkey')} AS split_seed FROM supplier, nation")
def w20_split_seeds(spark, sf_dir):
    """A split seed for each supplier in the experiment of each nation, drawn without replacement."""
    nations = V.table(spark, sf_dir, "nation").select("n_nationkey")
    each = V.table(spark, sf_dir, "supplier").select("s_suppkey").crossJoin(F.broadcast(nations))
    return each.select("s_suppkey", "n_nationkey", Runs.seed_at(F.col("s_suppkey"), F.col("n_nationkey")).alias("split_seed"))


@query("""WITH s AS (SELECT DISTINCT l_linenumber::INT AS stage_no, 'stage' || l_linenumber AS stage, CASE WHEN l_linenumber % 2 = 0 THEN 'contrastive' ELSE 'all_examples' END AS family FROM lineitem),
m AS (SELECT row_number() OVER (ORDER BY mode)::INT AS mode_no, mode FROM (SELECT DISTINCT l_returnflag AS mode FROM lineitem)), o AS (SELECT DISTINCT l_linestatus AS model FROM lineitem),
j AS (SELECT * FROM s, m, o WHERE NOT (model = 'F' AND family = 'contrastive')), w AS (SELECT model, stage_no, lag(stage_no) OVER (PARTITION BY model ORDER BY stage_no) AS waits_for FROM (SELECT DISTINCT model, stage_no FROM j))
SELECT lpad(stage_no::VARCHAR, 2, '0') || '_' || lpad(mode_no::VARCHAR, 2, '0') || '_' || stage || '_' || mode || '_' || model AS tag, family, waits_for FROM j JOIN w USING (model, stage_no)""")
def j20_job_plan(spark, sf_dir):
    """Stages by modes by models; one model has no job of one family, so that stages of it are passed over."""
    items = V.table(spark, sf_dir, "lineitem")
    stages = items.select("l_linenumber").distinct().select(F.col("l_linenumber").cast("int").alias("stage_no"), F.concat(F.lit("stage"), "l_linenumber").alias("stage"), F.when(F.col("l_linenumber") % 2 == 0, "contrastive").otherwise("all_examples").alias("family"))
    modes = items.select(F.col("l_returnflag").alias("mode")).distinct().withColumn("mode_no", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("mode")))
    models = items.select(F.col("l_linestatus").alias("model")).distinct()
    return Runs.job_plan(stages, modes, models, (F.col("model") == "F") & (F.col("family") == "contrastive")).select("tag", "family", "waits_for")


_CELLS = f"""{V.RUNS}, pr AS (SELECT feature AS family, 'stage' || split_seed AS stage, CASE WHEN c_value < 1 THEN 'low' ELSE 'high' END AS mode, max(test_accuracy) AS metric FROM runs WHERE split_seed <= 4 GROUP BY ALL),
ex AS (SELECT feature AS family, 'stage' || split_seed AS stage, CASE WHEN c_value < 1 THEN 'low' ELSE 'high' END AS mode, max(validation_accuracy) AS metric FROM runs WHERE split_seed >= 3 AND (feature <> 'R' OR c_value < 1) GROUP BY ALL),
li AS (SELECT DISTINCT feature || split_seed AS line, 'stage' || split_seed AS stage, feature AS family, split_seed = 5 AS only_extra FROM runs), mo AS (SELECT unnest(['low', 'high', 'none']) AS mode),
ce AS (SELECT li.*, mo.mode, CASE WHEN only_extra OR (li.stage = 'stage3' AND ex.metric IS NOT NULL) THEN ex.metric ELSE pr.metric END AS metric, CASE WHEN only_extra OR (li.stage = 'stage3' AND ex.metric IS NOT NULL) THEN CASE WHEN ex.metric IS NOT NULL THEN 'extra' END WHEN pr.metric IS NOT NULL THEN 'primary' END AS metric_source
    FROM li CROSS JOIN mo LEFT JOIN pr ON pr.stage = li.stage AND pr.family = li.family AND pr.mode = mo.mode LEFT JOIN ex ON ex.stage = li.stage AND ex.family = li.family AND ex.mode = mo.mode)"""


def _section(spark, sf_dir):
    """Primary runs of the first four stages, extra runs from the third on; stage 3 takes its extra run first, stage 5 has no other."""
    runs = V.runs(spark, sf_dir)
    stage, mode = F.concat(F.lit("stage"), "split_seed"), F.when(F.col("c_value") < 1, "low").otherwise("high")
    named = runs.withColumns({"stage": stage, "mode": mode, "family": F.col("feature")})
    cell = lambda rows, metric: rows.groupBy("stage", "mode", "family").agg(F.max(metric).alias("metric"))
    lines = named.select(F.concat("feature", "split_seed").alias("line"), "stage", "family", (F.col("split_seed") == 5).alias("only_extra")).distinct()
    extra = cell(named.filter((F.col("split_seed") >= 3) & ((F.col("feature") != "R") | (F.col("c_value") < 1))), "validation_accuracy")
    return R.section(lines, ["low", "high", "none"], cell(named.filter("split_seed <= 4"), "test_accuracy"), extra, F.col("stage") == "stage3")


@query(f"WITH {_CELLS} SELECT line, mode, metric, metric_source FROM ce")
def j17_extra_runs(spark, sf_dir):
    """Which run each cell of a section takes: the extra run of one stage replaces the primary one."""
    return _section(spark, sf_dir).select("line", "mode", "metric", "metric_source")


@query(f"WITH {_CELLS} SELECT line, " + ", ".join(f"coalesce(printf('%.2f%%', max(metric) FILTER (mode = '{m}') * 100), 'N/A') AS {m}" for m in ("low", "high", "none")) + " FROM ce GROUP BY line")
def m10_section_table(spark, sf_dir):
    """A section of the result tables: a line for each row label, a percent cell for each mode."""
    return R.table(_section(spark, sf_dir), "line", "mode", ["low", "high", "none"])
