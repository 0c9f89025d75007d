"""Properties and rows by hand for keys, sampling, splits, metrics, probes, sources and streams."""

from __future__ import annotations

import collections
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalprobe.operators import confounds as C
from evalprobe.operators import keys as K
from evalprobe.operators import labels as L
from evalprobe.operators import metrics as M
from evalprobe.operators import probes as P
from evalprobe.operators import sampling as S
from evalprobe.operators import splits as Sp
from evalprobe.operators import vectors as X
from evalprobe.sources import questions as Q
from evalprobe.sources.json_array import read_json_array
from evalprobe.streaming import parsed_answers


def test_label_outcomes(spark):
    rows = spark.createDataFrame([(1, True, True, True), (2, False, True, True), (3, False, False, True), (4, False, False, False)], "i int, m boolean, a boolean, s boolean")
    state, label = L.mirage(F.col("m"), F.col("a"), F.col("s"))
    got = {r.i: (r.state, r.label) for r in rows.select("i", state.alias("state"), label.alias("label")).collect()}
    assert got == {1: (None, "neutral_missing_response"), 2: (False, "non_mirage"), 3: (True, "mirage"), 4: (None, "neutral")}


def test_holdout_filters_before_dedupe(spark):
    pool = spark.createDataFrame([(1, "s", False), (2, "s", True), (3, "s", True), (4, "t", True)], "src_ord int, sig string, long_enough boolean")
    train = spark.createDataFrame([("t",)], "sig string")
    assert [r.src_ord for r in K.holdout(pool, train, F.col("long_enough")).collect()] == [2]


def test_images_fall_back_and_last_wins(spark):
    images = spark.createDataFrame([("d", "u1", "q1", 1, ["a"]), ("d", "u2", "q2", 2, []), ("d", "u3", "q1", 3, ["c"])], "dataset string, unique_id string, question_id string, src_ord int, images array<string>")
    rows = spark.createDataFrame([("d", "u1", "q1"), ("d", "zz", "q1"), ("d", "u2", "q2"), ("d", "zz", "zz")], "dataset string, unique_id string, question_id string")
    got = {(r.unique_id, r.question_id): r.images for r in K.attach_images(rows, images).collect()}
    assert got == {("u1", "q1"): ["a"], ("zz", "q1"): ["c"], ("u2", "q2"): []}
    assert K.attach_images(rows, images, require=True).count() == 2


def test_overlap_blank_keys_never_match(spark):
    schema = "dataset string, unique_id string, question_id string"
    train = spark.createDataFrame([("d", "1", ""), ("d", " ", "q")], schema)
    pool = spark.createDataFrame([("d", "1", "q"), ("d", "", "q"), ("d", "", " "), ("e", "1", "q")], schema)
    assert sorted((r.reason or "") for r in K.overlap_reason(train, pool).collect()) == ["", "", "qid", "uid"]


@pytest.mark.parametrize("seed", range(3))
def test_allocations(spark, seed):
    draw = random.Random(seed)
    caps = {f"d{i}": draw.randrange(0, 30) for i in range(6)}
    table = spark.createDataFrame(list(caps.items()), "dataset string, pair_cap long")
    for target in (0, 10, 37, 500):
        got = {r.dataset: r.n for r in S.largest_remainder(table, target).collect()}
        assert sum(got.values()) == min(target, sum(caps.values())) and all(got[d] <= caps[d] for d in got)
        floor = {r.dataset: r.n for r in S.with_floor(table, target).collect()}
        usable = {d: c for d, c in caps.items() if c >= 3}
        assert set(floor) == set(usable) and all(3 <= floor[d] <= usable[d] for d in floor)
        if target >= 3 * len(usable):
            assert sum(floor.values()) == min(target, sum(usable.values()))


def test_splits_keep_groups_whole_and_one_training_row(spark):
    rows = spark.createDataFrame([(i, i % 2, f"g{i % 7}", ["x", "y", "z"][i % 3]) for i in range(90)], "key int, label int, grp string, dataset string")
    for r in Sp.by_group(rows, "grp", 1).groupBy("grp").agg(F.count_distinct("part").alias("n")).collect():
        assert r.n == 1
    counts = Sp.three_way(rows, ["label", "dataset"], "key", 1).groupBy("label", "dataset").pivot("part", ["train", "val", "test"]).count().collect()
    assert all(r.train >= 1 and r.val >= 1 and r.test >= 1 for r in counts)
    small = spark.createDataFrame([(i, 0) for i in range(3)] + [(9, 1), (10, 1)], "key int, label int")
    parts = Sp.three_way(small, ["label"], "key", 1).collect()
    assert sorted(r.part for r in parts) == ["test", "train", "val"]


def test_metrics_edges(spark):
    rows = spark.createDataFrame([("c", 1.0, 1), ("c", 1.0, 0), ("o", 1.0, 1), ("o", 2.0, 1), ("n", 2.0, 1), ("n", 1.0, 0), ("n", float("nan"), 0)], "g string, s double, y int").withColumn("s", M.finite(F.col("s")))
    assert {r.g: r.auc for r in M.auc(rows, ["g"], "s", "y").collect()} == {"c": 0.5, "o": None, "n": 1.0}
    got = {r.g: r.r for r in rows.groupBy("g").agg(M.correlation(F.col("s"), F.col("y").cast("double")).alias("r")).collect()}
    assert got["c"] is None and got["o"] is None and got["n"] == pytest.approx(1)
    modal = M.modal(spark.createDataFrame([(1, 0.1), (1, 1.0)], "k int, c double"), ["k"], "c").first()
    assert modal.c == 0.1


def test_probe_ties(spark):
    runs = spark.createDataFrame([("f", 1, 1.0, 0, 0.9, 0.8, 0.1), ("f", 1, 1.0, 1, 0.9, 0.9, 0.2), ("f", 1, 0.1, 0, 0.9, 0.5, 0.3)], "feature string, split_seed long, c_value double, init_index int, validation_accuracy double, train_accuracy double, test_accuracy double")
    assert P.selected(runs).first().c_value == 0.1


def _sweep_rows(spark, x, y):
    parts = ["train", "val", "test"]
    rows = [("f", 1, i, parts[i % 3], int(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "feature string, split_seed long, key long, part string, label int, vec array<double>").repartition(3)


def test_probes_learn_and_score_all_rows(spark, monkeypatch):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 5))
    line, bent = x[:, 0] > 0, np.abs(x[:, 0]) > 0.6
    assert P.sweep(_sweep_rows(spark, x, line), (0.0,), 1).first().test_accuracy > 0.9
    found = P.sweep(_sweep_rows(spark, x, bent), (0.0, 0.01), 2, hidden=16).collect()
    assert len(found) == 4 and max(r.test_accuracy for r in found if r.c_value == 0.0) > 0.75
    apart = P.sweep(_sweep_rows(spark, x, line), (0.0,), 1, tested=[F.col("key") % 2]).collect()
    assert sorted(r.n_test for r in apart) == [50, 50]
    monkeypatch.setattr(P, "FIT_ROWS", 20)  # fitted on a sample of the rows, scored on all
    assert sum(r.n_test for r in P.sweep(_sweep_rows(spark, x, line), (0.0,), 1, tested=[F.col("key") % 2]).collect()) == 100


@pytest.mark.parametrize("hidden", [0, 3])
def test_large_fits_take_all_rows(spark, monkeypatch, hidden):
    """Fits over blocks of rows equal those in one task, beside a small one, whatever the partitions; runs stop early in both."""
    import pickle

    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 4)) * [1, 5, 1, 0] + 2
    rows = _sweep_rows(spark, x, x[:, 0] + draw.normal(size=300) > 2)
    rows = rows.unionByName(rows.filter("key < 60").withColumn("feature", F.lit("few"))).unionByName(rows.withColumn("split_seed", F.lit(2).cast("long")))

    def models(table):
        found = {(r.feature, r.split_seed): pickle.loads(r.models) for r in P.fitted(table, (0.0, 0.01, 1.0), 2, hidden, epochs=25).collect()}
        return {(key, run, k): v[i] for key, (mean, std, runs, params) in found.items() for i, run in enumerate(runs) for k, v in enumerate([np.stack([mean] * len(runs)), np.stack([std] * len(runs)), *params])}

    monkeypatch.setattr(P, "PATIENCE", 6)
    want = models(rows)
    assert len({key for key, _, _ in want}) == 3
    monkeypatch.setattr(P, "FIT_ROWS", 25)
    monkeypatch.setattr(P, "FIT_VALUES", 100)
    got, again = models(rows), models(rows.repartition(7))
    assert want.keys() == got.keys()
    for key, v in want.items():
        assert got[key] == pytest.approx(v, rel=1e-6, abs=1e-9)
        assert np.array_equal(got[key], again[key])


def test_probe_steps_by_plain_loops():
    """Two epochs of both models against derivatives by differences, decay 1 / C on every parameter."""
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(12, 3)), (draw.random(12) > 0.5).astype(float)
    for hidden in (0, 4):
        probes = P.Probes.start(3, hidden, [7])
        loss = lambda p: float((np.logaddexp(0, (z := P.Probes(p).forward(x)[0])) - y * z).mean())
        for k, g in enumerate(probes.gradients(x, y)):
            for at in np.ndindex(*g.shape):
                moved = [[q.copy() for q in probes.params] for _ in range(2)]
                moved[0][k][at] += 1e-4
                moved[1][k][at] -= 1e-4
                assert g[at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-4, abs=2e-4)
    train = np.arange(12) < 6
    start, (w, b) = P.Probes.start(3, 0, [3]), [p[0] for p in P.Probes.start(3, 0, [3]).params]
    err = (1 / (1 + np.exp(-(x[train] @ w + b))) - y[train]) / 6
    one = P.fit(x, y, train, ~train, [0.5], [3], epochs=1)
    shrink, step = 1 - P.RATE / 0.5, lambda g: P.RATE * g / (np.abs(g) + 1e-8)
    assert one.params[0][0] == pytest.approx(w * shrink - step(err @ x[train])) and one.params[1][0] == pytest.approx(b * shrink - step(err.sum()))
    assert len(start.params) == 2


@pytest.mark.parametrize("pieces", [1, 3, 40])
def test_running_sums_and_cuts(spark, pieces):
    """Against a plain sort: nulls, ties, infinities, empty tables, null buckets, any number of pieces."""
    from evalprobe.operators import ordering as O

    draw = random.Random(pieces)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, 1.0, 2.5, float(draw.randrange(100)), float("inf"), float("-inf")]), i) for i in range(120)]
    table = spark.createDataFrame(rows, "g string, x double, i int").repartition(3)
    want, sums, everything = {}, {}, {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        want |= {r[2]: k + 1 for k, r in enumerate(own)}
        sums |= {r[2]: sum(x[2] for x in own[: k + 1]) for k, r in enumerate(own)}
    for k, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))):
        everything[r[2]] = k + 1
    assert {r.i: r.n for r in O.running(table, ["g"], ["x", "i"], "n", pieces=pieces).collect()} == want
    assert {r.i: r.n for r in O.running(table, ["g"], ["x", "i"], "n", F.col("i"), pieces=pieces).collect()} == sums
    assert {r.i: r.n for r in O.running(table, [], ["x", "i"], "n", pieces=pieces).collect()} == everything
    assert O.running(table.limit(0), ["g"], ["x", "i"], "n").count() == 0
    sizes = lambda counts: counts.withColumns({"p": F.lit(5), "q": F.lit(1000)})
    got = {r.i: r.part for r in O.parted(table, ["g"], ["x", "i"], sizes, ["p", "q"], "rest").collect()}
    assert got == {i: "p" if k <= 5 else "q" for i, k in want.items()}


def test_running_over_repeated_rows(spark):
    from evalprobe.operators import ordering as O

    table = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)] * 3, "g string, x int").repartition(4)
    found = O.running(table, ["g"], ["x"], "n", pieces=8)
    assert found.columns == ["g", "x", "n"]
    assert sorted((r.g, r.n) for r in found.collect()) == [("a", k + 1) for k in range(50)] + [("b", k + 1) for k in range(3)]


@pytest.mark.parametrize("shape", ["outlier", "hot", "repeated", "geometric"])
def test_pieces_are_of_like_size_under_any_distribution(spark, shape):
    """One outlier of 2**60, a value in a third of the rows, equal rows, and doubling values: ranks equal row_number, no piece is above twice its share."""
    from evalprobe.operators import ordering as O

    n, pieces = 30_000, 20
    x = {"outlier": F.when(F.col("id") == 7, F.lit(1 << 60)).otherwise(F.col("id")), "hot": F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")), "repeated": F.lit(1), "geometric": F.expr("shiftleft(1L, cast(id % 62 as int))")}[shape]
    table = spark.range(n).select(F.lit("g").alias("g"), x.cast("long").alias("x"), F.xxhash64("id").alias("y"), "id")
    order = ["x"] if shape == "repeated" else ["x", "y"]
    dealt = O.dealt(table, ["g"], order, pieces)
    sizes = [r["count"] for r in dealt.groupBy("_piece").count().collect()]
    assert len(sizes) == pieces and max(sizes) <= 2 * n / pieces
    found = O.running(table, ["g"], order, "n", pieces=pieces)
    if shape == "repeated":
        assert sorted(r.n for r in found.collect()) == list(range(1, n + 1))
    else:
        w = Window.partitionBy("g").orderBy(*order)
        assert found.withColumn("w", F.row_number().over(w)).filter("n <> w").count() == 0


@pytest.mark.parametrize(("mean", "scale"), [(0.0, 1.0), (1e9, 1.0), (-3e8, 1e-3), (0.0, 1e-9)])
def test_correlation_of_any_mean_and_scale(spark, mean, scale):
    draw = np.random.default_rng(4)
    x, noise = draw.normal(size=800), draw.normal(size=800)
    y = x + 0.1 * noise
    rows = [(float(mean + scale * a), float(mean + scale * b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (2.0, None)]
    table = spark.createDataFrame(rows, "x double, y double").repartition(5)
    got = table.agg(M.correlation(F.col("x"), F.col("y")).alias("r")).first().r
    kept = np.array(rows[:-2])
    assert got == pytest.approx(np.corrcoef(kept[:, 0] - kept[0, 0], kept[:, 1] - kept[0, 1])[0, 1], abs=1e-6)


def test_correlation_without_variance_or_pairs(spark):
    for rows in ([], [(1.0, 2.0)], [(1e9, 1.0), (1e9, 2.0), (1e9, 5.0)], [(None, 1.0), (2.0, None)]):
        assert spark.createDataFrame(rows, "x double, y double").agg(M.correlation(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_equal_shares_by_rounds(spark):
    draw = random.Random(4)
    for target in (0, 1, 7, 40, 500):
        sizes = {f"b{i}": draw.randrange(1, 25) for i in range(7)}
        table = spark.createDataFrame([(b, n) for b, n in sizes.items()], "b string, size long")
        got = {r.b: r.n for r in S.equal_shares(table, "b", target).collect()}
        left, want = dict(sizes), dict.fromkeys(sizes, 0)
        while sum(want.values()) < min(target, sum(sizes.values())):
            for b in sorted((b for b in left if left[b]), key=lambda b: (-left[b], b)):
                if sum(want.values()) < target:
                    want[b] += 1
                    left[b] -= 1
        assert got == want


def test_class_targets_share_a_total():
    counts = {0: 50, 1: 50}
    assert S.class_targets(counts, {1: 30, 0: 60}) == {1: 30, 0: 50}
    assert S.class_targets(counts, {1: 30, 0: 60}, 41) == {1: 20, 0: 21}
    assert S.class_targets(counts, {1: 3, 0: 60}, 41) == {1: 3, 0: 38}
    assert S.class_targets({1: 2}, {1: 30, 0: 60}, 41) == {1: 2, 0: 0}


def test_wide_and_narrow_pooling_agree(spark, monkeypatch):
    from evalprobe.operators import vectors as X

    draw = random.Random(3)
    rows = [(i % 5, [draw.random() for _ in range(4)], i % 3 == 0 and i % 5 != 4) for i in range(40)]
    table = spark.createDataFrame(rows, "k int, vec array<double>, m boolean")
    narrow = {r.k: r.vec for r in X.pooled(table, ["k"], F.col("m"), 4).collect()}
    monkeypatch.setattr(X, "WIDE", 0)
    wide = {r.k: r.vec for r in X.pooled(table, ["k"], F.col("m"), 4).collect()}
    assert narrow.keys() == wide.keys() and narrow[4] == [0.0] * 4
    assert all(narrow[k] == pytest.approx(wide[k]) for k in narrow)


def test_images_and_their_names(spark, tmp_path):
    for name, data in (("a.png", b"\x89PNG"), ("b.jpg", b"\xff\xd8")):
        (tmp_path / name).write_bytes(data)
    images = Q.read_images(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "x/y/a.png"), (2, "b.jpg"), (3, "none.png"), (4, None)], "i int, image_name string")
    got = {r.i: r.image and bytes(r.image) for r in K.images_by_name(rows, images).collect()}
    assert got == {1: b"\x89PNG", 2: b"\xff\xd8", 3: None, 4: None}


@pytest.mark.parametrize(("most", "whole"), [(2_000_000, False), (60, False), (60, True)])
def test_phrases_as_a_table_have_the_rates_of_columns(spark, monkeypatch, most, whole):
    """Phrases inside one another, of several groups, none, null and odd texts; one automaton and several."""
    monkeypatch.setattr(C, "AUTOMATON_CHARS", most)
    draw = random.Random(8)
    words = ["cat", "concat", "a cat", "ü", "the", "(the", "end."]
    rows = [(draw.choice("pq"), i % 2, draw.choice([None, "", "\t"]) if i < 6 else "  ".join(draw.choice(words).upper() for _ in range(3))) for i in range(80)]
    table = spark.createDataFrame(rows, "dataset string, label int, text string").repartition(3)
    phrases = {"one": ["cat", "a cat"], "two": ["the end.", "ü"], "three": ["zzz"], "four": ["cat ü", "cat"]}
    asked = spark.createDataFrame([(g, p) for g, ps in phrases.items() for p in ps] + [("one", "cat"), ("five", None), ("five", "")], "group string, phrase string")
    want = {(r.dataset, r.phrase): (r.rate0, r.rate1, r.skew) for r in C.phrase_rates(table, phrases, ["dataset"], whole).collect()}
    got = {(r.dataset, r.phrase): (r.rate0, r.rate1, r.skew) for r in C.phrase_rates_of_table(table, asked, ["dataset"], whole).collect()}
    assert {k: v for k, v in got.items() if k[1] != "five"} == want and got["p", "five"] == (0.0, 0.0, 0.0)
    assert C.phrase_rates_of_table(table, asked.limit(0)).count() == 0
    monkeypatch.setattr(C, "AUTOMATON_CHARS", 3)
    with pytest.raises(ValueError, match="a group has"):
        C.phrase_rates_of_table(table, asked)


def test_reused_rewrites(spark):
    from evalprobe.operators.pairs import reused_rewrites

    questions = spark.createDataFrame([("a", " What? "), ("b", "Why?")], "unique_id string, question string")
    rows = [("a", 0, "What?"), ("a", 1, " Which "), ("a", 2, None), ("a", 3, "Which"), ("a", 4, ""), ("a", 5, "Who"), ("a", 6, "When"), ("b", 1, "x"), ("b", 0, "y"), ("c", 0, "z")]
    rewrites = spark.createDataFrame(rows, "unique_id string, idx int, text string").repartition(3)
    got = {(r.unique_id, r.variant): r.rewrite for r in reused_rewrites(questions, rewrites, 2).collect()}
    assert got == {("a", 1): "Which", ("a", 2): "Who", ("b", 1): "y", ("b", 2): "x"}
    with pytest.raises(Exception, match="only 2 rewrites, not 3, of b"):
        reused_rewrites(questions, rewrites, 3).collect()
    with pytest.raises(Exception, match="no rewrites of b"):
        reused_rewrites(questions, rewrites.filter("unique_id = 'a'"), 2).collect()


def test_seeds_differ_and_jobs_wait(spark):
    from evalprobe.operators import runs

    table = spark.range(20_000).select(F.col("id"), *(runs.seed_at(F.col("id"), k).alias(f"s{k}") for k in (0, 7)))
    found = table.collect()
    assert len({r.s0 for r in found}) == len({r.s7 for r in found}) == 20_000 and all(0 <= r.s0 < 1 << 30 for r in found)
    assert sum(r.s0 == r.s7 for r in found) < 5 and abs(np.corrcoef([r.id for r in found], [r.s0 for r in found])[0, 1]) < 0.05
    stages = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "x")], "stage_no int, stage string, family string")
    modes, models = spark.createDataFrame([(1, "m"), (2, "n")], "mode_no int, mode string"), spark.createDataFrame([("p",), ("q",)], "model string")
    jobs = runs.job_plan(stages, modes, models, (F.col("model") == "p") & (F.col("family") == "y")).collect()
    assert len(jobs) == 10 and {(r.model, r.stage_no): r.waits_for for r in jobs} == {("p", 1): None, ("p", 3): 1, ("q", 1): None, ("q", 2): 1, ("q", 3): 2}
    assert "03_02_c_n_p" in {r.tag for r in jobs}


def test_labels_of_answers_in_one_chain(spark):
    """Each label's case, the order of the rules, null answers, parsing and scores of both sides."""
    options = "A. red\nB. blue\nC. green"
    long = " because the colour of the sky over the sea at noon is what it is"
    rows = [
        (0, "mcq", options, "B", f"[[B]]{long}", f"[[B]]{long}"),
        (1, "mcq", options, "B", f"[[B]]{long}", f"[[A]]{long}"),
        (2, "mcq", options, "B", f"[[B]]{long}", f"[[B]]{long}. I cannot see the image."),
        (3, "mcq", options, "B", f"[[B]]{long}", f"[[B]]{long}\nC. Unable to determine"),
        (4, "mcq", options, "B", f"[[B]]{long}", None),
        (5, "open", "", "yes", "Yes, there is.", "yes, there is"),
        (6, "open", "", "no", "[[no]]", "not sure"),
        (7, "open", "", None, "", "I see no image here"),
    ]
    table = spark.createDataFrame(rows, "k int, task string, options string, truth string, with_text string, without_text string")
    got = {r.k: r for r in L.labelled(table).collect()}
    assert [got[k].label for k in range(8)] == ["mirage", "neutral", "non_mirage", "mirage", "neutral_missing_response", "mirage", "non_mirage", "neutral_missing_response"]
    assert [got[k].state for k in (0, 1, 2)] == ["mirage", "neutral", "non_mirage"] and got[4].mirage_like is None
    assert (got[1].with_correct, got[1].without_correct) == (True, False) and got[7].with_correct is None
    assert got[2].no_image and not got[2].uncertain and not got[3].uncertain and got[6].uncertain
    assert got[5].with_short and not got[0].with_short and got[7].with_missing
    found = L.label_summary(L.labelled(table.withColumn("d", F.lit("d"))), ["d"], ["task"]).first()
    assert (found.n, found.n_mirage, found.n_non_mirage, found.n_neutral, found.missing_pairs, found.n_questions, found.n_flips) == (8, 3, 2, 3, 2, 2, 2)


def test_naive_bayes_is_spark_ml(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import CountVectorizer

    draw = random.Random(2)
    rows = [(i, i % 2, " ".join(draw.choice("abcdefgh") + ("x" if i % 2 and draw.random() < 0.3 else "") for _ in range(12))) for i in range(80)]
    table = spark.createDataFrame(rows, "key int, label int, text string")
    train, test = table.filter("key < 60"), table.filter("key >= 60")
    one, none = F.array(F.lit(0)), F.array().cast("array<int>")
    roles = table.select("key", "label", F.array(F.lit("s")).alias("trains"), F.array(F.lit("s")).alias("tests"), F.when(F.col("key") < 60, one).otherwise(none).alias("train"), F.when(F.col("key") < 60, none).otherwise(one).alias("test"))
    own = {r.key: r.predicted for r in C.naive_bayes(roles, table, "key", 1).collect()}
    from evalprobe.functions import text as T

    grams = lambda df: df.withColumn("g", T.grams(T.tokens(F.col("text")))).withColumn("label", F.col("label").cast("double"))
    counts = CountVectorizer(inputCol="g", outputCol="features", binary=True).fit(grams(train))
    model = NaiveBayes(smoothing=1.0).fit(counts.transform(grams(train)))
    ml = {r.key: int(r.prediction) for r in model.transform(counts.transform(grams(test))).collect()}
    assert sum(own[k] != ml[k] for k in own) <= 1  # class priors are smoothed here


def test_naive_bayes_of_many_runs_is_that_of_each(spark):
    """Masks and array counts over 70 runs, more than a word of a mask holds, against a plain model of each run and scope."""
    draw = random.Random(3)
    rows = [(i, i % 2, " ".join(draw.choice("abcdef") + ("x" if i % 2 and draw.random() < 0.4 else "") for _ in range(6)), draw.choice(["p", "q"]), [r for r in range(70) if draw.random() < 0.5]) for i in range(30)]
    table = spark.createDataFrame(rows, "key int, label int, text string, set string, train array<int>")
    scopes, every = F.array("set", F.lit("all")), F.array(*map(F.lit, range(70)))
    roles = table.select("key", "label", scopes.alias("trains"), scopes.alias("tests"), "train", F.array_except(every, "train").alias("test"))
    got = {(r.scope, r.run, r.key): r.predicted for r in C.naive_bayes(roles, table.select("key", "text"), "key", 70).collect()}
    grams = lambda t: {*t.split(), *map(" ".join, zip(t.split(), t.split()[1:], strict=False))}
    for run in (0, 5, 61, 62, 69):
        for scope in ("p", "q", "all"):
            own = [r for r in rows if scope in (r[3], "all")]
            fit = [r for r in own if run in r[4]]
            counts = [collections.Counter(g for r in fit if r[1] == k for g in grams(r[2])) for k in (0, 1)]
            vocabulary = {*counts[0], *counts[1]}
            for r in (r for r in own if run not in r[4]):
                score = [math.log((sum(x[1] == k for x in fit) + 1) / (len(fit) + 2)) + sum(math.log((counts[k][g] + 1) / (sum(counts[k].values()) + len(vocabulary))) for g in grams(r[2]) & vocabulary) for k in (0, 1)]
                assert got[scope, run, r[0]] == (score[1] > score[0]) or abs(score[1] - score[0]) < 1e-9


@pytest.mark.parametrize("chunk", [3, 500])
def test_frequent_grams_are_those_of_the_full_count(spark, monkeypatch, chunk):
    """Candidates by chunks miss none, whatever the chunks; nulls, empty texts and an empty table."""
    monkeypatch.setattr(C, "CHUNK_TEXTS", chunk)
    draw = random.Random(chunk)
    rows = [(i % 2, " ".join(draw.choice(["aa", "bb", "c", "11"] + [f"w{k}" for k in range(60)]) for _ in range(8))) for i in range(247)] + [(0, None), (1, "")]
    table = spark.createDataFrame(rows, "label int, text string").repartition(5)
    n = len(rows)
    full = C.document_frequency(table, usable=True).filter(F.col("c0") + F.col("c1") >= max(4, int(0.02 * n)))
    want = {(r.gram, r.c0, r.c1) for r in full.collect()}
    assert 5 < len(want) and {(r.gram, r.c0, r.c1) for r in C.frequent_grams(table).collect()} == want
    assert C.frequent_grams(table.limit(0)).count() == 0


def test_result_payloads_and_paths(spark, tmp_path):
    row = {"feature": "f", "validation_accuracy": 0.5, "test_accuracy": 0.6}
    for name, payload in (("01_probe_all_examples/vqa_rad/a.json", [row]), ("02_x/all/b.json", {"feature_probe_accuracies": [row]}), ("03_y_all_examples/c.json", {"f": {"validation_accuracy": 0.5, "test_accuracy": 0.6}})):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(payload))
    rows = Q.path_columns(Q.payload_rows(Q.result_files(spark, str(tmp_path)))).collect()
    assert [(r.feature, r.validation_accuracy, r.test_accuracy) for r in rows] == [("f", 0.5, 0.6)] * 3
    assert sorted((r.stage, r["mode"]) for r in rows if r.stage[:2] != "03") == [("01_probe_all_examples", "vqa_rad"), ("02_x", "all")]
    assert {r["mode"] for r in rows if r.stage[:2] == "03"} == {None}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "b.json").write_text('[{"x": 1},\n {"x": 3}]')
    (tmp_path / "c.tsv").write_text("x\ty\n1\ta\n")
    assert sorted(r.x for r in Q.read_json_lines(spark, str(tmp_path / "a.jsonl"), "x long").collect() if r.x) == [1, 2]
    assert sorted(r.x for r in read_json_array(spark, str(tmp_path / "b.json"), "x long").collect()) == [1, 3]
    assert Q.read_tsv(spark, str(tmp_path / "c.tsv"), "x long, y string").first().y == "a"
    with pytest.raises(ValueError, match="missing columns"):
        Q.conformed(spark.range(1))
    built, failed = Q.registered({"good": lambda: spark.range(1), "bad": lambda: Q.conformed(spark.range(1))})
    assert list(built) == ["good"] and list(failed) == ["bad"]
    spark.range(3).write.parquet(str(tmp_path / "raw"))
    assert Q.first_found(spark, str(tmp_path / "none"), str(tmp_path / "raw")).count() == 3


def test_store_lookup_raises_on_missing(spark):
    from evalprobe.operators.vectors import looked_up

    store = spark.createDataFrame([("a", "f", [1.0])], "sig string, feature string, vec array<double>")
    with pytest.raises(Exception, match="no vector for b"):
        looked_up(spark.createDataFrame([("b",)], "sig string"), store).collect()


def test_functions_on_a_stream(spark, tmp_path):
    schema = "task string, response string, options string, truth string"
    spark.createDataFrame([("mcq", "[[A]]", "A. x", "A"), ("open", "yes", "", "no")], schema).write.parquet(str(tmp_path / "in"))
    query = parsed_answers(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("parsed").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.pred, r.correct) for r in spark.table("parsed").collect()) == [("A", True), ("yes", False)]


def test_entry_and_queries_without_the_pipeline_package():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and "nb_accuracy" in names


def test_required_images_by_name_and_configs(spark):
    rows = spark.createDataFrame([("a/b/x.png",), ("y.png",)], "image_name string")
    images = spark.createDataFrame([("x.png", b"1")], "name string, image binary")
    assert sorted((r.image_name, r.image and bytes(r.image)) for r in K.images_by_name(rows, images).collect()) == [("a/b/x.png", b"1"), ("y.png", None)]
    with pytest.raises(Exception, match="missing: image"):
        K.required(K.images_by_name(rows, images), "image").collect()
    from evalprobe.operators.reports import with_config

    files = spark.createDataFrame([("r/1/a.json",), ("r/2/a.json",)], "path string")
    configs = spark.createDataFrame([("r/1/z_config.json",), ("r/1/c_config.json",)], "path string")
    assert sorted((r.path, r.config_path) for r in with_config(files, configs).collect()) == [("r/1/a.json", "r/1/c_config.json"), ("r/2/a.json", None)]


@pytest.mark.parametrize("n", [0, 5, 78, 79, 800])
def test_first_pass_misses_no_frequent_gram_and_holds_few(n):
    """Against full counts, for texts in any order; grams of single texts go again, however many texts there are."""
    draw = random.Random(n)
    texts = [[f"t{i}", *(f"w{int(120 * draw.random() ** 3)}" for _ in range(6))] for i in range(n)]
    texts.sort(key=lambda t: t[1] * (n % 2))
    counts = collections.Counter(g for t in texts for g in {*t, *map(" ".join, zip(t, t[1:], strict=False))})
    found = C._often(0.016)(iter(texts))
    assert len(found) == len(set(found)) and {g for g, c in counts.items() if c >= 0.016 * n} <= set(found) <= set(counts)
    assert n < 400 or all(counts[g] > 1 for g in found)


def test_phrases_with_blanks_around_words(spark):
    rows = spark.createDataFrame([(0, "It  MAY be"), (0, "mayor"), (1, "so may"), (1, None)], "label int, text string")
    rates = lambda whole: C.phrase_rates(rows, {"g": ["may"]}, whole_words=whole).first()
    assert (rates(False).rate0, rates(True).rate0, rates(True).rate1) == (1.0, 0.5, 0.5)


def test_last_tokens_are_not_sorted(spark):
    """The vector of one row, ties and all, by a hash aggregation; other lengths are left out, wide vectors go the other way."""
    rows = [("a", 0, [9.0, 9.0]), ("a", 2, [1.0, None]), ("a", 1, [3.0, 4.0]), ("a", 5, [7.0]), ("b", -1, [5.0, 6.0]), (None, 0, [1.0, 1.0])]
    tokens = spark.createDataFrame(rows, "k string, tok_idx int, vec array<double>")
    found = X.last_token(tokens, ["k"], dims=2)
    assert {r.k: r.vec for r in found.collect()} == {"a": [1.0, None], "b": [5.0, 6.0], None: [1.0, 1.0]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    wide = spark.createDataFrame([("a", i, [float(i)] * 65) for i in range(3)], "k string, tok_idx int, vec array<double>")
    assert X.last_token(wide, ["k"], dims=65).first().vec == X.last_token(wide, ["k"]).first().vec == [2.0] * 65


def test_cosine_of_texts_holds_few_texts_at_a_time():
    """Words of UTF-8 against words by characters, over more pairs than a slice; memory does not follow what is handed over at once."""
    import tracemalloc

    import pyarrow as pa

    word = lambda t: collections.Counter(re.findall("[a-z0-9]+", t or ""))
    texts = [("liver é2 ünd liver", "liver und"), (None, "x"), ("", ""), ("\u212a 没有 k1_k2", "k1 k2 é")] * 50
    dot = lambda a, b: sum(n * b[w] for w, n in a.items())
    want = [dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) if a and b else 0.0 for a, b in ((word(a), word(b)) for a, b in texts)]
    sides = [pa.array([t if t is None else t.encode() for t in side], pa.binary()) for side in zip(*texts, strict=True)]
    assert L._bag_cosine.func(*sides).to_pylist() == pytest.approx(want)
    long = pa.array([b"word other " * 500] * 2000, pa.binary())
    tracemalloc.start()
    L._bag_cosine.func(long, long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000


def test_runs_that_stopped_take_no_part(monkeypatch):
    """The parameters of each run are those of the run alone, whatever the blocks; a run that has stopped costs nothing more."""
    draw = np.random.default_rng(2)
    x, y, train = draw.normal(size=(90, 3)), draw.random(90) > 0.5, np.arange(90) < 60
    cs, seeds = [0.0, 0.01, 1.0], [5, 6, 7]
    monkeypatch.setattr(P, "PATIENCE", 3)
    taking, gradients = [], P.Probes.gradients
    monkeypatch.setattr(P.Probes, "gradients", lambda self, *a: taking.append(len(self.params[1])) or gradients(self, *a))
    for hidden in (0, 4):
        taking.clear()
        found = P.fit(x, y.astype(int), train, ~train, cs, seeds, hidden, 60)
        assert taking[0] == 3 and taking == sorted(taking, reverse=True) and 0 < taking[-1] < 3
        monkeypatch.setattr(P, "BLOCK", 1)
        for i in range(3):
            alone = P.fit(x, y.astype(int), train, ~train, cs[i : i + 1], seeds[i : i + 1], hidden, 60)
            assert all(np.allclose(a[0], p[i]) for a, p in zip(alone.params, found.params, strict=True))
        monkeypatch.undo()
        monkeypatch.setattr(P, "PATIENCE", 3)
        monkeypatch.setattr(P.Probes, "gradients", lambda self, *a: taking.append(len(self.params[1])) or gradients(self, *a))


def test_texts_that_are_only_tested_are_not_stored(spark, monkeypatch):
    """They meet the stored counts where they are divided; by a shuffle if the counts are large; texts of both kinds count once in each."""
    rows = [(i, i % 2, f"both {'x' if i % 2 else 'y'} w{i}", [0] if i < 6 else [], [0] if i > 3 else []) for i in range(40)]
    table = spark.createDataFrame(rows, "key int, label int, text string, train array<int>, test array<int>")
    roles = table.select("key", "label", F.array(F.lit("s")).alias("trains"), F.array(F.lit("s")).alias("tests"), "train", "test")
    held, stored = {}, C.stored
    monkeypatch.setattr(C, "stored", lambda t, name: held.setdefault(name, stored(t, name)))
    found = C.naive_bayes(roles, table.select("key", "text"), "key", 1)
    assert {r.key for r in held["bayes-grams"].select("key").distinct().collect()} == set(range(6))
    got = {r.key: r.predicted for r in found.collect()}
    assert got == {i: i % 2 for i in range(4, 40)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        held.clear()
        assert {r.key: r.predicted for r in C.naive_bayes(roles, table.select("key", "text"), "key", 1).collect()} == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
