"""Bloom filters and the keyed store: same rows as plain joins, and plans that move no more than they must."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalprobe.operators import bloom
from evalprobe.operators import keys as K
from evalprobe.operators.vectors import looked_up, requested
from evalprobe.sources.store import open_store, read_store, write_store


@pytest.fixture
def shuffled(spark):
    """No broadcast by size, so that a plan shows what a large table would do."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_bloom_joins_are_exact(spark, bits):
    """Small filters let many rows through, and change nothing; null keys are in no set; empty sets and tables."""
    rows = spark.range(3000).select(F.when(F.col("id") % 50 != 0, F.col("id").cast("string")).alias("k"), "id")
    keys = spark.range(0, 9000, 3).select(F.col("id").cast("string").alias("k"))
    keys = keys.unionByName(keys.limit(10)).unionByName(spark.createDataFrame([(None,)], "k string"))
    inside = {i for i in range(3000) if i % 3 == 0 and i % 50}
    assert {r.id for r in bloom.semi(rows, keys, ["k"], bits).collect()} == inside
    assert {r.id for r in bloom.anti(rows, keys, ["k"], bits).collect()} == set(range(3000)) - inside
    assert bloom.anti(rows, keys.limit(0), ["k"], bits).count() == 3000 and bloom.semi(rows.limit(0), keys, ["k"], bits).count() == 0
    let = bloom.maybe(rows, ["k"], bloom.built(keys, ["k"], bits), bits=bits).filter("_maybe").count()
    assert let >= len(inside) and (bits < 1 << 20 or let < len(inside) + 60)
    assert bloom.built(keys, ["k"], bits).count() <= bits / 32768


def test_only_rows_that_may_be_in_the_set_are_shuffled(spark, shuffled, tmp_path):
    spark.range(20_000).select(F.col("id").cast("string").alias("sig"), F.repeat(F.lit("x"), 50).alias("text")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    train = spark.range(100).select(F.col("id").cast("string").alias("sig"))
    assert bloom.anti(rows, train, ["sig"]).count() == 19_900
    # what the filter rules out goes through broadcasts alone: the only exchanges of its branch are those of the filter's pages
    free = bloom.maybe(rows, ["sig"], bloom.built(train, ["sig"])).filter("NOT _maybe")
    moved = [line for line in plan(free).split("\n") if "Exchange hashpartitioning" in line]
    assert moved and all("hashpartitioning(page" in line or "hashpartitioning(_group" in line for line in moved), moved


def test_overlap_against_plain_sets(spark):
    train = spark.createDataFrame([("a", "1", "q1"), ("a", " 2 ", ""), ("", "3", "q3"), ("b", None, "q1")], "dataset string, unique_id string, question_id string")
    pool = [("a", "1", "q9"), ("a", "2", "q1"), ("a", "7", "q1"), ("b", "1", "q1"), ("b", "1", "q2"), ("", "3", "q3"), ("a", " ", ""), (None, "1", "q1"), ("a", None, None)]
    found = K.overlap_reason(train, spark.createDataFrame(pool, "dataset string, unique_id string, question_id string"))
    got = [((r.dataset, r.unique_id, r.question_id), r.reason) for r in found.collect()]
    want = dict(zip(pool, ["uid", "uid", "qid", "qid", None, None, None, None, None], strict=True))
    assert len(got) == len(pool) and dict(got) == want


def test_added_rows(spark):
    row = "sig string, src_ord int"
    found = K.added(spark.createDataFrame([("a", 1), ("a", 0), ("b", 5)], row), spark.createDataFrame([("b", 0), ("c", 9), ("c", 8)], row))
    assert sorted((r.sig, r.src_ord) for r in found.collect()) == [("a", 0), ("b", 5), ("c", 8)]


def test_store_is_not_moved(spark, shuffled, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "with").otherwise("without").alias("mode"), F.concat(F.lit("f"), F.col("id") % 3).alias("feature"), (F.col("id") % 700).cast("string").alias("sig"), F.array(F.col("id") * 1.0).alias("vec"))
    write_store(rows, path, buckets=8)
    keys = spark.range(0, 700, 7).select(F.col("id").cast("string").alias("sig"))
    found = read_store(spark, path, "with", ["f1", "f2"], keys)
    want = {(r.feature, r.sig) for r in rows.filter("mode = 'with' AND feature IN ('f1', 'f2') AND sig % 7 = 0").collect()}
    got = [(r.feature, r.sig) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    lines = plan(found).split("== Initial Plan ==")[-1].split("\n")
    assert any("Bucketed: true" in line for line in lines)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(k for k, line in enumerate(lines) if "Scan parquet" in line and "feature" in line)
    above, least = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < least:
            above.append(line)
            least = depth(line)
    assert len(above) > 1 and not any("Exchange" in line for line in above)
    # another session opens it by its settings
    spark.sql("DROP TABLE " + [t.name for t in spark.catalog.listTables() if t.name.startswith("store_")][0])
    assert open_store(spark, path).count() == rows.dropDuplicates(["mode", "feature", "sig"]).count()


def test_lookup_in_two_stores_shuffles_the_keys_once(spark, shuffled, tmp_path):
    base = spark.range(300).select(F.lit("with").alias("mode"), F.lit("f").alias("feature"), F.col("id").cast("string").alias("sig"), F.array(F.col("id") * 1.0).alias("vec"))
    write_store(base.filter("sig % 2 = 0"), str(tmp_path / "one"), buckets=8)
    write_store(base.filter("sig % 3 = 0"), str(tmp_path / "two"), buckets=8)
    one, two = (open_store(spark, str(tmp_path / n)) for n in ("one", "two"))
    wanted = spark.range(60).select(F.col("id").cast("string").alias("sig"))
    found = K.with_fallback(wanted, "sig", ("one", one), ("two", two))
    got = {r.sig: (r.store, r.vec and r.vec[0]) for r in found.collect()}
    assert got == {str(i): ("one", i) if i % 2 == 0 else ("two", i) if i % 3 == 0 else (None, None) for i in range(60)}
    assert plan(found).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    with pytest.raises(Exception, match="no vector for"):
        looked_up(wanted, two.select("sig", "vec")).collect()


def test_requested_features(spark):
    names = ["language_model/layer_1__a", "language_model/layer_2__a", "language_model/layer_1/mlp__a", "language_model/layer_1/attention_head_3__b", "language_model/layer_3/post_attention__a", "language_model/all_layers_concat__a", "language_model/layer_1__c", "plain"]
    table = spark.createDataFrame([(n,) for n in names], "f string")
    ask = lambda **flags: [names.index(r.f) for r in table.filter(requested(F.col("f"), ("a", "b", "c"), **flags)).collect()]
    assert ask() == [0, 1, 5, 6] and ask(mlp=True, strategies="a") == [0, 1, 2, 5] and ask(attention=True, residual=False) == [3, 4]
    assert ask(strategies=("a",), odd_layers=True, attention=True) == [0, 4, 5]
    with pytest.raises(ValueError, match="not z"):
        ask(strategies="a, z")
    with pytest.raises(ValueError, match="some of"):
        ask(strategies=" , ")
