"""Rows by hand for the text functions: answer forms, acknowledgements, rewrites, images, names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalprobe.functions import text as T
from evalprobe.sources import questions as Q


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


OPTIONS = "A. liver\nb) Spleen \n C: kidney\nnot one\nA. heart"


def test_options_and_letters(spark):
    got = column(spark, [OPTIONS, None, "x"], T.option_map)
    assert got == [{"A": "heart", "B": "Spleen", "C": "kidney"}, {}, {}]
    answers = ["so [[ b ]]", "Final answer: C", "Option D", "A) because", "it is the SPLEEN", "", None, "nothing", "answer - e, option c"]
    assert column(spark, answers, lambda x: T.option_letter(x, F.lit(OPTIONS))) == ["B", "C", "D", "A", "B", None, None, None, "E"]


def test_open_answers(spark):
    said = ["x [[ left\nlung ]]", "[[ ]] Final answer: the liver \nmore", "Well, Yes it is", " - \n - first line", "", None]
    assert column(spark, said, T.open_answer) == ["left\nlung", "the liver", "Yes", "first line", None, None]
    assert column(spark, ["Yes.", ' "No" ', "y", "TRUE", "yes, there is", "[[Left  Lung!]]", "...", None], T.normal_open) == ["yes", "no", "yes", "yes", "yes there is", "left lung", None, None]


@pytest.mark.parametrize(("task", "pred", "truth", "want"), [("mcq", "b", "B", True), ("mcq", "b", "C", False), ("mcq", None, "C", None), ("open", "yes, there is", "yes", True), ("open", "maybe", "no", False), ("open", "!!", "yes", None), ("open", "Left lung", "left  lung.", True)])
def test_correctness(spark, task, pred, truth, want):
    row = spark.createDataFrame([(task, pred, truth)], "t string, p string, g string")
    assert row.select(T.correct(F.col("t"), F.col("p"), F.col("g"))).first()[0] is want


def test_acknowledgement_ignores_options(spark):
    said = ["I cannot see the image.", "B. Unable to determine", "- option b) not sure\nC. x", "We are not sure.", "A. liver\nIt is (b) unable to determine, so not sure", "没有图片", None]
    assert column(spark, said, lambda x: T.mentions(x, T.NO_IMAGE))[:4] == [True, False, False, False]
    assert column(spark, said, lambda x: T.mentions(x, T.UNCERTAIN)) == [False, False, False, True, True, False, False]


def test_counts_tokens_and_marks(spark):
    assert column(spark, ["a b  c", "", None], T.word_count) == [3, 0, 0]
    assert column(spark, ["A b_1 [[x]] b"], lambda x: T.grams(T.tokens(x))) == [["a", "b_1", "[[x]]", "b", "a b_1", "b_1 [[x]]", "[[x]] b"]]
    assert column(spark, ["[[a]] then [[ B  c ]]", "none", "[[" + "z" * 50 + "]]"], T.final_answer) == ["B c", "", "z" * 40]
    assert column(spark, ["x <THINK> why\n</think> y", "no"], T.reasoning) == ["why", None]
    assert column(spark, ["the fact"], lambda x: T.says(x, F.lit("ct"))) == [True] and column(spark, ["the fact"], lambda x: T.says(x, F.lit("ct"), True)) == [False]


def test_rewrites(spark):
    question = F.lit("What is it?")
    said = ['```json\n{"mutations": ["a", "What is it?", "b", "c"]}\n```', 'Sure {"mutations": ["a", " a ", "b"]} ok', "1. one\n* two\n", "", None]
    got = column(spark, said, lambda x: T.rewrites(x, question, 2))
    assert got[:3] == [["a", "b"], ["a", "b"], ["one", "two"]]
    assert got[3] == got[4] == ["Please what is it?", "What is it? Please answer briefly."]


def test_features_and_cells(spark):
    names = ["language_model/layer_12__mean", "language_model/layer_3/mlp__last", "language_model/layer_4/attention_head_7__max", "language_model/layer_5/post_attention__mean", "language_model/all_layers_concat__mean", "other"]
    assert column(spark, names, T.family) == ["residual", "mlp", "attention", "post_attention", "concat", "unknown"]
    assert column(spark, names, T.layer) == [12, 3, 4, 5, None, None] and column(spark, names, T.head)[2] == 7 and column(spark, names, T.strategy)[5] == ""
    assert column(spark, [0.5, None], T.percent, "double") == ["50.00%", "N/A"] and column(spark, [-0.082], T.signed_percent, "double") == ["-8.2%"]
    assert column(spark, ["x", "1.5"], lambda x: T.number(x, F.lit("2"))) == [2.0, 1.5]


def test_benchmark_and_images(spark):
    assert column(spark, ["A MICROSCOPY IMAGE", "radiologist", None], T.benchmark) == ["microvqa", "vqa_rad", "unknown"]
    assert column(spark, [b"\xff\xd8\xff\xe0", b"RIFF\0\0\0\0WEBP", b"x"], T.mime, "binary") == ["image/jpeg", "image/webp", "image/jpeg"]


def test_option_sources(spark):
    raw = ['{"A": "x", "B": "y"}', '["x", "y"]', "['x', 'y']", '["A: x", "B: y"]', "[" + ",".join(f'"o{i}"' for i in range(12)) + "]"]
    got = column(spark, raw, Q.choices)
    assert got[:4] == [{"A": "x", "B": "y"}] * 4 and len(got[4]) == 10
    rows = spark.createDataFrame([("b",), ("A: x",), ("Y",), ("zz",)], "a string")
    assert [r[0] for r in rows.select(Q.label_of(F.col("a"), F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.lit("y")))).collect()] == ["B", "A", "B", None]


def test_words_of_ascii_end_at_other_letters(spark):
    """As in RE2, whatever the Java version; escaped backslashes and the text of a class stay."""
    said = ["Undöschpf", "und", "x_und", "öund, da", "rund", "", None]
    found = lambda x: T.mentions(x, (r"\bund\b",), in_options=True, ascii_words=True)
    assert column(spark, said, found) == [True, True, False, True, False, False, False]
    assert column(spark, [r"a\b", "rund", "und"], lambda x: T.mentions(x, (r"\\b", r"\Bund"), in_options=True, ascii_words=True)) == [True, True, False]


def test_stated_patterns_of_texts_beyond_ascii(spark, tmp_path):
    from evalprobe.plans.answers import f9_stated_patterns

    texts = ["gesch. | Undääach |", "rund", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.mentions for r in f9_stated_patterns(spark, str(tmp_path)).collect()} == {0: True, 1: False, 2: None}


def test_patterns_are_branches_of_one(spark):
    """One search a list; patterns that refer to groups stay alone, so that their numbers hold."""
    assert len(T._merged(list(T.NO_IMAGE))) == 1 and T._merged([]) == []
    said = ["B. no image", "no image", "aa", "ab", "x|y", None]
    assert column(spark, said, lambda x: T.mentions(x, (r"(no) image", r"(a)\1", r"x\|y"))) == [False, True, True, False, True, False]
