"""Spelling variants against plain Python: all pairs by their edits, forms and roots; nulls, repeats, ties, long texts, empty tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from evalprobe.llm import spelling
from evalprobe.llm.common import stored

DOCS = "doc_id long, text string, word string, n long, key long"


def brute(texts):
    counts = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near, replaced = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            replaced[i, less].add(w)
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in replaced.values():
        for w in group:
            near[w] |= group - {w}
    forms = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[w]:
                forms[w] = best
    out = {}
    for w in words:
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, words[w], len(near[w]), words[forms[w]] if w in forms else None)
    return out


def found(spark, texts):
    rows = [(i, t, "clash", 1, 2) for i, t in texts]
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.grouped(spark.createDataFrame(rows, DOCS).repartition(3), spelling.mistyped).collect()}


def test_words_of_few_letters_have_many_neighbours(spark):
    """Runs of one letter, where a pair meets under several quarters; A to Z alone are lower-cased; all lengths and places of edits."""
    draw = random.Random(1)
    texts = [(i, " ".join("".join(draw.choice("aAbÀ") for _ in range(draw.randrange(6, 10))) for _ in range(3000))) for i in range(5)]
    texts += [(None, "aaaaaaa aaaaaaaa aaaaaaaa"), (None, "aaaaaaa aaaaaaaa aaaaaaaa"), (7, None), (8, ""), (9, "aĀbcdefghi 一 1234567")]
    want = brute(texts)
    assert len(want) > 100 and found(spark, texts) == want


def test_chains_of_forms_and_ties(spark):
    """A word's form may have a form itself; of equally frequent near words the smallest wins; one times ten is enough, nine is not."""
    words = {"abcdefgh": 2000, "abcdefgx": 200, "abcdefyx": 20, "abcdezyx": 2, "mnopqrst": 2, "mnopqrsu": 20, "mnopqrsv": 20, "tuvwxyz": 2, "tuvwxyza": 19}
    found = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert found["abcdezyx"] == ("abcdefyx", "abcdefgh", 1) and found["abcdefyx"] == ("abcdefgx", "abcdefgh", 2)
    assert found["mnopqrst"] == ("mnopqrsu", "mnopqrsu", 2) and found["tuvwxyz"] == (None, "tuvwxyz", 1)
    assert found["abcdefgh"] == (None, "abcdefgh", 1)


def test_real_words_repeated_rows_and_long_texts(spark):
    draw = random.Random(3)
    stems = ["".join(draw.choice(["in", "er", "tion", "ou", "th", "an"]) for _ in range(draw.randrange(3, 6))) for _ in range(150)]
    texts = [(i, " ".join(draw.choice(stems) for _ in range(300))) for i in range(60)]
    texts += texts[:5] + [(100, " ".join(draw.choice(stems) for _ in range(60_000)))]
    want = brute(texts)
    assert any(w[0] for w in want.values()) and found(spark, texts) == want


def test_empty_table(spark):
    assert found(spark, []) == {}
    assert spelling.near(spark.createDataFrame([], "word string, n long")).count() == 0


def test_stored_words_are_never_broadcast(spark):
    """However small their file: as grams they take a hundred times its size on the driver."""
    words = stored(spark.createDataFrame([("abcdefgh", 20), ("abcdefgx", 2)], "word string, n long"), "test-words")
    for table in (spelling.near(words), spelling.variants(words)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        table.collect()
