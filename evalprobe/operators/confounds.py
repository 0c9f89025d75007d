"""Text confounds: phrase rates, n-gram log-odds and a Naive Bayes text probe with many runs in one job."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import matched, running, small
from .storage import stored

# Phrases by group.
PHRASES = {
    "uncertainty": ["cannot determine", "cannot be determined", "can't determine", "can't tell", "not possible", "impossible", "insufficient", "uncertain", "unsure", "unable to determine", "definitively determine", "image alone", "without more information", "without additional"],
    "answer_boilerplate": ["the correct answer is", "correct answer is", "answer is", "therefore", "final answer", "[["],
    "reasoning_scaffold": ["we need", "to determine", "the question asks", "among the options", "option a", "option b", "option c", "option d", "option e"],
    "image_grounding": ["based on the image", "based on the provided image", "in the image", "the image shows", "shown in the image", "visible", "appears", "visual evidence"],
    "hedging": ["likely", "suggests", "consistent with", "however", "may", "could"],
    "radiology_terms": ["ct", "mri", "x-ray", "radiograph", "contrast", "lesion", "mass"],
}


def phrase_rates(examples: DataFrame, phrases: dict[str, list[str]], by: list[str] | None = None, whole_words: bool = False) -> DataFrame:
    """Per group of phrases: the share of texts of each class with one of them, and the skew. Phrases are columns: one pass, no join."""
    by = by or []
    pad = (lambda c: F.concat(F.lit(" "), c, F.lit(" "))) if whole_words else (lambda c: c)
    hit = lambda ps: F.exists(F.array(*(pad(F.lit(p)) for p in ps)), lambda p: F.contains(F.col("_said"), p))
    # squeezed once a text, not once a phrase
    rows = examples.withColumn("_said", pad(F.lower(T.squeeze(F.col("text"))))).select(*by, "label", F.explode(F.array(*(F.struct(F.lit(g).alias("g"), hit(ps).cast("int").alias("h")) for g, ps in phrases.items()))).alias("x"))
    rates = rows.groupBy(*by, F.col("x.g").alias("phrase")).agg(*(F.avg(F.when(F.col("label") == k, F.col("x.h"))).alias(f"rate{k}") for k in (0, 1)))
    return rates.withColumn("skew", F.coalesce("rate1", F.lit(0.0)) - F.coalesce("rate0", F.lit(0.0)))


#: Characters of the phrases in one automaton, which every worker builds: some hundred bytes of memory each.
AUTOMATON_CHARS = 2_000_000


def _tables(phrases: DataFrame, most: int) -> Iterator[list[tuple[str, int]]]:
    """``phrases`` (phrase, number) in tables of about ``most`` characters and twice that at most; a group stays whole."""
    own = phrases.filter("phrase <> ''").distinct().withColumn("chars", F.char_length("phrase"))
    sizes = own.groupBy("number").agg(F.sum("chars").alias("size"))
    placed = running(sizes, [], ["number"], "end", F.col("size")).withColumn("slice", F.floor((F.col("end") - F.col("size")) / most))
    placed = stored(own.join(placed, "number").select("slice", "phrase", "number", "size"), "confounds-phrases")
    last, size = placed.agg(F.max("slice"), F.max("size")).first()
    if last is not None and size > most:
        raise ValueError(f"a group has phrases of {size} characters, more than {most}")
    for k in range(0 if last is None else last + 1):
        yield [(r.phrase, r.number) for r in placed.filter(F.col("slice") == k).select("phrase", "number").collect()]


def _searched(table: list[tuple[str, int]], whole_words: bool):
    """From rows with the text in the last column to a row for each group that the text names, with the group's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        numbers: dict[str, set[int]] = {}
        for phrase, number in table:
            numbers.setdefault(f" {phrase} " if whole_words else phrase, set()).add(number)
        automaton = ahocorasick.Automaton()
        for phrase, own in numbers.items():
            automaton.add_word(phrase, tuple(own))
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                own: set[int] = set()
                for _, hit in automaton.iter(f" {text} " if whole_words else text):
                    own.update(hit)
                rows += [k] * len(own)
                found += own
            kept = batch.select(batch.schema.names[:-1]).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.int64())], names=[*kept.schema.names, "number"])

    return run


def phrase_rates_of_table(examples: DataFrame, phrases: DataFrame, by: list[str] | None = None, whole_words: bool = False) -> DataFrame:
    """``phrase_rates`` for a table of phrases (``group``, ``phrase``): all of them are looked for in one pass over each text.

    An automaton of the phrases is built once in each worker. Groups beyond ``AUTOMATON_CHARS`` characters of phrases go
    into further automata, with a pass for each; a single group of more raises. Every group has a row for every value of
    ``by``. A null or empty phrase is in no text, a null text holds none, an empty table of phrases gives no rows.
    """
    by = by or []
    groups = stored(running(phrases.select("group").distinct().filter("group IS NOT NULL"), [], ["group"], "number"), "confounds-groups")
    texts = examples.select(*by, "label", F.lower(T.squeeze(F.col("text"))).alias("_text"))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in texts.drop("_text").dtypes)
    hits = examples.select(*by, "label").withColumn("number", F.lit(0).cast("long")).limit(0)
    for table in _tables(phrases.join(groups, "group").select("phrase", "number"), AUTOMATON_CHARS):
        hits = hits.unionByName(texts.mapInArrow(_searched(table, whole_words), f"{kinds}, number long"))
    counts = hits.groupBy(*by, "number").agg(*(F.count_if(F.col("label") == k).alias(f"h{k}") for k in (0, 1)))
    sizes = examples.groupBy(*by).agg(*(F.count_if(F.col("label") == k).alias(f"n{k}") for k in (0, 1)))
    joined = matched(sizes.crossJoin(groups), counts, [*by, "number"], "left")  # the cross join has the result's rows
    rate = lambda k: F.try_divide(F.coalesce(f"h{k}", F.lit(0)).cast("double"), F.col(f"n{k}").cast("double")).alias(f"rate{k}")
    rates = joined.select(*by, F.col("group").alias("phrase"), rate(0), rate(1))
    return rates.withColumn("skew", F.coalesce("rate1", F.lit(0.0)) - F.coalesce("rate0", F.lit(0.0)))


def text_summary(examples: DataFrame, by: list[str]) -> DataFrame:
    """Mean and median number of tokens, and rates of option lists and of final answers in brackets."""
    n = F.size(T.tokens(F.col("text")))
    return examples.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_tokens"), F.median(n).alias("median_tokens"), F.round(F.avg(T.has_options(F.col("text")).cast("int")), 6).alias("option_rate"), F.round(F.avg(T.has_bracket(F.col("text")).cast("int")), 6).alias("bracket_rate"))


def frequent_answers(rows: DataFrame, by: list[str], answer: str, order: str, k: int = 10) -> DataFrame:
    """The most frequent answers, ties to the one seen first; blanks do not count."""
    counts = rows.filter(F.col(answer) != "").groupBy(*by, answer).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("seen"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("seen")


def document_frequency(examples: DataFrame, by: list[str] | None = None, usable: bool = False) -> DataFrame:
    """Texts of each class that hold a gram of one or two tokens; ``usable`` leaves out single characters and digits."""
    own = T.grams(F.col("tokens"))
    if usable:
        own = F.filter(own, lambda g: (F.length(g) > 1) & ~g.rlike("^[0-9]+$"))
    return examples.select(*(by or []), "label", T.tokens(F.col("text")).alias("tokens")).select(*(by or []), "label", F.explode(own).alias("gram")).groupBy(*(by or []), "gram").agg(F.count_if(F.col("label") == 0).alias("c0"), F.count_if(F.col("label") == 1).alias("c1"))


#: The part of the wanted share by which a count of the first pass may be too high: a larger part means fewer texts at a time.
SLACK = 0.8
#: Texts that a worker holds as Python objects at a time; what Spark hands over at once (64 MB) would take many times its size.
CHUNK_TEXTS = 32


def _often(share: float) -> Callable[[Iterator[list[str]]], list[str]]:
    """Finds every gram that ``share`` of the texts it is given may hold, and others, in one pass (lossy counting).

    Texts are counted by themselves in rounds of ``1 / (SLACK * share)``. A gram's bound is what was counted since it was
    first kept and the rounds before that; after each round the grams with a bound no larger than the number of rounds
    go. A gram that is not kept was thus in no more texts than there were rounds, a kept one in no more than its bound.
    """
    size = max(1, math.ceil(1 / (SLACK * share)))

    def found(texts: Iterator[list[str]]) -> list[str]:
        bound: dict[str, int] = {}
        rounds = n = 0
        while own := list(itertools.islice(texts, 1)):
            counts: Counter[str] = Counter()
            for tokens in itertools.chain(own, itertools.islice(texts, size - 1)):
                counts.update({*tokens, *map(" ".join, zip(tokens, tokens[1:], strict=False))})
                n += 1
            for gram, c in counts.items():
                counts[gram] = bound.pop(gram, rounds) + c
            if n < (rounds + 1) * size:  # the last round is not full: none may go that a share of so few texts may hold
                return [g for known in (counts, bound) for g, c in known.items() if c >= share * n]
            rounds += 1
            bound = {g: c for known in (bound, counts) for g, c in known.items() if c > rounds}
        return [g for g, c in bound.items() if c >= share * n]

    return found


def candidates(texts: DataFrame, share: float) -> DataFrame:
    """Every ``gram`` that more than ``share`` of all texts may hold, and others: none is missed.

    A gram that a share of all texts holds is held by that share of at least one task's texts, however these are
    divided. So each task passes on what may reach the share there (``_often``), and holds the grams of few texts at a time.
    """

    often = _often(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.column(0).slice(k, CHUNK_TEXTS) for b in batches for k in range(0, b.num_rows, CHUNK_TEXTS))
        found = often(tokens or [] for own in slices for tokens in own.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["gram"])

    return texts.select(T.tokens(F.col("text")).alias("tokens")).mapInArrow(run, "gram string").distinct()


def frequent_grams(examples: DataFrame, share: float = 0.02, least: int = 4) -> DataFrame:
    """``document_frequency`` of the usable grams that ``share`` of all texts (rounded down), and ``least`` at least, hold.

    Two passes: candidates by task, then exact counts of the candidates alone, so that only rows of grams that may
    reach the threshold are shuffled. The candidates are stored; from the size of that table the planner broadcasts it
    to the texts' grams, or else joins by shuffle.
    """
    # the threshold is share times the texts, rounded down, and ``least`` or more: never below this part of the unrounded one
    few = small(candidates(examples, share * least / (least + 1)).filter((F.length("gram") > 1) & ~F.col("gram").rlike("^[0-9]+$")))
    sizes = examples.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    tokens = examples.select("label", T.tokens(F.col("text")).alias("tokens"))
    grams = tokens.select("label", F.explode(T.grams(F.col("tokens"))).alias("gram")).join(few, "gram", "left_semi")
    df = grams.groupBy("gram").agg(F.count_if(F.col("label") == 0).alias("c0"), F.count_if(F.col("label") == 1).alias("c1")).crossJoin(F.broadcast(sizes))  # sizes is one row
    return df.filter(F.col("c0") + F.col("c1") >= F.greatest(F.lit(least), F.floor(F.lit(share) * (F.col("n0") + F.col("n1")))))


def log_odds(examples: DataFrame) -> DataFrame:
    """Smoothed log-odds of the grams that 2 % of the texts, and four at least, hold."""
    p = lambda k: (F.col(f"c{k}") + 0.5) / (F.col(f"n{k}") + 1.0)
    return frequent_grams(examples).select("gram", "c0", "c1", F.round(F.ln(p(1) / (1 - p(1))) - F.ln(p(0) / (1 - p(0))), 6).alias("log_odds"))


def top_grams(odds: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` grams that speak most for each class, ties in descending order of the gram; two merged top-ns."""
    for1 = odds.withColumn("score", F.col("log_odds")).orderBy(F.desc("score"), F.desc("gram")).limit(k).withColumn("label", F.lit(1))
    for0 = odds.withColumn("score", -F.col("log_odds")).orderBy(F.desc("score"), F.desc("gram")).limit(k).withColumn("label", F.lit(0))
    return for1.unionByName(for0)


#: Runs in one word of a mask.
_BITS = 62


def _words(runs: int) -> int:
    return -(-runs // _BITS)


def _mask(numbers: str, word: int) -> Column:
    """The runs of an array of numbers that fall into a word, as bits."""
    own = F.filter(numbers, lambda r: F.floor(r / _BITS) == word)
    return F.aggregate(F.array_distinct(own), F.lit(0).cast("long"), lambda m, r: m + F.call_function("shiftleft", F.lit(1).cast("long"), (r % _BITS).cast("int")))


def _bit(mask: str, run: int) -> Column:
    return F.call_function("shiftright", F.col(f"{mask}{run // _BITS}"), F.lit(run % _BITS)) % 2


def naive_bayes(rows: DataFrame, texts: DataFrame, key: str, runs: int) -> DataFrame:
    """Predictions of multinomial models over distinct grams with add-one counts, one for each scope and run, all in one job.

    ``rows`` says who takes part: ``key``, ``label``, ``trains`` and ``tests``, the scopes (names, say of data sets) in
    which a text trains or is tested, and ``train`` and ``test``, the numbers below ``runs`` of the runs in which it does
    so. ``texts`` holds ``key`` and ``text``. Result: ``scope``, ``run``, ``key``, ``label``, ``predicted``.

    Every text is divided into grams once, whatever the number of runs: its runs are a bit mask on the row, a gram's
    counts are arrays over all runs, and so are a tested text's sums. Grams that a run's training does not know drop
    out, ties go to class 0, a scope and run without training texts have no model.

    Grams of texts that train are stored, as counts and tests read them. Texts that are only tested, often nearly all,
    meet the stored counts where they are divided if the planner finds these small enough, else by a shuffle.
    """
    every = range(runs)
    masks = {f"_a{w}": _mask("train", w) for w in range(_words(runs))} | {f"_b{w}": _mask("test", w) for w in range(_words(runs))}
    rows = stored(rows.select(key, "label", "trains", "tests", "test", "train").withColumns(masks), "bayes-rows")
    own = rows.drop("train", "test")
    # dividing a text costs far more than moving it: the texts that take part are dealt out evenly first
    taking = texts.select(key, "text").join(own, key).repartition(key).select(*own.columns, T.tokens(F.col("text")).alias("tokens"))
    trains, tests = (" OR ".join(f"_{k}{w} <> 0" for w in range(_words(runs))) for k in "ab")
    divided = lambda own: taking.filter(own).select(*taking.columns[:-1], F.explode(T.grams(F.col("tokens"))).alias("gram"))
    grams = stored(divided(trains), "bayes-grams")
    trained = grams.withColumn("scope", F.explode("trains"))
    count = lambda k: F.array(*(F.sum(F.when(F.col("label") == k, _bit("_a", r)).otherwise(0)) for r in every)).alias(f"c{k}")
    counts = small(trained.groupBy("scope", "gram").agg(count(0), count(1)))
    at = lambda c, r: F.get(c, F.lit(r))
    known = lambda r: (at("c0", r) + at("c1", r) > 0).cast("long")
    total = lambda k: F.array(*(F.sum(at(f"c{k}", r)) + F.sum(known(r)) for r in every)).alias(f"d{k}")
    totals = counts.groupBy("scope").agg(total(0), total(1))
    sizes = rows.withColumn("scope", F.explode("trains")).groupBy("scope").agg(*(F.array(*(F.sum(F.when(F.col("label") == k, _bit("_a", r)).otherwise(0)) for r in every)).alias(f"n{k}") for k in (0, 1)))
    logs = lambda k: F.transform(f"c{k}", lambda c: F.ln(c + 1.0)).alias(f"l{k}")
    model = counts.select("scope", "gram", logs(0), logs(1), F.zip_with("c0", "c1", lambda a, b: (a + b > 0).cast("long")).alias("known"))
    tested = grams.filter(tests).unionByName(divided(f"NOT ({trains}) AND ({tests})")).select(key, F.explode("tests").alias("scope"), "gram")
    summed = lambda c, name: F.array(*(F.sum(F.when(at("known", r) > 0, at(c, r))) for r in every)).alias(name)
    met = tested.join(model, ["scope", "gram"]).groupBy("scope", key).agg(summed("l0", "s0"), summed("l1", "s1"), summed("known", "k"))
    asked = rows.select(key, "label", F.explode("tests").alias("scope"), "test").join(met, ["scope", key], "left").join(sizes.join(totals, "scope", "left"), "scope")
    each = asked.withColumn("run", F.explode("test"))
    of = lambda c: F.coalesce(F.get(c, F.col("run").cast("int")), F.lit(0))
    score = lambda k: F.ln((of(f"n{k}") + 1.0) / (of("n0") + of("n1") + 2.0)) + of(f"s{k}") - of("k") * F.ln(F.greatest(of(f"d{k}"), F.lit(1)))
    return each.filter(of("n0") + of("n1") > 0).select("scope", "run", key, "label", (score(1) > score(0)).cast("int").alias("predicted"))
