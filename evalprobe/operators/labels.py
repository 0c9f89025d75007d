"""Labels of paired answers, question groups and their summaries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T


#: Every byte but the small letters and digits of ASCII as a blank; no byte of another character is one of them.
_WORDS = bytes(b if b in b"abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
#: Pairs of texts that a worker holds as Python objects at a time, whatever Spark hands over at once.
_SLICE = 64


@F.arrow_udf(DoubleType())
def _bag_cosine(one: pa.Array, two: pa.Array) -> pa.Array:
    def cosine(one: bytes | None, two: bytes | None) -> float:
        a, b = (Counter((text or b"").translate(_WORDS).split()) for text in (one, two))
        if not a or not b:
            return 0.0
        both = sum(n * b[w] for w, n in a.items() if w in b)
        return both / (math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values())))

    slices = (zip(one.slice(k, _SLICE).to_pylist(), two.slice(k, _SLICE).to_pylist(), strict=True) for k in range(0, len(one), _SLICE))
    return pa.array((cosine(a, b) for own in slices for a, b in own), pa.float64(), size=len(one))


def token_cosine(one: Column, two: Column) -> Column:
    """The cosine of the token counts of two texts of a row; 0 if either has none. One Arrow pass over UTF-8: nothing is shuffled."""
    return _bag_cosine(F.lower(one).cast("binary"), F.lower(two).cast("binary"))


def alike(task: Column, letters: tuple[Column, Column], plain: tuple[Column, Column], near: Column) -> Column:
    """Same normalised answer and ``near`` texts; an open answer that cannot be read goes by the texts alone."""
    (a, b), (one, two) = letters, plain
    return F.when(task == "mcq", F.coalesce(a == b, F.lit(False)) & near).when(one.isNotNull() & two.isNotNull(), (one == two) & near).otherwise(near)


def similar(task: Column, with_answer: Column, without_answer: Column, cosine: Column, threshold: float = 0.7) -> Column:
    """Whether two parsed answers and their texts are ``alike``."""
    both = (with_answer, without_answer)
    return alike(task, tuple(map(T.normal_letter, both)), tuple(map(T.normal_open, both)), cosine >= threshold)


def mirage(missing: Column, acknowledged: Column, alike: Column) -> tuple[Column, Column]:
    """(true, false or null; label): missing is neutral, acknowledged non-mirage, alike mirage, else neutral."""
    state = F.when(missing, F.lit(None)).when(acknowledged, False).when(alike, True)
    return state, F.when(missing, "neutral_missing_response").when(acknowledged, "non_mirage").when(alike, "mirage").otherwise("neutral")


def predicted(task: Column, response: Column, options: Column) -> Column:
    """The answer that a response gives: a letter for multiple choice, else its open answer."""
    return F.when(task == "mcq", T.option_letter(response, options)).otherwise(T.open_answer(response))


def labelled(pairs: DataFrame, least: int = 10, threshold: float = 0.7, no_image: Sequence[str] = T.NO_IMAGE, uncertain: Sequence[str] = T.UNCERTAIN) -> DataFrame:
    """``pairs`` of answers with and without the evidence, parsed, scored, compared and labelled, in one pass over the rows.

    Reads ``task``, ``options``, ``truth``, ``with_text`` and ``without_text``; null answers count as empty. Adds for either
    side ``_missing``, ``_short`` (under ``least`` words), ``_chain`` (its reasoning), ``_pred`` and ``_correct`` (null where
    either cannot be read); ``no_image`` and ``uncertain`` (what the answer without evidence admits, outside answer
    options), ``cosine``, ``alike``, ``mirage_like`` (true, false, null), ``label``, and ``state`` (mirage, non_mirage or
    neutral). Missing comes before admitting, admitting before alike.
    """
    task, out, sides = F.col("task"), pairs, ("with", "without")
    for side in sides:
        said = T.text(F.col(f"{side}_text"))
        out = out.withColumns({f"{side}_missing": said == "", f"{side}_short": T.word_count(said) < least, f"{side}_chain": T.reasoning(said), f"{side}_pred": predicted(task, said, F.col("options"))})
    said = T.text(F.col("without_text"))
    out = out.withColumns({"no_image": T.mentions(said, no_image), "uncertain": T.mentions(said, uncertain), "cosine": F.round(token_cosine(T.text(F.col("with_text")), said), 6)})
    # every normal form is a column, so that no later expression works it out again
    answers = {"with": F.col("with_pred"), "without": F.col("without_pred"), "true": F.col("truth")}
    letters, plain = ({k: F.col(f"_{kind}_{k}") for k in answers} for kind in ("letter", "plain"))
    out = out.withColumns({f"_letter_{k}": T.normal_letter(c) for k, c in answers.items()} | {f"_plain_{k}": T.normal_open(c) for k, c in answers.items()})
    out = out.withColumns({f"{side}_correct": T.agrees(task, letters[side], letters["true"], plain[side], plain["true"]) for side in sides})
    out = out.withColumn("alike", alike(task, (letters["with"], letters["without"]), (plain["with"], plain["without"]), F.col("cosine") >= threshold))
    state, label = mirage(F.col("with_missing") | F.col("without_missing"), F.col("no_image") | F.col("uncertain"), F.col("alike"))
    out = out.withColumns({"mirage_like": state, "label": label}).drop(*(f"_{kind}_{k}" for kind in ("letter", "plain") for k in answers))
    return out.withColumn("state", F.when(F.col("mirage_like"), "mirage").when(~F.col("mirage_like"), "non_mirage").otherwise("neutral"))


def label_summary(rows: DataFrame, by: list[str], question: list[str]) -> DataFrame:
    """Of ``labelled`` rows, per group: counts of missing and short answers and of labels, rates, accuracies, and how many questions flip."""
    n = lambda c: F.count_if(c).alias
    short, missing = F.col("with_short") | F.col("without_short"), F.col("with_missing") | F.col("without_missing")
    counts = rows.groupBy(*by).agg(n(F.col("with_missing"))("missing_with"), n(F.col("without_missing"))("missing_without"), n(missing)("missing_pairs"), n(F.col("with_short"))("short_with"), n(F.col("without_short"))("short_without"), n(short)("short_pairs"))
    flips = flip_rates(question_groups(rows, [*by, *question]), by)
    return summary(rows, by).join(counts, by).join(flips, by)


def strict(mirage_like: Column) -> Column:
    return F.when(mirage_like.eqNullSafe(F.lit(True)), 1).when(mirage_like.eqNullSafe(F.lit(False)), 0)


def with_neutral(mirage_like: Column, label: Column) -> Column:
    """As ``strict``, neutral labels as class 0."""
    return F.when(mirage_like.isNotNull(), strict(mirage_like)).when(F.lower(F.trim(label)).startswith("neutral"), 0)


def clean_b(mirage_like: Column, with_correct: Column, without_correct: Column) -> Column:
    """Class 1 is mirage; class 0 is wrong without the evidence and right with it."""
    return F.when(mirage_like.eqNullSafe(F.lit(True)), 1).when(without_correct.eqNullSafe(F.lit(False)) & with_correct.eqNullSafe(F.lit(True)), 0)


def question_groups(variants: DataFrame, keys: list[str], state: str = "state", nested: list[str] | None = None) -> DataFrame:
    """Counts of states per question, and whether both classes occur (the label flips).

    ``nested``: columns of the variants to keep, as an array ordered by the first of them. There are few variants of a question.
    """
    n = lambda s: F.count_if(F.col(state) == s)
    own = [F.array_sort(F.collect_list(F.struct(*nested))).alias("variants")] if nested else []
    groups = variants.groupBy(*keys).agg(F.count("*").alias("n_variants"), n("mirage").alias("n_mirage"), n("non_mirage").alias("n_non_mirage"), n("neutral").alias("n_neutral"), *own)
    return groups.withColumn("flip", (F.col("n_mirage") > 0) & (F.col("n_non_mirage") > 0))


def flip_rates(groups: DataFrame, by: list[str]) -> DataFrame:
    """Of the questions (``question_groups``), how many flip and their share."""
    return groups.groupBy(*by).agg(F.count("*").alias("n_questions"), F.count_if("flip").alias("n_flips"), F.round(F.avg(F.col("flip").cast("int")), 6).alias("flip_rate"))


def length_counts(pairs: DataFrame, by: list[str], one: str, two: str, least: int = 10) -> DataFrame:
    """Missing (no words) and short (under ``least``) answers: of the first side, of the second, and pairs with either."""
    words = {s: T.word_count(F.coalesce(F.col(c), F.lit(""))) for s, c in (("with", one), ("without", two))}
    kinds = {"missing": lambda n: n == 0, "short": lambda n: n < least}
    sides = [F.count_if(test(n)).alias(f"{kind}_{s}") for kind, test in kinds.items() for s, n in words.items()]
    either = [F.count_if(test(words["with"]) | test(words["without"])).alias(f"{kind}_pairs") for kind, test in kinds.items()]
    return pairs.groupBy(*by).agg(*sides, *either)


def summary(variants: DataFrame, by: list[str], rollup: bool = False, state: str = "state") -> DataFrame:
    """Counts, mirage rate over the classified and accuracies over the known; a rate over nothing is null."""
    n = lambda s: F.count_if(F.col(state) == s)
    grouped = variants.rollup(*by) if rollup else variants.groupBy(*by)
    rate = F.try_divide(n("mirage").cast("double"), (n("mirage") + n("non_mirage")).cast("double"))
    own = [F.grouping_id().alias("level")] if rollup else []
    return grouped.agg(*own, F.count("*").alias("n"), n("mirage").alias("n_mirage"), n("non_mirage").alias("n_non_mirage"), n("neutral").alias("n_neutral"), F.round(rate, 6).alias("mirage_rate"), F.round(F.avg(F.col("with_correct").cast("int")), 6).alias("with_accuracy"), F.round(F.avg(F.col("without_correct").cast("int")), 6).alias("without_accuracy"))
