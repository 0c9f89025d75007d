"""Spelling variants: words one edit apart, found by an asymmetric join of q-chunks, and the frequent form of each.

Of two words one edit apart take the longer, or either of two equally long, as the chunk side, of length L: it
contributes two disjoint chunks, its halves. The other word, of length L or L - 1, contributes its positional grams. One
edit changes one half at most, so the other half stands in the other word as a gram, at its own place or one to the
left. A half alone is shared by many words (a common beginning or ending), so the changed half is divided by the same
rule: it contributes two disjoint chunks again, one of which the edit leaves whole. The key of a meeting is thus the kept
half, the kept chunk of the other half, L and which quarter is left out; grams at places where no chunk can stand are
not emitted. Words that meet are verified by their edit distance. A pair that meets under two keys (a letter that is one
of a run) counts under the first.

Meetings of a key differ in one quarter of a word only, so their number is bounded by the strings that a quarter can
spell, not by the words that share a beginning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Letters: A to Z, a to z and the code points U+00C0 to U+00FF.
LETTER = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shorter words are left out: one letter is too much of them.
LEAST = 7
#: A form is this many times as frequent as the word that it replaces.
RATIO = 10


def lowered(word: Column) -> Column:
    """``word`` with A to Z in lower case and all other letters as they are."""
    return F.translate(word, UPPER, LOWER)


def runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The maximal runs of letters of every text that have ``least`` letters, lower-cased: (``doc``, ``run``), a row an occurrence."""
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({LETTER}{{{least},}})"), F.lit(1))
    return docs.select(F.col(id_col).cast("string").alias("doc"), F.explode(found).alias("run")).withColumn("run", lowered(F.col("run")))


def mistyped(doc: Column, run: Column, one_in: int = 31) -> Column:
    """``run`` without one letter where ``one_in`` divides the checksum of document and run: typing errors that a repeat gives again. A null document reads as empty."""
    h = F.crc32(F.concat(F.coalesce(doc, F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(words: DataFrame, least: int = LEAST, seen: int = 2) -> DataFrame:
    """Distinct values of ``word`` with ``least`` letters and ``seen`` occurrences, as (``word``, ``n``)."""
    return words.filter(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= seen)


#: The key of a word as chunk side, for each quarter that an edit may have changed.
_CHUNKS = "transform(sequence(0, 3), k -> struct(k AS k, l AS l, xxhash64(l, k, substring(word, 1, l * k div 4), substring(word, l * (k + 1) div 4 + 1)) AS key))"
#: The keys of a word as gram side: of a chunk side as long as it, in place, and of one longer, where what follows stands one to the left.
_GRAMS = "flatten(transform(array(l, l + 1), m -> transform(sequence(0, 3), k -> struct(k AS k, m AS l, xxhash64(m, k, substring(word, 1, m * k div 4), substring(word, m * (k + 1) div 4 + 1 - (m - l))) AS key))))"
#: Whether an earlier quarter than ``k`` would have met too: what is before it agrees, and what is after it, one to the left.
_EARLIER = "k > 0 AND exists(sequence(0, k - 1), j -> substring(a, 1, l * j div 4) = substring(b, 1, l * j div 4) AND substring(a, l * (j + 1) div 4 + 1) = substring(b, l * (j + 1) div 4))"


def apart(table: DataFrame) -> DataFrame:
    """``table``, to be joined by a shuffle, never as a broadcast.

    A million words take 7 MB as a file and a hundred bytes each in memory, eight times over as grams; the planner
    sizes a stored table by its file and does not count what an explode adds.
    """
    return table.hint("merge")


def near(words: DataFrame) -> DataFrame:
    """Pairs of words one inserted, deleted or replaced letter apart, each once: ``a``, ``b`` and their counts ``n_a``, ``n_b``.

    ``a`` is the longer word, or the later of two equally long. Words have four letters or more. No pair is lost.
    """
    own = words.withColumn("l", F.char_length("word"))
    chunks = own.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(F.expr(_CHUNKS)).alias("c")).select("a", "n_a", "c.*")
    grams = own.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("l").alias("l_b"), F.explode(F.expr(_GRAMS)).alias("g")).select("b", "n_b", "l_b", "g.key")
    met = chunks.join(apart(grams), "key").filter((F.col("l_b") < F.col("l")) | ((F.col("l_b") == F.col("l")) & (F.col("b") < F.col("a"))))
    same = F.expr("levenshtein(a, b, 1) = 1")
    return met.filter(same).filter((F.col("l_b") == F.col("l")) | ~F.expr(_EARLIER)).select("a", "b", "n_a", "n_b")


def _rooted(forms: DataFrame) -> DataFrame:
    """(``word``, ``form``) to (``word``, ``root``): forms followed to the last, twice as far in every round.

    The count grows by ``RATIO`` with every step, so there are fewer than twenty steps, and five rounds at most.
    """
    up = stored(forms.select("word", F.col("form").alias("root")), "spelling-up")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = up.join(apart(on), "root", "left")
        step = stored(met.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-up", (up,))
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        up = step


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """For every row of ``words`` (``word``, ``n``): ``n_near`` (words one edit away), ``form``, ``form_n`` and ``root``.

    The form of a word is the near word of largest count, ties to the smallest in code-point order, if it has ``ratio``
    times the word's count; else null. The root is the last of the forms that one comes to from form to form, the word
    itself if it has none. Words are distinct and not null (``counted``). An empty table gives an empty result.
    """
    pairs = near(words)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))))
    sides = pairs.select(both.alias("s")).select("s.*")
    top = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    joined = words.join(top, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("top.m")).alias("m"), F.col("top.other").alias("other"))
    good = F.col("m") >= ratio * F.col("n")
    found = stored(joined.select("word", "n", "n_near", F.when(good, F.col("other")).alias("form"), F.when(good, F.col("m")).alias("form_n")), "spelling-forms")
    return found.join(apart(_rooted(found.filter("form IS NOT NULL"))), "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame, damage=None, least: int = LEAST, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of all texts with their forms (``variants``): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``damage`` changes a run of letters given its document (``mistyped``). A null text has no words, repeated rows count
    as often as they stand there, null ids are allowed, an empty table gives no words, and no column but id and text is
    read.
    """
    found = runs(docs, least, id_col, text_col)
    words = found.select((damage(F.col("doc"), F.col("run")) if damage else F.col("run")).alias("word"))
    return variants(stored(counted(words, least), "spelling-words"), ratio).select("word", "form", "root", "n", "n_near", "form_n")
