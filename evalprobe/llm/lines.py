"""Line dedup by a deletion-neighbourhood join: of lines within one word edit of each other the earliest stays.

Lines are sequences of words; an edit inserts, deletes or replaces one word. A line's variants within the bound are the
line itself and the line without its i-th word. Two lines are one replacement apart exactly if they share a variant
with the same i, and one insertion apart exactly if one's line is another's variant. So variants meet as hashed keys,
every key keeps its earliest line, and each later line needs to be held against that one alone: work grows with the
number of variants, not with the pairs of a group. Each such pair is then verified on the words themselves.

To spare most lines the neighbourhood, a lossless test comes first: one edit leaves the front or the back of a line as
it was, so only lines that share a front or a back with a different line emit their variants. Of the variants only keys
that two different lines have go on.

The bound is one word for lines of ``near_words`` words or more and none for shorter ones, of which one word is too
much; ``near_words`` is a parameter, as it decides what is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, stored

LAST = (1 << 63) - 1
#: Lines of fewer words have no near copies, only equal ones: one word is too much of them.
NEAR_WORDS = 5


def _hash(data: bytes, seed: int = 0) -> int:
    x = xxhash.xxh3_64_intdigest(data, seed)
    return x - (1 << 64) if x >> 63 else x


def _name(words: list[bytes]) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(b" ".join(words))
    a, b = x >> 64, x & ((1 << 64) - 1)
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def _lines(text: str | None) -> Iterator[tuple[int, list[bytes]]]:
    """The lines that hold a word, with their places."""
    for at, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        words = line.split()
        if words:
            yield at, words


def halves(words: list[bytes]) -> list[int]:
    """Keys of which two different lines within one word edit share one.

    With h words at the front and h at the back, 2h being no more than the shorter line's words, an edit touches one of
    the two at most. Lines of 2h and 2h + 1 words use h, and those of 2h also h - 1, which lines of 2h - 1 use.
    """
    n, keys = len(words), []
    for h in (n // 2,) if n % 2 else (n // 2, n // 2 - 1):
        keys.append(_hash(b"%d f " % h + b" ".join(words[:h])))
        keys.append(_hash(b"%d b " % h + b" ".join(words[n - h :])))
    return keys


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word edit or none turns a line into another."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, tid, at, *_name(words)) for doc, tid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for at, words in _lines(text)]
        yield _columns(rows, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], ["doc", "tid", "at", "x", "y"])


def _half_rows(near_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            rows = []
            for text in batch.column(0).to_pylist():
                for _, words in _lines(text):
                    x = _name(words)[0]
                    if len(words) >= near_words and x not in seen:
                        seen.add(x)
                        rows += [(k, x) for k in halves(words)]
            yield _columns(rows, [pa.int64(), pa.int64()], ["half", "x"])

    return run


def _wanted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the wanted lines: names, place and words."""
    for batch in batches:
        rows = []
        for doc, tid, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            places = set(places)
            rows += [(*_name(words), doc, tid, at, b" ".join(words)) for at, words in _lines(text) if at in places]
        yield _columns(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["x", "y", "doc", "tid", "at", "line"])


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every variant of a line as a hashed key; ``i`` is the word left out, -1 for the line itself."""
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            rows = []
            for x, y, line in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append((_hash(line), -1, x, y))
                start = 0
                for i, word in enumerate(line.split()):
                    stop = start + len(word)
                    rest = line[: start - 1] + line[stop:] if i else line[stop + 1 :]
                    rows.append((_hash(rest), i, x, y))
                    start = stop + 1
            yield _columns(rows, [pa.int64(), pa.int32(), pa.int64(), pa.int64()], ["key", "i", "x", "y"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [within_one(a.split(), b.split()) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield batch.select([2, 3]).filter(pa.array(good, pa.bool_()))


def _near(base: DataFrame, first: DataFrame, near_words: int) -> DataFrame:
    """The names (``x``, ``y``) of the lines that are one word edit away from an earlier line."""
    halved = stored(base.select("text").mapInArrow(_half_rows(near_words), "half long, x long"), "lines-halves")
    shared = halved.groupBy("half").agg(F.min("x").alias("low"), F.max("x").alias("high")).filter("low < high").select("half")
    names = stored(halved.join(shared, "half").select("x").distinct(), "lines-names", (halved,))
    places = first.join(names, "x").groupBy("doc", "tid").agg(F.collect_list("at").alias("places"))
    wanted = stored(base.join(places, ["doc", "tid"]).select("doc", "tid", "text", "places").mapInArrow(_wanted_rows, "x long, y long, doc long, tid long, at int, line binary").dropDuplicates(["x", "y"]), "lines-wanted", (names,))
    variants = stored(wanted.select("x", "y", "line").mapInArrow(_variant_rows, "key long, i int, x long, y long"), "lines-variants")
    contested = variants.groupBy("key").agg(F.min("x").alias("low"), F.max("x").alias("high")).filter("low < high").select("key")
    met = variants.join(contested, "key").join(wanted.select("x", "y", "doc", "tid", "at"), ["x", "y"])
    met = stored(met.select("key", "i", F.struct("doc", "tid", "at", "x", "y").alias("own")), "lines-met", (variants,))
    least = met.groupBy("key", "i").agg(F.min("own").alias("least"))
    # one replacement apart: the same word left out; one insertion apart: a line itself and a line without a word
    same = least.filter("i >= 0").select("key", "i", "least")
    replaced = met.join(same, ["key", "i"]).select("own", F.col("least").alias("other"))
    both = least.groupBy("key").agg(F.min(F.when(F.col("i") < 0, F.col("least"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("least"))).alias("less"))
    inserted = met.join(both.filter("whole IS NOT NULL AND less IS NOT NULL"), "key").select("own", F.when(F.col("i") < 0, F.col("less")).otherwise(F.col("whole")).alias("other"))
    pairs = replaced.unionByName(inserted).filter("own > other").select("own.x", "own.y", F.col("other.x").alias("p"), F.col("other.y").alias("q")).distinct()
    own, other = wanted.select("x", "y", F.col("line").alias("one")), wanted.select(F.col("x").alias("p"), F.col("y").alias("q"), F.col("line").alias("two"))
    checked = pairs.join(own, ["x", "y"]).join(other, ["p", "q"]).select("one", "two", "x", "y").mapInArrow(_checked, "x long, y long")
    return stored(checked.distinct(), "lines-near", (met, wanted))


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """The lines to drop, as rows (``doc``, ``tid``, ``at``): the id, null ids as the largest, the text's fingerprint and the place."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("tid"), F.col(text_col).cast("string").alias("text"))
    lines = stored(base.mapInArrow(_line_rows, "doc long, tid long, at int, x long, y long"), "lines-all")
    first = lines.groupBy("x", "y").agg(F.min(F.struct("doc", "tid", "at")).alias("first"), F.count("*").alias("n"))
    first = stored(first.select("x", "y", "first.doc", "first.tid", "first.at", "n"), "lines-first")
    near = _near(base, first, near_words)
    told = first.join(near.withColumn("near", F.lit(True)), ["x", "y"], "left").filter("n > 1 OR near")
    told = stored(told.select("x", "y", F.struct("doc", "tid", "at").alias("first"), F.coalesce("near", F.lit(False)).alias("near")), "lines-told", (first, near))
    gone = lines.join(told, ["x", "y"]).filter(F.col("near") | (F.struct("doc", "tid", "at") > F.col("first"))).select("doc", "tid", "at").distinct()
    return stored(gone, "lines-dropped", (lines, told))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_lines`` (lines with a word), ``n_removed`` and ``removed`` (places, ascending).

    A line goes if an earlier line (smaller id, or above it in the same document) is equal to it word for word or, if
    both have ``near_words`` words or more, one word edit away; white space does not count. Lines without words stay.
    Null ids count as the largest id; rows that share an id come in the order of a fingerprint of their texts, and rows
    that agree in both count as one document. A null text has no lines. Texts are read whole. An empty table gives an
    empty result. Only id and text are read, so other columns cannot clash.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sum(1 for _ in _lines(t)) for t in batch.column(2).to_pylist()], pa.int64())], names=["doc_id", "tid", "n_lines"])

    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("tid"), F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "doc_id long, tid long, n_lines long")
    gone = dropped(docs, id_col, text_col, near_words).groupBy("doc", "tid").agg(F.sort_array(F.collect_list("at")).alias("places"))
    joined = every.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).join(gone, ["doc", "tid"], "left")
    places = F.coalesce("places", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(places).cast("long").alias("n_removed"), F.array_join(places.cast("array<string>"), ",").alias("removed"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` without the lines that ``digest`` removes; documents that lose all their lines go, others keep their columns.

    A document that had no word to begin with stays as it is.
    """
    names, (doc, tid, places) = docs.columns, free(docs, "_ln_doc", "_ln_tid", "_ln_places")
    gone = dropped(docs, id_col, text_col, near_words).groupBy("doc", "tid").agg(F.collect_list("at").alias(places)).withColumnsRenamed({"doc": doc, "tid": tid})
    joined = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), tid: F.xxhash64(F.col(text_col).cast("string"))}).join(gone, [doc, tid], "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains(F.col(places), i.cast("int"))), "\n")
    joined = joined.withColumn(text_col, F.when(F.col(places).isNull(), F.col(text_col)).otherwise(kept))
    return joined.filter(F.col(places).isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(*names)
