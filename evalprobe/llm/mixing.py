"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target in words. Copies that are certain come first: all documents of a source get the whole part of
target over source size. What is left of the target is drawn with inclusion probabilities in proportion to the size of
a document, min(1, c * size) with c such that the expected words are those left; so within a source long documents may
be certain of a further copy and the others have odds of their own. These are ranked by their random odds over their
inclusion odds, and the front of that order is taken until the words left are reached: a sample of unequal
probabilities and of a fixed size, measured in words, within half a document.

The order is never sorted as a whole: two levels of 4096 cells find the cell in which the cut falls, and only that
cell's documents (one in sixteen million) are ordered. c comes from the counts of documents by source and size, a table
of no more rows than there are sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

CELLS = 4096
#: Sources up to which the per-source table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def with_draw(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` (``_mx_id``, ``_mx_text``, ``_mx_source``, further columns) with its size in words and uniform draw, without the text.

    The draw goes by id and text, so that rows without an id, or that share one, draw each for itself.
    """
    text = F.coalesce(F.col("_mx_text").cast("string"), F.lit(""))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_mx_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text))
    draw = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    return docs.withColumns({"_mx_size": F.regexp_count(text, F.lit(WORD)).cast("long"), "_mx_u": (draw + F.lit(0.5)) / F.lit(float(1 << 52))}).drop("_mx_text")


def targets(sized: DataFrame, share: float, cap: int, cycle: tuple[int, ...]) -> DataFrame:
    """Per source: its size, target, certain copies and words left to draw.

    The water level at which a source stops at its cap is ``cap * size / weight``; it is reached if all sources
    together take fewer words there than there are to share. All windows here hold a row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_mx_source").asc_nulls_last()))
    per = sized.groupBy("_mx_source").agg(F.sum(F.col("_mx_size") * F.col("n")).alias("size"))
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((rank - 1) % len(cycle) + 1).cast("int")).cast("long")
    every, below = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("level")
    per = per.withColumn("weight", weight).withColumn("level", F.lit(cap) * F.col("size") / F.col("weight"))
    total = F.sum("size").over(every) if share == 1.0 else F.floor(F.sum("size").over(every) * F.lit(share)).cast("long")
    per = per.withColumns({"total": total, "weights": F.sum("weight").over(every), "caps": F.sum(F.col("size") * cap).over(below), "used": F.sum("weight").over(below)})
    capped = F.col("caps") * F.col("weight") + F.col("size") * cap * (F.col("weights") - F.col("used")) < F.col("total") * F.col("weight")
    per = per.withColumn("capped", capped)
    spent = F.sum(F.when(F.col("capped"), F.col("size") * cap).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    per = per.withColumns({"spent": spent, "open": open_weight})
    shared = ((F.col("total") - F.col("spent")) * F.col("weight")).cast("double") / F.col("open")
    per = per.withColumn("target", F.when(F.col("capped"), (F.col("size") * cap).cast("double")).otherwise(F.least(shared, (F.col("size") * cap).cast("double"))))
    per = per.withColumn("sure", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long"))
    return per.select(F.col("_mx_source").alias("_mx_key"), F.col("size").alias("_mx_source_size"), F.col("target").alias("_mx_target"), F.col("sure").alias("_mx_sure"), (F.col("target") - F.col("sure") * F.col("size")).alias("left"))


def inclusion(sized: DataFrame, per: DataFrame) -> DataFrame:
    """``per`` with the size above which a document is certain, c, and the words left for the others.

    Sizes are tried from the largest: with all larger ones certain, c spreads the words left over the squares of the
    rest; the first size that c does not lift above 1 is the border.
    """
    every = Window.partitionBy("_mx_source").orderBy(F.desc("_mx_size")).rowsBetween(Window.unboundedPreceding, 0)
    rest = Window.partitionBy("_mx_source").orderBy("_mx_size").rowsBetween(Window.unboundedPreceding, 0)
    words = (F.col("_mx_size") * F.col("n")).cast("decimal(38,0)")
    square = words * F.col("_mx_size")
    sums = sized.withColumns({"above": (F.sum(words).over(every) - words).cast("double"), "squares": F.sum(square.cast("decimal(38,0)")).over(rest).cast("double")})
    tried = sums.join(per.select("_mx_key", "left"), F.col("_mx_source").eqNullSafe(F.col("_mx_key"))).filter("squares > 0")
    tried = tried.withColumn("c", (F.col("left") - F.col("above")) / F.col("squares")).filter("c * _mx_size <= 1")
    border = tried.groupBy("_mx_source").agg(F.max(F.struct("_mx_size", "c", (F.col("left") - F.col("above")).alias("rest"))).alias("b"))
    border = border.select(F.col("_mx_source").alias("_mx_border_key"), F.col("b._mx_size").alias("_mx_border"), F.col("b.c").alias("_mx_c"), F.col("b.rest").alias("_mx_left"))
    return per.drop("left").join(border, F.col("_mx_key").eqNullSafe(F.col("_mx_border_key")), "left").drop("_mx_border_key")


def _ranked(df: DataFrame, per: DataFrame) -> DataFrame:
    """Joined to its source's row; ``_mx_v`` in (0, 1) grows with random odds over inclusion odds, null where there are none."""
    df = df.join(per, F.col("_mx_source").eqNullSafe(F.col("_mx_key"))).drop("_mx_key")
    df = df.withColumn("_mx_p", F.when((F.col("_mx_size") <= F.col("_mx_border")) & (F.col("_mx_c") > 0) & (F.col("_mx_size") > 0), F.col("_mx_c") * F.col("_mx_size")))
    odds = (F.col("_mx_u") / (1 - F.col("_mx_u"))) * ((1 - F.col("_mx_p")) / F.col("_mx_p"))
    df = df.withColumn("_mx_v", odds / (1 + odds))
    first = F.floor(F.col("_mx_v") * CELLS)
    return df.withColumn("_mx_a", first).withColumn("_mx_b", F.floor((F.col("_mx_v") * CELLS - F.col("_mx_a")) * CELLS))


def _cell(cells: DataFrame, order: str, start: Column) -> DataFrame:
    """The first cell of each source whose end reaches the words left, with the words before it; the cut falls in it or on its end."""
    before = start + F.sum("words").over(Window.partitionBy("_mx_source").orderBy(order)) - F.col("words")
    cells = cells.withColumn("_mx_before", before)
    return cells.filter((F.col("_mx_before") < F.col("left")) & (F.col("_mx_before") + F.col("words") >= F.col("left")))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0, cap: int = 3, cycle: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """How often each document enters a mix in which sources have target weights.

    Sources in code point order (null last, a source of its own) weigh ``cycle``, repeating; together they take
    ``share`` of all words; a source's target stops at ``cap`` times its size and the excess is shared again.
    Returns the digest (a row per document: id, source, size, source size, target, copies) and a table of the rows of
    ``docs`` (struct ``_mx_row``) with ``_mx_copies``. A null or empty text has size 0 and gets the certain copies of
    its source alone. Null ids draw by their text; rows that agree in id and text share their draw and are taken
    together. Ties of the ranking go by size. An empty table gives an empty mix. Texts are counted whole. Other columns
    pass through inside the struct, so their names cannot clash; none is read.
    """
    own = [F.col(id_col).alias("_mx_id"), F.col(text_col).alias("_mx_text"), F.col(source_col).alias("_mx_source")]
    sized = stored(with_draw(docs.select(*own), seed), "mixing-sizes")
    counts = stored(sized.groupBy("_mx_source", "_mx_size").agg(F.count("*").alias("n")), "mixing-counts")
    per = stored(inclusion(counts, stored(targets(counts, share, cap, cycle), "mixing-targets")), "mixing-inclusion")
    few = per.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)
    ranked = _ranked(sized, small(per)).filter("_mx_v IS NOT NULL")
    first = ranked.groupBy("_mx_source", "_mx_a").agg(F.sum("_mx_size").alias("words"), F.first("_mx_left").alias("left"))
    first = _cell(first, "_mx_a", F.lit(0)).select(F.col("_mx_source").alias("k"), F.col("_mx_a").alias("ka"), F.col("_mx_before").alias("start"))
    inner = ranked.join(small(first), F.col("_mx_source").eqNullSafe(F.col("k")) & (F.col("_mx_a") == F.col("ka")))
    second = inner.groupBy("_mx_source", "_mx_a", "_mx_b").agg(F.sum("_mx_size").alias("words"), F.first("_mx_left").alias("left"), F.first("start").alias("start"))
    second = _cell(second, "_mx_b", F.col("start")).select(F.col("_mx_source").alias("k2"), F.col("_mx_a").alias("ka2"), F.col("_mx_b").alias("kb2"), F.col("_mx_before").alias("start2"))
    last = inner.join(small(second), F.col("_mx_source").eqNullSafe(F.col("k2")) & (F.col("_mx_a") == F.col("ka2")) & (F.col("_mx_b") == F.col("kb2")))
    upto = F.sum("_mx_size").over(Window.partitionBy("_mx_source").orderBy("_mx_v", "_mx_size").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", F.col("start2") + upto)
    taken = F.when(2 * F.col("upto") - F.col("_mx_size") < 2 * F.col("_mx_left"), F.struct("_mx_v", "_mx_size"))
    cut = last.groupBy("_mx_source").agg(F.max(taken).alias("_mx_cut"), F.first("_mx_a").alias("_mx_cut_a"), F.first("_mx_b").alias("_mx_cut_b"))
    cut = cut.select(F.col("_mx_source").alias("_mx_cut_key"), "_mx_cut", "_mx_cut_a", "_mx_cut_b")
    per = stored(per.join(cut, F.col("_mx_key").eqNullSafe(F.col("_mx_cut_key")), "left").drop("_mx_cut_key"), "mixing-cuts", (per, counts))

    def applied(df: DataFrame) -> DataFrame:
        df = _ranked(df, small(per))
        a, b, at_a, at_b = map(F.col, ("_mx_a", "_mx_b", "_mx_cut_a", "_mx_cut_b"))
        drawn = (a < at_a) | ((a == at_a) & (b < at_b)) | ((a == at_a) & (b == at_b) & (F.struct("_mx_v", "_mx_size") <= F.col("_mx_cut")))
        certain = F.col("_mx_size") > F.col("_mx_border")
        return df.withColumn("_mx_copies", F.col("_mx_sure") + F.when(F.coalesce(certain | F.coalesce(drawn, F.lit(False)), F.lit(False)), 1).otherwise(0))

    digest = applied(sized).select(F.col("_mx_id").alias(id_col), F.col("_mx_source").alias(source_col), F.col("_mx_size").alias("size"), F.col("_mx_source_size").alias("source_size"), F.col("_mx_target").alias("target"), F.col("_mx_copies").alias("copies"))
    placed = applied(with_draw(docs.select(F.struct("*").alias("_mx_row"), *own), seed)).select("_mx_row", "_mx_copies")
    return digest, placed


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``copies`` says (see there); the columns of ``docs``."""
    _, placed = copies(docs, **options)
    return placed.filter("_mx_copies > 0").withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_copies")))).select("_mx_row.*")


#: The same digest by one ordered sum per source.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (CAST('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
l AS (SELECT *, 3 * size / weight::DOUBLE AS level, sum(size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights FROM s),
c AS (SELECT *, sum(3 * size) OVER (ORDER BY level)::BIGINT AS caps, sum(weight) OVER (ORDER BY level)::BIGINT AS used FROM l),
k AS (SELECT *, caps * weight + size * 3 * (weights - used) < total * weight AS capped FROM c),
o AS (SELECT *, sum(CASE WHEN capped THEN 3 * size ELSE 0 END) OVER ()::BIGINT AS spent, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()::BIGINT AS open FROM k),
t AS (SELECT source, size, CASE WHEN capped THEN (3 * size)::DOUBLE ELSE least(((total - spent) * weight)::DOUBLE / open, (3 * size)::DOUBLE) END AS target FROM o),
f AS (SELECT source, size AS source_size, target, CASE WHEN size > 0 THEN floor(target / size)::BIGINT ELSE 0 END AS sure FROM t),
n AS (SELECT source, size, count(*)::BIGINT AS n FROM d GROUP BY source, size),
m AS (SELECT n.source, n.size, target - sure * source_size AS words_left,
    (sum(n.size * n) OVER (PARTITION BY n.source ORDER BY n.size DESC ROWS UNBOUNDED PRECEDING) - n.size * n)::DOUBLE AS above,
    (sum(n.size * n.size * n) OVER (PARTITION BY n.source ORDER BY n.size ROWS UNBOUNDED PRECEDING))::DOUBLE AS squares
    FROM n JOIN f ON n.source IS NOT DISTINCT FROM f.source),
b AS (SELECT source, max(size) AS border, max_by((words_left - above) / squares, size) AS c, max_by(words_left - above, size) AS words_left
    FROM m WHERE squares > 0 AND (words_left - above) / squares * size <= 1 GROUP BY source),
p AS (SELECT d.doc_id, d.source, d.size, d.u, source_size, target, sure, border, words_left, CASE WHEN d.size <= border AND c > 0 AND d.size > 0 THEN c * d.size END AS part
    FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
q AS (SELECT *, (u / (1 - u)) * ((1 - part) / part) AS odds FROM p),
w AS (SELECT *, sum(CASE WHEN part IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size, target, (size * (sure + CASE WHEN size > border OR (part IS NOT NULL AND 2 * upto - size < 2 * words_left) THEN 1 ELSE 0 END))::BIGINT AS taken FROM w
"""
