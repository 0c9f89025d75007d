"""Feature vectors in long form: difference, concatenation, pooling, standardising, a threshold classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordering import matched, small

#: Components up to which a mean is a sum of columns.
WIDE = 64


def difference(one: Column, two: Column) -> Column:
    return F.zip_with(one, two, lambda a, b: a - b)


def concatenated(rows: DataFrame, by: list[str], layer: str = "layer", vec: str = "vec") -> DataFrame:
    """The vectors of all layers of a sample in layer order, as one."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(layer).alias("l"), F.col(vec).alias("v"))))
    return rows.groupBy(*by).agg(F.flatten(F.transform(parts, lambda x: x["v"])).alias(vec))


def pooled(tokens: DataFrame, by: list[str], mask: Column, dims: int, vec: str = "vec") -> DataFrame:
    """Mean of the vectors of the masked tokens, zeros if there are none; whole vectors are summed, on both sides of the shuffle.

    Vectors of up to ``WIDE`` components are sums of columns, longer ones go by Spark ML's summarizer.
    """
    own = tokens.filter(F.size(vec) == dims).select(*by, mask.cast("double").alias("_w"), F.transform(vec, lambda x: x.cast("double")).alias("_v"))
    if dims <= WIDE:
        sums = own.groupBy(*by).agg(F.sum("_w").alias("_n"), *(F.sum(F.when(F.col("_w") > 0, F.col("_v")[i])).alias(f"_s{i}") for i in range(dims)))
        return sums.select(*by, F.array(*(F.when(F.col("_n") > 0, F.col(f"_s{i}") / F.col("_n")).otherwise(0.0) for i in range(dims))).alias(vec))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    means = own.filter("_w > 0").groupBy(*by).agg(vector_to_array(Summarizer.mean(array_to_vector("_v"))).alias("_m"))
    return matched(own.select(*by).distinct(), means, by, "left").select(*by, F.coalesce("_m", F.array_repeat(F.lit(0.0), dims)).alias(vec))


def last_token(tokens: DataFrame, by: list[str], order: str = "tok_idx", vec: str = "vec", dims: int | None = None) -> DataFrame:
    """The vector of the token that comes last in ``order``, of all that have as many components if ``dims`` says how many.

    With ``dims`` up to ``WIDE`` each component is a column of one hash aggregation, so that tasks pass on a row a
    sample; a whole vector cannot be changed in place there, and Spark sorts all tokens instead.
    """
    if dims is None or dims > WIDE:
        own = tokens if dims is None else tokens.filter(F.size(vec) == dims)
        return own.groupBy(*by).agg(F.max_by(vec, order).alias(vec))
    own = tokens.filter(F.size(vec) == dims).select(*by, F.col(order).alias("_o"), *(F.get(vec, F.lit(i)).alias(f"_v{i}") for i in range(dims)))
    found = own.groupBy(*by).agg(*(F.max_by(f"_v{i}", "_o").alias(f"_v{i}") for i in range(dims)))
    return found.select(*by, F.array(*(f"_v{i}" for i in range(dims))).alias(vec))


def standardised(rows: DataFrame, by: list[str], train: Column, key: str, vec: str = "vec") -> DataFrame:
    """Every component by mean and population deviation of the training rows; deviations under 1e-6 count as 1.

    Moments of whole vectors are summed up on both sides of one shuffle; the rows meet the table of moments (a row a
    bucket of ``by``) and are scaled where they stand.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    doubles = F.transform(vec, lambda x: x.cast("double"))
    found = rows.filter(train).groupBy(*by).agg(Summarizer.metrics("mean", "std", "count").summary(array_to_vector(doubles)).alias("s"))
    n = F.col("s.count").cast("double")
    deviation = F.transform(vector_to_array("s.std"), lambda d: d * F.sqrt((n - 1) / n))
    moments = found.select(*by, vector_to_array("s.mean").alias("_m"), F.transform(deviation, lambda d: F.when(d < 1e-6, 1.0).otherwise(d)).alias("_d"))
    scaled = F.zip_with(F.zip_with(doubles, "_m", lambda x, m: x - m), "_d", lambda x, d: x / d)
    return matched(rows.select(*by, key, vec), small(moments), by).select(*by, key, scaled.alias(vec))


def requested(feature: Column, known: tuple[str, ...], attention: bool = False, mlp: bool = False, residual: bool = True, strategies: str | tuple[str, ...] | None = None, odd_layers: bool = False) -> Column:
    """Whether a feature is asked for: by its family, by its strategy (of ``known``; none given asks for all) and, with ``odd_layers``, by its layer.

    Heads and what follows attention are the attention family. Without ``residual`` only the families that are switched
    on remain. Features of no layer pass ``odd_layers``. ``strategies`` may be one text with commas; an empty list and
    an unknown name raise.
    """
    asked = known if strategies is None else tuple(x.strip() for x in (strategies.split(",") if isinstance(strategies, str) else strategies) if x.strip())
    if not asked or (unknown := set(asked) - set(known)):
        raise ValueError(f"strategies must be some of {', '.join(known)}" + (f", not {', '.join(sorted(unknown))}" if asked else ""))
    stem = F.split(feature, "__")[0]
    heads, inner = stem.contains("/attention_head_") | stem.contains("/post_attention"), stem.contains("/mlp")
    good = F.when(heads, F.lit(attention)).when(inner, F.lit(mlp)).otherwise(F.lit(residual)) & T.strategy(feature).isin(*asked)
    return good & (~stem.rlike(r"/layer_\d+(/|$)") | (T.layer(feature) % 2 == 1)) if odd_layers else good


def looked_up(wanted: DataFrame, store: DataFrame, key: str = "sig") -> DataFrame:
    """The vectors of the wanted signatures for every feature; a signature that the store lacks raises."""
    joined = wanted.join(store, key, "left")
    return joined.withColumn("vec", F.when(F.col("vec").isNull(), F.raise_error(F.concat(F.lit("no vector for "), F.col(key)))).otherwise(F.col("vec")))


def aligned(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Both vectors of the samples and features that both sides have: difference and concatenation."""
    joined = one.withColumnRenamed("vec", "_a").join(two.withColumnRenamed("vec", "_b"), keys)
    return joined.select(*keys, difference(F.col("_a"), F.col("_b")).alias("diff"), F.concat("_a", "_b").alias("both"))


def alignment(one: DataFrame, two: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """How many samples both sides have, and how many only one of them."""
    marked = one.select(*keys, F.lit(1).alias("_s")).unionByName(two.select(*keys, F.lit(2).alias("_s"))).groupBy(*keys).agg(F.bit_or("_s").alias("_s"))
    n = lambda k: F.count_if(F.col("_s") == k)
    return marked.groupBy(*by).agg(n(3).alias("both"), n(1).alias("first_only"), n(2).alias("second_only"))


def midpoint_classifier(rows: DataFrame, by: list[str], score: str, label: str, train: Column) -> DataFrame:
    """Per group: class means on training rows, their midpoint as threshold, the direction, and accuracy on the others."""
    own = lambda k: F.avg(F.when(train & (F.col(label) == k), F.col(score)))
    fit = rows.groupBy(*by).agg(own(0).alias("m0"), own(1).alias("m1"))
    placed = rows.withColumn("_t", train).join(fit, by)
    up = F.col("m1") >= F.col("m0")
    predicted = F.when(up, F.col(score) >= (F.col("m0") + F.col("m1")) / 2).otherwise(F.col(score) < (F.col("m0") + F.col("m1")) / 2).cast("int")
    return placed.filter(~F.col("_t")).groupBy(*by).agg(F.count("*").alias("n_test"), F.round(F.avg((predicted == F.col(label)).cast("int")), 6).alias("accuracy"))
