"""Anti and semi joins on very large sets of keys: a Bloom filter, then an exact check of what it lets through.

The filter is built by aggregation, in bitmaps of 32,768 bits that partial aggregates merge, and never has more than
``bits`` bits, so its broadcast has a fixed size. A row that it rules out is not in the set for certain and is not
shuffled; the others, among them all rows of the set, are joined. More keys than the filter was meant for let more rows
through and change no result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB, broadcast twice; at ten million keys it lets through one other row in fifteen.
BITS = 1 << 26
_PAGE = 32_768


def _places(on: list[str], bits: int) -> list[Column]:
    h = F.xxhash64(*on)
    return [F.pmod(h, F.lit(bits)), F.pmod(F.xxhash64(h, F.lit(7)), F.lit(bits))]


def built(keys: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """The filter of ``keys``: (``page``, ``bitmap``), no more than ``bits`` / 32,768 rows of 4 KB. Keys with a null are left out."""
    own = keys.select(*on).dropna().select(F.explode(F.array(*_places(on, bits))).alias("p"))
    return own.groupBy(F.floor(F.col("p") / _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("p") % _PAGE).alias("bitmap"))


def maybe(rows: DataFrame, on: list[str], filters: DataFrame, name: str = "_maybe", bits: int = BITS) -> DataFrame:
    """``rows`` with ``name``: false where the filter's set does not hold the row's key for certain."""
    out = rows
    hits = F.lit(True)
    for k, p in enumerate(_places(on, bits)):
        page = filters.select(F.col("page").alias(f"_page{k}"), F.col("bitmap").alias(f"_bitmap{k}"))
        out = out.join(F.broadcast(page), F.floor(p / _PAGE) == F.col(f"_page{k}"), "left")
        byte = F.conv(F.hex(F.substring(f"_bitmap{k}", F.floor(p % _PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.call_function("shiftright", byte, (p % 8).cast("int")) % 2
        hits = hits & (F.coalesce(bit, F.lit(0)) == 1)
    return out.withColumn(name, hits).drop("_page0", "_bitmap0", "_page1", "_bitmap1")


def checked(rows: DataFrame, keys: DataFrame, on: list[str], exactly: Callable[[DataFrame], DataFrame], otherwise: Callable[[DataFrame], DataFrame], bits: int = BITS) -> DataFrame:
    """``exactly`` of the rows whose key may be in ``keys``, with ``otherwise`` of those whose key is not."""
    told = maybe(rows, on, built(keys, on, bits), bits=bits)
    return exactly(told.filter("_maybe").drop("_maybe")).unionByName(otherwise(told.filter("NOT _maybe").drop("_maybe")))


def anti(rows: DataFrame, keys: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """The rows whose key is not in ``keys``; a null key is in no set."""
    return checked(rows, keys, on, lambda few: few.join(keys.select(*on).distinct(), on, "left_anti"), lambda rest: rest, bits)


def semi(rows: DataFrame, keys: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """The rows whose key is in ``keys``."""
    return maybe(rows, on, built(keys, on, bits), bits=bits).filter("_maybe").drop("_maybe").join(keys.select(*on).distinct(), on, "left_semi")
