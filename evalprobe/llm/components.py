"""Connected components of a links table, by alternating large and small stars; no component meets in one task.

Up to ``FEW`` links, a bounded table, are joined up by union and find in one task instead; the components are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Links up to which one task joins them up (1 MB).
FEW = 50_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node ties its larger (``large``) or smaller neighbours, and itself, to its least neighbour."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = stored(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "components-least")
    tied = around.join(least, "u")
    if large:
        tied = tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return tied.filter("a <> b").distinct()


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to rows (node, root): the least node of each component, for every node that has a link."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-links")
    if edges.limit(FEW + 1).count() <= FEW:
        return edges.coalesce(1).mapInArrow(_joined_up, "node long, root long")
    before = None
    while True:
        large = stored(_star(edges, True), "components-large", (edges,))
        edges = stored(_star(large, False), "components-small", (large,))
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        now = (state["n"], state["h"])
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
