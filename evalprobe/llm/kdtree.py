"""Exact top-k search by inner product: KD-trees over spatial shards, queries in blocks.

1. On a bounded sample (``FIT_ROWS``) the principal axes are found, and the top of a KD-tree: median splits along the
   widest axis, down to ``CELLS`` cells at most. A rotation keeps inner products and makes boxes tighter. Every row is
   then dealt to its cell; a cell of many rows (one vector may be a third of all) is cut to shards of bounded size by a
   hash of the id.
2. Each shard's tree is built once and stored as one row: median splits of the widest axis down to leaves, each with
   the tight bounding box of its rows in the given and in the rotated basis. Each cell keeps one box in a small table.
3. A query first visits one shard of the cell whose box promises most. Its kth score then goes along: only shards of
   cells whose box can still reach that score are visited.

The largest inner product that a box can give a query is the sum over dimensions of the better of its two faces. In a
shard each query of a block takes its best leaf, then its next three, its next twelve and so on, so that queries meet a
leaf in one matrix product; a leaf is passed over if its bound is below the
query's kth score, or equals it and holds no smaller id. Bounds of the rotated basis carry a slack for rounding; scores
come from the whole numbers alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Rows of a shard, queries that visit a shard together, rows of a leaf.
SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 16384, 4096, 128
#: Rows and components (8 MB) on which axes and top splits are fitted, cells at most, and sample rows that a cell needs.
FIT_ROWS, FIT_VALUES, CELLS, CELL_SAMPLE = 16384, 1 << 20, 1024, 64
#: Queries of which bounds and candidates are held at a time; bounds memory, never results.
SLICE = 1024


class Top:
    """Axes and top splits for vectors of one number of dimensions, from sample rows."""

    def __init__(self, sample: np.ndarray, rows: int):
        middle = sample - sample.mean(0)
        self.axes = np.linalg.eigh(middle.T @ middle)[1] if len(sample) > 1 else np.eye(sample.shape[1])
        self.axis, self.cut, self.children = [], [], []
        wanted = min(CELLS, max(1, rows // SHARD_ROWS), max(1, len(sample) // CELL_SAMPLE))
        parts, self.leaf = [(sample @ self.axes, -1, 0)], []
        while parts and len(parts) < wanted:  # the part of most rows next
            k = max(range(len(parts)), key=lambda i: len(parts[i][0]))
            own, parent, side = parts[k]
            axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
            cut = float(np.median(own[:, axis])) if len(own) else 0.0
            low = own[:, axis] <= cut
            if low.all() or not low.any():
                break
            node = len(self.axis)
            self._placed(parent, side, node)
            self.axis.append(axis)
            self.cut.append(cut)
            self.children.append([-1, -1])
            parts[k : k + 1] = [(own[low], node, 0), (own[~low], node, 1)]
        for cell, (_, parent, side) in enumerate(parts):
            self._placed(parent, side, -cell - 1)

    def _placed(self, parent: int, side: int, node: int) -> None:
        if parent >= 0:
            self.children[parent][side] = node

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        turned, at = points @ self.axes, np.zeros(len(points), np.int64)
        if not self.axis:
            return at
        axis, cut, children = np.array(self.axis), np.array(self.cut), np.array(self.children)
        while (inner := at >= 0).any():
            here = at[inner]
            at[inner] = children[here, (turned[inner, axis[here]] > cut[here]).astype(int)]
        return -at - 1


class Boxes:
    """Bounding boxes in both bases, and the least id in each."""

    def __init__(self, low: np.ndarray, high: np.ndarray, turned_low: np.ndarray, turned_high: np.ndarray, first: np.ndarray):
        self.low, self.high, self.turned_low, self.turned_high, self.first = low, high, turned_low, turned_high, first

    @classmethod
    def around(cls, points: np.ndarray, turned: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> Boxes:
        return cls(*(f.reduceat(x, starts) for x in (points, turned) for f in (np.minimum, np.maximum)), np.minimum.reduceat(ids, starts))

    def bounds(self, queries: np.ndarray, axes: np.ndarray) -> np.ndarray:
        """The largest inner product of every query with every box."""
        plain = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        turned = queries @ axes
        tight = np.maximum(turned, 0) @ self.turned_high.T + np.minimum(turned, 0) @ self.turned_low.T
        reach = np.sqrt(np.maximum(self.turned_low**2, self.turned_high**2).sum(1))
        return np.minimum(plain, tight + 1e-9 * (1 + np.sqrt((queries**2).sum(1))[:, None] * reach))


class Tree:
    """Whole-number points and their ids, in leaves of a KD-tree."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, axes: np.ndarray, leaf: int | None = None):
        leaf = leaf or LEAF_ROWS
        turned = points @ axes
        order, starts = np.argsort(ids, kind="stable"), []
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                starts.append(a)
                continue
            own = turned[order[a:b]]
            width = own.max(0) - own.min(0)
            axis, half = int(np.argmax(width)), (b - a) // 2
            if width[axis] > 0:  # equal rows stay in the order of their ids
                order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
            todo += [(a + half, b), (a, a + half)]
        self.starts = np.array(starts)
        self.stops = np.append(self.starts[1:], len(points))
        self.points, self.ids = points[order], ids[order]
        self.boxes = Boxes.around(self.points, turned[order], self.ids, self.starts)

    def search(self, queries: np.ndarray, owns: np.ndarray, k: int, axes: np.ndarray, floors: np.ndarray, floor_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and ids (a row a query, the best first; the largest id: none) of the ``k`` best that can still enter, and leaves visited.

        ``floors`` and ``floor_ids`` are the kth score so far and its id (-inf: none).
        """
        n, void = len(queries), np.iinfo(np.int64).min
        exact = float(np.abs(queries).max(initial=0)) * float(np.abs(self.points).max(initial=0)) * max(1, queries.shape[1]) < 2**53
        none = -np.inf if exact else void
        scores, ids = np.full((n, k), none, np.float64 if exact else np.int64), np.full((n, k), np.iinfo(np.int64).max)
        floor, floor_id, visited = floors.copy(), floor_ids.copy(), np.zeros(n, np.int64)
        bounds = self.boxes.bounds(queries.astype(np.float64), axes)
        if not exact:
            bounds = bounds + 1e-9 * np.abs(bounds) + 1
        order = np.argsort(-bounds, axis=1, kind="stable")
        low, high = 0, 1
        while low < order.shape[1]:  # every query's best leaf, then its next 3, its next 12, ...
            turn = order[:, low:high]
            going = np.take_along_axis(bounds, turn, 1) >= floor[:, None]
            if not going.any():
                break
            here, place = np.nonzero(going)
            there = turn[here, place]
            by = np.argsort(there, kind="stable")
            here, there = here[by], there[by]
            edges = np.flatnonzero(np.append(True, there[1:] != there[:-1]))
            for q, leaf in zip(np.split(here, edges[1:]), there[edges], strict=True):
                bound = bounds[q, leaf]
                q = q[(bound > floor[q]) | ((bound == floor[q]) & (self.boxes.first[leaf] <= floor_id[q]))]
                visited[q] += 1
                span = slice(self.starts[leaf], self.stops[leaf])
                found = queries[q] @ self.points[span].T
                enters = (found >= floor[q][:, None]) & (self.ids[span] != owns[q][:, None])
                some = np.flatnonzero(enters.any(1))
                if not len(some):
                    continue
                q, found = q[some], np.where(enters[some], found[some], none)
                all_scores, all_ids = np.concatenate([scores[q], found], 1), np.concatenate([ids[q], np.broadcast_to(self.ids[span], found.shape)], 1)
                best = np.lexsort((all_ids, -all_scores))[:, :k]
                scores[q], ids[q] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
                last, last_id = scores[q, -1].astype(np.float64), ids[q, -1]
                better = (scores[q, -1] != none) & ((last > floor[q]) | ((last == floor[q]) & (last_id < floor_id[q])))
                floor[q[better]], floor_id[q[better]] = last[better], last_id[better]
            low, high = high, 4 * high
        empty = scores == none
        return np.where(empty, 0, scores).astype(np.int64), np.where(empty, np.iinfo(np.int64).max, ids), visited


def _matrix(column: pa.ChunkedArray, dims: int, kind=np.float64) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def _numbers(points: np.ndarray) -> np.ndarray:
    """float64 where it holds all inner products exactly (products by BLAS), else int64."""
    return points.astype(np.float64) if np.abs(points).max(initial=0) < 2**20 else points


def _planted(tops: dict[int, Top]):
    def run(table: pa.Table) -> pa.Table:
        dims, points = table.column("dims")[0].as_py(), _matrix(table.column("v"), table.column("dims")[0].as_py(), np.int64)
        top = tops.get(dims)
        axes = np.eye(dims) if top is None else top.axes
        tree = Tree(_numbers(points), table.column("id").to_numpy(), axes)
        box = tree.boxes
        whole = Boxes(box.low.min(0), box.high.max(0), box.turned_low.min(0), box.turned_high.max(0), box.first.min())
        own = {c: [table.column(c)[0].as_py()] for c in ("dims", "cell", "piece")}
        return pa.table({"dims": pa.array(own["dims"], pa.int32()), "cell": pa.array(own["cell"], pa.int32()), "piece": pa.array(own["piece"], pa.int32()), "box": pa.array([pickle.dumps(whole)], pa.binary()), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    return run


def _joined_boxes(table: pa.Table) -> pa.Table:
    boxes = [pickle.loads(b) for b in table.column("box").to_pylist()]
    f = lambda how, name: how.reduce([getattr(b, name) for b in boxes])
    whole = Boxes(f(np.minimum, "low"), f(np.maximum, "high"), f(np.minimum, "turned_low"), f(np.maximum, "turned_high"), min(b.first for b in boxes))
    return pa.table({"dims": table.column("dims")[:1], "cell": table.column("cell")[:1], "pieces": pa.array([table.num_rows], pa.int32()), "box": pa.array([pickle.dumps(whole)], pa.binary())})


def _searcher(k: int, tops: dict[int, Top]):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if trees.num_rows and queries.num_rows:
            dims = queries.column("dims")[0].as_py()
            top, tree = tops.get(dims), pickle.loads(trees.column("tree")[0].as_py())
            axes = np.eye(dims) if top is None else top.axes
            vectors, owns = _matrix(queries.column("v"), dims, np.int64), queries.column("id").to_numpy()
            if tree.points.dtype == np.float64:
                vectors = _numbers(vectors)
            floors = np.array([-np.inf if x is None else x for x in queries.column("floor").to_pylist()], np.float64)
            firsts = np.array([np.iinfo(np.int64).max if x is None else x for x in queries.column("floor_id").to_pylist()], np.int64)
            for low in range(0, len(vectors), SLICE):
                part = slice(low, low + SLICE)
                scores, ids, _ = tree.search(vectors[part], owns[part], k, axes, floors[part], firsts[part])
                good = ids != np.iinfo(np.int64).max
                found.append((np.broadcast_to(owns[part][:, None], ids.shape)[good], ids[good], scores[good]))
        columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """``id``, ``v`` (floor(scale * x) of every component) and ``dims``, of vectors without gaps.

    A component beyond sqrt(2**62 / dims) in size, whose scores need not fit 64 bits, rules its vector out as well.
    """
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * scale >= F.sqrt(F.lit(float(1 << 62)) / F.size("x"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    return rows.filter(~bad).select("id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size("x").alias("dims"))


def fitted(rows: DataFrame, total: int) -> dict[int, Top]:
    """Axes and top splits by number of dimensions, from ``FIT_ROWS`` rows or so (fewer of long vectors) that a hash of the id picks."""
    wanted = min(FIT_ROWS, FIT_VALUES // max(1, rows.agg(F.max("dims")).first()[0] or 1))
    share = min(1.0, wanted / max(1, total))
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * wanted)
    by: dict[int, list] = {}
    for batch in sample.select("dims", "v").toArrow().to_batches():
        for dims, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(dims, []).append(v)
    return {dims: Top(np.array(own, np.float64), total) for dims, own in by.items()}


def search(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """For each query (``id``, ``v``, ``dims``) the ``k`` rows of the largest inner product, ties to the smaller id.

    Rows with the query's own id take no part; rows and queries of other dimensions do not meet. Returns
    ``query_id``, ``rank``, ``vec_id``, ``score``; fewer than ``k`` if there are fewer rows, none without rows.
    Queries that share an id share the first one's results; rows that share an id are rows of their own.
    """
    rows, queries = stored(rows, "kdtree-rows"), stored(queries.dropDuplicates(["id"]), "kdtree-queries")
    tops = fitted(rows, rows.count())
    keys = ["dims", "cell", "piece"]

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d in tops:
                    cell[at] = tops[d].cells(_matrix(batch.column(1).take(pa.array(at)), int(d)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    dealt = stored(rows.mapInArrow(celled, "id long, v array<long>, dims int, cell int"), "kdtree-cells", (rows,))
    sizes = dealt.groupBy("dims", "cell").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("pieces"))
    dealt = dealt.join(sizes, ["dims", "cell"]).withColumn("piece", F.pmod(F.xxhash64("id", F.lit(1)), F.col("pieces")).cast("int")).select("id", "v", *keys)
    trees = stored(dealt.groupBy(*keys).applyInArrow(_planted(tops), "dims int, cell int, piece int, box binary, tree binary"), "kdtree-trees")
    boxes = trees.select("dims", "cell", "box").groupBy("dims", "cell").applyInArrow(_joined_boxes, "dims int, cell int, pieces int, box binary").collect()  # CELLS rows at most for one number of dimensions
    known = {d: (np.array([b["cell"] for b in own]), np.array([b["pieces"] for b in own]), [pickle.loads(b["box"]) for b in own]) for d in {b["dims"] for b in boxes} if (own := [b for b in boxes if b["dims"] == d])}
    stacked = {d: Boxes(*(np.array([getattr(b, f) for b in own]) for f in ("low", "high", "turned_low", "turned_high", "first"))) for d, (_, _, own) in known.items()}

    def asked(home: bool):
        """Queries with the shards that they visit: the most promising one, or all others that can reach the kth score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(low, SLICE)
                    dims = batch.column(2).to_numpy()
                    for d in np.unique(dims):
                        if d not in known:
                            continue
                        at = np.flatnonzero(dims == d)
                        part = batch.take(pa.array(at))
                        names, pieces, _ = known[d]
                        axes = tops[d].axes if d in tops else np.eye(d)
                        vectors = _matrix(part.column(1), int(d))
                        bounds = stacked[d].bounds(vectors, axes)
                        ids = part.column(0).to_numpy()
                        best = np.argmax(bounds, 1)
                        first = np.array([hash(int(i)) % p for i, p in zip(ids, pieces[best], strict=True)])
                        if home:
                            q, cell, piece = np.arange(len(ids)), best, first
                        else:
                            floor = np.array([-np.inf if x is None else x for x in part.column(3).to_pylist()], np.float64)
                            q, cell = np.nonzero(bounds * (1 + 1e-9 * np.sign(bounds)) + 1e-6 >= floor[:, None])
                            q, cell, piece = (np.repeat(x, pieces[cell]) for x in (q, cell, pieces[cell]))
                            start = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (cell[1:] != cell[:-1]))) if len(q) else np.zeros(0, int)
                            piece = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
                            other = (cell != best[q]) | (piece != first[q])
                            q, cell, piece = q[other], cell[other], piece[other]
                        for cut in range(0, len(q), 4096):
                            span = slice(cut, cut + 4096)
                            out = part.take(pa.array(q[span]))
                            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(names[cell[span]], pa.int32()), pa.array(piece[span], pa.int32())], names=[*out.schema.names, "cell", "piece"])

        return run

    def visit(asking: DataFrame, home: bool) -> DataFrame:
        schema = "id long, v array<long>, dims int, floor double, floor_id long, cell int, piece int"
        asking = stored(asking.select("id", "v", "dims", "floor", "floor_id").mapInArrow(asked(home), schema), "kdtree-asked")
        blocks = stored(asking.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks")), "kdtree-blocks")
        left = trees.select(*keys, "tree").join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = asking.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int"))
        met = left.select(*keys, "block", "tree").groupBy(*keys, "block").cogroup(right.drop("blocks").groupBy(*keys, "block"))
        return stored(met.applyInArrow(_searcher(k, tops), "query_id long, vec_id long, score long"), "kdtree-found", (asking, blocks))

    first = visit(queries.withColumns({"floor": F.lit(None).cast("double"), "floor_id": F.lit(None).cast("long")}), True)
    floors = _best(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"), F.col("vec_id").alias("floor_id"))
    more = visit(queries.join(floors, "id", "left"), False)
    discard(trees)
    return _best(first.unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The search with the rows whose id is divisible by ``every`` as queries, against all rows.

    Null ids, and vectors that are null, empty or hold null or non-finite components, take no part; nor do vectors so
    large that their scores need not fit 64 bits (see ``quantised``). Rows that share an id are candidates each for
    itself, and one of them asks. An empty table gives an empty result. Other columns are not read.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    return search(rows, rows.filter(F.col("id") % every == 0), k)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
