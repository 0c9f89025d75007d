"""Principal components of vectors of any width: a growing subspace by sums of block products, a pass over the rows each.

Spark ML's PCA holds a matrix of width by width. Here a pass multiplies every row by a narrow basis and adds up what the
rows give back: width by ``k`` and a few columns more. These sums are taken per partition, merged piece by piece on the
executors, and turned into the next block of the basis on the driver, until the leading directions stand still.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in one piece of a sum.
PIECE = 1 << 16
#: Numbers that the driver holds at most: the basis, twice.
HELD = 1 << 27
#: Numbers of a matrix that a task lays out at once.
BLOCK = 1 << 21


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The vectors of all batches as matrices of bounded size."""
    step = max(1, BLOCK // width)
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            column = batch.column(0).slice(low, step)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) != width * len(column):
                raise ValueError(f"vectors must have {width} components, and no nulls")
            yield flat.reshape(-1, width)


def _summed(rows: DataFrame, width: int, columns: int, of) -> np.ndarray:
    """The sum over all rows of ``of(matrix)`` (width by columns): added up per partition, then piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches, width):
            own = of(x)
            total = own if total is None else total + own
        if total is not None:
            flat = total.ravel()
            for k in range(0, len(flat), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int32()), pa.array([flat[k : k + PIECE]], pa.list_(pa.float64()))], names=["piece", "part"])

    parts = rows.select("vec").mapInArrow(run, "piece int, part array<double>")
    merged = parts.groupBy("piece").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    found = {r.piece: r.part for r in merged.collect()}
    return np.concatenate([found[k] for k in sorted(found)]).reshape(width, columns) if found else np.zeros((width, columns))


def _fresh(block: np.ndarray, held: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` has beyond ``held``; without columns if that is rounding only."""
    size = np.linalg.norm(block)
    for _ in range(2):
        block = block - held @ (held.T @ block)
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    new = left[:, sizes > 1e-10 * max(size, 1e-300)]
    for _ in range(2):  # what rounding has left of the held directions weighs more in small ones
        new = np.linalg.qr(new - held @ (held.T @ new))[0]
    return new


def principal_basis(rows: DataFrame, k: int, passes: int = 60, tolerance: float = 1e-9, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``k`` leading directions (width by k, orthonormal) of the vectors ``vec`` of ``rows``.

    A direction's sign is that which makes its largest component positive. Blocks of all passes are kept as one basis
    and the best directions in it are taken, so few passes are needed; a basis that would grow beyond ``HELD`` numbers
    starts anew from its best directions. It ends when the directions' residuals are under ``tolerance`` of the largest
    variance, when the rows span nothing more, or after ``passes`` passes. Fewer directions come back if the rows span
    fewer. Rows without a vector are left out; an empty table raises.
    """
    rows = rows.filter("vec IS NOT NULL")
    first, n = rows.select(F.size("vec").alias("d")).first(), rows.count()
    if first is None:
        raise ValueError("no vectors")
    width = first.d
    columns = min(k + 10, width)
    most = HELD // (2 * width) // columns * columns
    if most < 3 * columns:
        raise ValueError(f"a basis of {width} components by {3 * columns} columns is more than the driver may hold")
    mean = _summed(rows, width, 1, lambda x: x.sum(0)[:, None])[:, 0] / n
    new = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, columns)))[0]
    basis = products = np.zeros((width, 0))
    sc = rows.sparkSession.sparkContext
    for _ in range(passes):
        sent = sc.broadcast((new, mean @ new))

        def of(x: np.ndarray, sent=sent) -> np.ndarray:
            q, shift = sent.value
            return x.T @ (x @ q - shift)

        # centred rows times the basis add up to zero, so the mean drops out of the other side
        product = _summed(rows, width, new.shape[1], of)
        sent.unpersist()
        basis, products = np.hstack([basis, new]), np.hstack([products, product])
        inner = basis.T @ products
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        lead = basis @ turn[:, :k]
        rest = products @ turn[:, :k] - lead * values[:k]
        new = _fresh(np.hstack([rest, product])[:, :columns], basis)
        if not new.size or np.abs(rest).max() <= tolerance * max(values[0], 1e-300):
            break
        if basis.shape[1] + new.shape[1] > most:
            turn = turn[:, : 2 * columns]
            basis, products = basis @ turn, products @ turn
    lead = lead[:, values[:k] > 1e-12 * max(values[0], 1e-300)]
    top = np.abs(lead).argmax(0) if lead.size else np.zeros(0, int)
    return mean, lead * np.where(lead[top, np.arange(lead.shape[1])] < 0, -1, 1)


def wide_principal(rows: DataFrame, k: int, passes: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """``rows`` (``vec``, ``is_train``) with ``components``: the coordinates of every centred vector on the ``k`` leading directions of the training rows."""
    mean, basis = principal_basis(rows.filter("is_train").select("vec"), k, passes, tolerance)
    sent = rows.sparkSession.sparkContext.broadcast((basis, mean @ basis))
    names = [c for c in rows.columns if c != "vec"]
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, shift = sent.value
        for batch in batches:
            step = max(1, BLOCK // width)
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                own = [(x @ q - shift) for x in _matrices(iter([part.select([0])]), width)]
                coordinates = pa.array(list(np.concatenate(own)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), coordinates], names=[*names, "components"])

    kinds = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in names)
    return rows.select("vec", *names).filter("vec IS NOT NULL").mapInArrow(run, f"{kinds}, components array<double>")
