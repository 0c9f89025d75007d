"""Components of wide vectors against numpy's singular value decomposition."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalprobe.operators import probes as P
from evalprobe.operators.subspace import principal_basis, wide_principal


def against_svd(x, k):
    centred = x - x.mean(0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:k].T
    top = np.abs(v).argmax(0)
    return x.mean(0), v * np.where(v[top, np.arange(k)] < 0, -1, 1)


def test_a_hundred_thousand_columns(spark):
    """More than Spark ML's PCA takes; 24 rows in three partitions."""
    draw = np.random.default_rng(1)
    x = (draw.normal(size=(24, 4)) * [40, 20, 10, 5]) @ draw.normal(size=(4, 100_000)) + draw.normal(size=(24, 100_000)) * 0.5 + 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, vec array<double>").repartition(3)
    mean, basis = principal_basis(rows, 3)
    want_mean, want = against_svd(x, 3)
    assert np.allclose(mean, want_mean, atol=1e-9) and np.allclose(basis, want, atol=1e-7)


def test_as_spark_ml_on_narrow_vectors(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 12)) * np.linspace(6, 1, 12) + 100
    rows = spark.createDataFrame([(i, v.tolist(), i % 4 != 0) for i, v in enumerate(x)], "vec_id int, vec array<double>, is_train boolean").repartition(4)
    ml = {r.vec_id: np.abs(r.components) for r in P.principal(rows, 3).collect()}
    own = {r.vec_id: np.abs(r.components) for r in wide_principal(rows, 3).collect()}
    assert own.keys() == ml.keys() and all(np.allclose(own[i], ml[i], atol=1e-5) for i in own)


def test_no_gap_and_a_small_basis(spark, monkeypatch):
    """Variances that hardly differ, with a basis that has to start anew."""
    from evalprobe.operators import subspace

    monkeypatch.setattr(subspace, "HELD", 60 * 2 * 39)
    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 60)) * np.linspace(1.2, 1, 60)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, vec array<double>").repartition(3)
    _, basis = principal_basis(rows, 3)
    assert np.allclose(basis, against_svd(x, 3)[1], atol=1e-6)


def test_few_and_odd_rows(spark):
    kind = "key int, vec array<double>, is_train boolean"
    flat = spark.createDataFrame([(i, [float(i), 0.0, 1.0], True) for i in range(5)] + [(9, None, True)], kind)
    found = {r.key: r.components for r in wide_principal(flat, 2).collect()}
    assert found.keys() == set(range(5)) and all(len(c) == 1 and c[0] == pytest.approx(i - 2) for i, c in found.items())
    with pytest.raises(ValueError, match="no vectors"):
        principal_basis(flat.limit(0), 2)
    with pytest.raises(Exception, match="must have 3 components"):
        principal_basis(flat.unionByName(spark.createDataFrame([(7, [1.0], True)], kind)).orderBy(F.desc("key")).filter("key <> 9").orderBy("key"), 1)
