"""Whitening against numpy on whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import whitening
from broadsheet.llm.common import importable
from broadsheet.llm.queries import op13_whitening


def table(spark, rows):
    importable(spark)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return frame.withColumns({"x": F.lit("mine"), "n": F.lit(0), "component": F.lit(1)}).repartition(3)


def check(rows, found, components=16):
    """``found`` against the eigenvectors of the covariance of the distinct integer vectors."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) and abs(c) < 1e15 for c in v)]
    x = [np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000 for _, v in usable]
    fit = np.array(sorted({tuple(map(int, v)) for v in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    spread = ((fit * n - sums) / n).astype(float)
    covariance = spread.T @ spread / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > 1e-11 * values[0]).sum()))
    assert len(found) == len(usable) * kept
    want = {}
    for (i, _), v in zip(usable, x):
        z = v.astype(object) * n - sums
        want.setdefault(i, []).append((sum(int(q) ** 2 for q in z), (z / n).astype(float) @ vectors[:, :kept] / np.sqrt(values[:kept])))
    signs = {}
    for row in found:
        deviation, whitened = want[row.vec_id][0]
        assert int(row.deviation) == deviation and row.n == n
        assert row.explained == pytest.approx(values[row.component - 1] / covariance.trace(), rel=1e-9)
        assert row.identity_error < 1e-4
        value = whitened[row.component - 1]
        if abs(value) > 1e-3:
            sign = signs.setdefault(row.component, np.sign(value * row.whitened))
            assert row.whitened * sign == pytest.approx(value, rel=1e-6, abs=1e-6)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13)).tolist()) for i in range(300)]
    rows += [(1_000 + i, rows[0][1]) for i in range(40)] + [(7, rows[7][1]), (None, rows[9][1])]
    rows += [(2_000, None), (2_001, []), (2_002, [float("nan")] * 12), (2_003, [None] + [1.0] * 11), (2_004, [float("inf")] + [0.0] * 11),
             (2_005, [1e300] + [0.0] * 11), (2_006, [0.0] * 12)]
    found = whitening.whiten(table(spark, rows)).collect()
    check(rows, found)
    assert {r.vec_id for r in found} == {i for i, _ in rows} - set(range(2_000, 2_006))


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * 1e13).tolist()) for i in range(50)]
    check(rows, whitening.whiten(table(spark, rows)).collect())


def test_components_without_spread_do_not_exist(spark):
    rng = np.random.default_rng(7)
    flat = [(i, [a, b, a, 1.0, a + b]) for i, (a, b) in enumerate(rng.integers(-50, 50, (200, 2)).tolist())]
    found = whitening.whiten(table(spark, [(i, [float(c) for c in v]) for i, v in flat])).collect()
    assert {r.component for r in found} == {1, 2} and len(found) == 400
    assert max(r.identity_error for r in found) < 1e-9
    for rows in ([], [(1, [1.0, 2.0])] * 5, [(1, None)], [(1, [])]):
        assert whitening.whiten(table(spark, rows)).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


@pytest.mark.parametrize("rank, size", [(1, 1), (5, 5), (3, 8), (40, 40), (17, 31)])
def test_factor_and_rotations(rank, size):
    rng = np.random.default_rng(rank)
    base = rng.normal(size=(size, rank))
    matrix = base @ base.T
    factor = whitening.pivoted_cholesky(matrix)
    assert factor.shape == (size, rank)
    assert np.allclose(factor @ factor.T, matrix, atol=1e-12 * matrix.max())
    # Taken by their number of leading columns with entries, the rows are triangular.
    lengths = sorted(int(np.flatnonzero(row)[-1]) + 1 if row.any() else 0 for row in factor)
    assert all(length >= min(k + 1, rank) for k, length in enumerate(lengths))
    values, units = whitening.one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:rank], rtol=1e-10)
    assert np.allclose(units @ units.T, np.eye(rank), atol=1e-12)
    assert np.allclose(matrix @ units.T, units.T * values, atol=1e-9 * values[0])


def test_query_over_its_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = op13_whitening(spark, sf_dir)
    assert dict(found.dtypes)["deviation"] == "bigint" and dict(found.dtypes)["component"] == "int"
    check(rows, found.collect())
