"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.common import written

# An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# The driver holds one matrix of this width, 128 MB.
MOST_DIMENSIONS = 4_096
# Components with less than this share of the largest eigenvalue have no spread to divide by.
LEAST_SHARE = 1e-11
_ROWS = 1_024
_LARGE = 2**62
_SWEEPS = 60


def _scaled(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers of the usable vectors of an Arrow list column, and their integers."""
    lists = column.cast(pa.large_list(pa.float64()))
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        stretched = np.floor(flat * SCALE)
        bad = ~(np.abs(stretched) < _LARGE)
    ends = np.cumsum(lengths)
    faults = np.concatenate([[0], np.cumsum(bad)])
    rows = np.flatnonzero((lengths > 0) & (faults[ends] == faults[ends - lengths]))
    return rows, [stretched[ends[r] - lengths[r] : ends[r]].astype("<i8") + SHIFT for r in rows]


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the usable vectors; ``x`` holds little-endian 64-bit integers.

    Left out are vectors that are null, empty, or hold an entry that is null, not finite, or too
    large for 64 bits once scaled.
    """
    rows = vectors.select("vec_id", "embedding")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                kept, found = _scaled(part.column("embedding"))
                cells = pa.array([x.tobytes() for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(kept)), cells], ["vec_id", "x"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x binary")


def _parts(batches):
    """Slices of Arrow batches with the matrix of their vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            cells = part.column("x").to_pylist()
            if cells:
                yield part, np.frombuffer(b"".join(cells), dtype="<i8").reshape(len(cells), -1)


class Centre:
    """Exact centring: ``n * x - S`` in integers, and that over ``n`` in double precision."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, np.array(sums, dtype=object)
        self.largest_sum = max(abs(s) for s in sums)

    def spread(self, x: np.ndarray) -> np.ndarray:
        if int(np.abs(x).max()) * self.n + self.largest_sum < _LARGE:
            return x * np.int64(self.n) - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def values(self, x: np.ndarray) -> np.ndarray:
        return (self.spread(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of squares of ``n * x - S``, exact; null beyond 38 digits."""
        spread = self.spread(x)
        if int(np.abs(spread).max()) ** 2 * spread.shape[1] < _LARGE:
            return pa.array((spread * spread).sum(axis=1).astype(np.int64)).cast(pa.decimal128(38, 0))
        totals = (spread.astype(object) ** 2).sum(axis=1)
        return pa.array([Decimal(t) if t < 10**38 else None for t in totals], pa.decimal128(38, 0))


def _column_sums(fit: DataFrame) -> list[int]:
    """Sum of every dimension, exact whatever the number of rows."""

    def run(batches):
        totals = None
        for _, x in _parts(batches):
            # Halves cannot overflow inside one slice.
            part = (x >> 31).sum(axis=0).astype(object) * 2**31 + (x & (2**31 - 1)).sum(axis=0).astype(object)
            totals = part if totals is None else totals + part
        if totals is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(totals)), pa.int32()), pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))],
                ["at", "total"],
            )

    rows = fit.mapInArrow(run, "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total"))
    return [int(r["total"]) for r in sorted(rows.collect(), key=lambda r: r["at"])]


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    """Matrix rows added up per key, in the order of the tasks that made them."""

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("task").to_numpy(), kind="stable")
        cells = table.column("cells").to_pylist()
        total = sum((np.frombuffer(cells[i], "<f8") for i in order[1:]), np.frombuffer(cells[order[0]], "<f8"))
        return pa.table(
            {"row": table.column("row")[:1], "task": table.column("task")[:1].combine_chunks(), "cells": pa.array([total.tobytes()], pa.binary())}
        )

    return rows.groupBy(*keys).applyInArrow(add, "row int, task int, cells binary")


def _summed_matrix(fit: DataFrame, shape: tuple[int, int], of) -> np.ndarray:
    """Sum over all slices of the matrix that ``of`` makes of one; each task adds up its own.

    What meets in one task is bounded: the rows of 256 groups of tasks, then one row of each group.
    """

    def run(batches):
        total = np.zeros(shape)
        for _, x in _parts(batches):
            total += of(x)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(shape[0]), pa.int32()), pa.array([task] * shape[0], pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
            ["row", "task", "cells"],
        )

    rows = fit.mapInArrow(run, "row int, task int, cells binary").withColumn("group", F.pmod("task", F.lit(256)))
    # One row for each row of the matrix comes to the driver.
    found = _added(_added(rows, "row", "group"), "row").collect()
    return np.stack([np.frombuffer(bytes(r["cells"]), "<f8") for r in sorted(found, key=lambda r: r["row"])])


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """Columns ``L`` with ``matrix = L L'``, the largest remaining diagonal first.

    Its rows stand in the matrix's order; taken in the order of the pivots they are triangular.
    It ends where what is left is rounding, so it has as many columns as the matrix has rank.
    """
    size = len(matrix)
    factor, left = np.zeros((size, size)), matrix.diagonal().copy()
    limit = size * np.finfo(float).eps * left.max()
    open_rows = np.ones(size, dtype=bool)
    for k in range(size):
        pivot = int(np.where(open_rows, left, -np.inf).argmax())
        if left[pivot] <= limit:
            return factor[:, :k]
        column = (matrix[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(left[pivot])
        column[~open_rows] = 0.0
        column[pivot] = np.sqrt(left[pivot])
        open_rows[pivot] = False
        factor[:, k] = column
        left = left - column * column
    return factor


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``factor factor'``, falling, and unit eigenvectors as rows.

    Pairs of columns are rotated until all are orthogonal; their squared norms are then the
    eigenvalues. A round rotates disjoint pairs, dealt like the rounds of a tournament.
    """
    columns = factor.T.copy()
    count = len(columns)
    seats, tolerance = np.arange(count + count % 2), factor.shape[0] * np.finfo(float).eps
    for _ in range(_SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            left, right = seats[:half], seats[half:][::-1]
            real = (left < count) & (right < count)
            left, right = left[real], right[real]
            a, b = columns[left], columns[right]
            aa, bb, ab = (np.einsum("ij,ij->i", p, q) for p, q in ((a, a), (b, b), (a, b)))
            share = np.abs(ab) / np.maximum(np.sqrt(aa * bb), np.finfo(float).tiny)
            worst = max(worst, float(share.max(initial=0.0)))
            turn = share > tolerance
            if turn.any():
                zeta = (bb[turn] - aa[turn]) / (2 * ab[turn])
                tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cosine = 1 / np.hypot(1.0, tangent)
                sine = cosine * tangent
                columns[left[turn]] = cosine[:, None] * a[turn] - sine[:, None] * b[turn]
                columns[right[turn]] = sine[:, None] * a[turn] + cosine[:, None] * b[turn]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= tolerance:
            break
    norms = np.linalg.norm(columns, axis=1)
    order = np.argsort(-norms, kind="stable")
    units = columns[order] / norms[order][:, None]
    # Either sign would do: the largest entry is positive.
    lead = np.take_along_axis(units, np.abs(units).argmax(axis=1)[:, None], axis=1)
    return norms[order] ** 2, units * np.sign(lead)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of usable vectors.

    Entries become integers ``x = floor(64 c) + 1,000,000``; what is fitted on are the distinct
    ``x``, so groups of copies weigh as one and meet in partial aggregates. Their covariance comes
    from exactly centred vectors. The driver holds one matrix of at most 4,096 dimensions, however
    many vectors there are; pivoted Cholesky and Jacobi rotations run on it.

    There is a row for each usable row of ``vectors``, repeated ones too, and each of the first
    ``components`` components, numbered by falling eigenvalue. ``deviation`` is
    ``decimal(38,0)``: the exact sum of ``(n x - S)**2``, null beyond 38 digits.
    ``identity_error`` is the largest entry of the whitened covariance less the identity.

    Not usable are vectors that are null, empty, or hold an entry that is null, not finite or
    beyond 64 bits; a null ``vec_id`` is kept as it is. Components without spread (equal vectors,
    fewer vectors than dimensions) do not exist and have no rows, so a table of one distinct
    vector gives none, like an empty one. Vectors of different lengths, or longer than 4,096, are
    a ``ValueError``. Other columns are ignored. Ties between eigenvalues keep their order of
    rotation.
    """
    rows = integer_vectors(vectors)
    schema = (
        f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, "
        "deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    fit = written(rows.select("x").distinct(), "whitening")
    size = F.octet_length("x") / 8
    n, least, most = fit.agg(F.count("*"), F.min(size).cast("int"), F.max(size).cast("int")).first()
    nothing = rows.sparkSession.createDataFrame([], schema)
    if not n:
        return nothing
    if least != most:
        raise ValueError(f"embeddings of different lengths, {least} to {most}")
    if most > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")

    centre = Centre(n, _column_sums(fit))

    def scatter(x: np.ndarray) -> np.ndarray:
        values = centre.values(x)
        return values.T @ values

    covariance = _summed_matrix(fit, (most, most), scatter) / n
    trace = float(covariance.trace())
    if not trace > 0:
        return nothing
    eigenvalues, units = one_sided_jacobi(pivoted_cholesky(covariance))
    kept = min(components, int((eigenvalues > LEAST_SHARE * eigenvalues[0]).sum()))
    eigenvalues, project = eigenvalues[:kept], (units[:kept] / np.sqrt(eigenvalues[:kept])[:, None]).T

    def products(x: np.ndarray) -> np.ndarray:
        values = centre.values(x) @ project
        return np.vstack([values.sum(axis=0), values.T @ values])

    sums = _summed_matrix(fit, (kept + 1, kept), products) / n
    # The vectors were centred before they were multiplied; what is left of their mean is rounding.
    identity_error = float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(kept)).max())
    explained = eigenvalues / trace

    def run(batches):
        for part, x in _parts(batches):
            values = centre.values(x) @ project
            each = np.repeat(np.arange(len(x)), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n, dtype=np.int64)),
                    centre.deviations(x).take(pa.array(each)),
                    pa.array(values.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
