"""Embeddings as rows of numbers in binary form, checked once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.common import written


def checked(vectors: DataFrame) -> DataFrame:
    """``vec_id, data`` of the usable vectors, written; ``data`` are little-endian doubles.

    Left out are null ids and vectors that are null, empty, zero, hold a null or a non-finite
    component, or overflow when squared. Repeated rows of one id are one vector, the smallest.
    """
    one = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull()
    ).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def run(batches):
        for batch in batches:
            ids, data = [], []
            for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if not values.is_valid or values.values.null_count:
                    continue
                row = values.values.to_numpy(zero_copy_only=False).astype("<f8")
                with np.errstate(over="ignore", invalid="ignore"):
                    square = float(row @ row)
                if np.isfinite(square) and square > 0:
                    ids.append(vec_id)
                    data.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["vec_id", "data"])

    return written(one.mapInArrow(run, "vec_id long, data binary"), "vectors")


def matrix(data) -> np.ndarray:
    """Rows of one width from an Arrow column of ``data``."""
    cells = data.to_pylist()
    if not cells:
        return np.zeros((0, 0))
    width = len(cells[0])
    if any(len(c) != width for c in cells):
        raise ValueError("embeddings of different lengths")
    return np.frombuffer(b"".join(cells), dtype="<f8").reshape(len(cells), -1)


def sample(rows: DataFrame, count: int, most: int) -> np.ndarray:
    """About ``most`` of ``count`` vectors, chosen by a hash of the id."""
    share = int((1 << 30) * min(1.0, most / max(1, count)))
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).select("data")
    cells = [bytes(r["data"]) for r in drawn.collect()]
    return matrix(pa.array(sorted(cells), pa.binary()))
