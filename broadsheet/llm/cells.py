"""Embedding near-duplicates: spherical k-means cells, cosines in blocks inside each cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.common import written
from broadsheet.llm.components import components
from broadsheet.llm.vectors import checked, matrix, sample

THRESHOLD = 0.9
# Rows a cell is meant to hold, and the most cells; the centres are fitted on a sample.
CELL_ROWS, MOST_CELLS, SAMPLE, ROUNDS = 1_000, 4_096, 40_000, 8
# Cells that a vector goes into.
PROBES = 6
BLOCK_ROWS = 2_048
_TILE = 512
SEED = 42


def spherical_kmeans(rows: np.ndarray, k: int) -> np.ndarray:
    """Unit centres by Lloyd's rounds on cosine; ``rows`` is a bounded sample of unit vectors."""
    rng = np.random.default_rng(SEED)
    k = max(1, min(k, len(rows)))
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(ROUNDS):
        home = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        size = np.linalg.norm(sums, axis=1)
        empty = size < 1e-9
        centres = np.where(empty[:, None], centres, sums / np.where(empty, 1, size)[:, None])
    return centres


def _roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links of one block pair."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links inside one pair of blocks: per vector their number and a member to unite with."""
    cell, low, high = (table.column(c)[0].as_py() for c in ("cell", "low", "high"))
    order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
    ids = table.column("vec_id").to_numpy()[order]
    block = table.column("block").to_numpy()[order]
    probes = np.array(table.column("probes").to_pylist(), dtype=np.int32)[order]
    units = matrix(table.column("data"))[order]
    rows = np.flatnonzero(block == low)
    others = np.flatnonzero(block == high)
    lefts, rights = [], []
    for at in range(0, len(rows), _TILE):
        part = rows[at : at + _TILE]
        i, j = np.nonzero(units[part] @ units[others].T >= threshold)
        i, j = part[i], others[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        # A pair may meet in several cells: it counts in the first one only.
        first = np.full(len(i), np.iinfo(np.int32).max, dtype=np.int32)
        for p in range(probes.shape[1]):
            mine = probes[i, p]
            shared = (probes[j] == mine[:, None]).any(axis=1)
            first = np.where(shared, np.minimum(first, mine), first)
        lefts.append(i[first == cell])
        rights.append(j[first == cell])
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
    links = np.bincount(left, minlength=len(ids)) + np.bincount(right, minlength=len(ids))
    root = _roots(len(ids), left, right)
    linked = np.flatnonzero(links)
    return pa.table({"vec_id": ids[linked], "links": links[linked], "root": ids[root[linked]]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every ``vec_id``.

    Vectors link at cosine ``threshold`` or more, in double precision; ``n_links`` counts the
    links found, ``component_id`` is the smallest id reachable, and that vector is kept. Vectors
    are assigned to their ``probes`` nearest of the k-means cells and compared inside each
    cell, block against block. Every found pair is exact; a pair that shares no cell is missed
    (recall is measured in the tests and above 0.99 at the threshold itself for directions
    spread evenly in 64 dimensions, more for closer pairs).

    The number of cells follows the number of vectors. Large cells, such as those of a group of
    copies, are cut into blocks of about 2,048 rows by hash, and every pair of blocks is a
    group of its own, which returns at most one row per vector, never pairs.

    Null, zero and non-finite vectors have no links and are kept. Repeated rows of one ``vec_id``
    are one vector, a null ``vec_id`` is a vector without links whose component is null.
    """
    spark = vectors.sparkSession
    rows = checked(vectors)
    count = rows.count()
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    if not count:
        return _result(ids, None, None)
    drawn = sample(rows, count, SAMPLE)
    if not len(drawn):
        drawn = matrix(pa.array([bytes(rows.first()["data"])], pa.binary()))
    drawn = drawn / np.linalg.norm(drawn, axis=1)[:, None]
    centres = spherical_kmeans(drawn, min(MOST_CELLS, -(-count // CELL_ROWS)))
    probes = min(probes, len(centres))
    shipped = spark.sparkContext.broadcast(centres)

    def assign(batches):
        nearest = shipped.value
        for batch in batches:
            units = matrix(batch.column("data"))
            if not len(units):
                continue
            units = units / np.linalg.norm(units, axis=1)[:, None]
            scores = units @ nearest.T
            found = np.sort(np.argpartition(-scores, probes - 1, axis=1)[:, :probes], axis=1).astype(np.int32)
            cells = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), probes).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([u.tobytes() for u in units], pa.binary()), cells],
                ["vec_id", "data", "probes"],
            )

    assigned = written(rows.mapInArrow(assign, "vec_id long, data binary, probes array<int>"), "cells")
    placed = assigned.select("*", F.explode("probes").alias("cell"))
    # At most MOST_CELLS rows.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    cut = placed.join(F.broadcast(sizes), "cell").withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = cut.withColumn("other", other).select(
        "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "vec_id", "probes", "data",
    )
    found = written(
        pairs.groupBy("cell", "low", "high").applyInArrow(
            lambda table: _compare(table, threshold), "vec_id long, links long, root long"
        ),
        "links",
    )
    together = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    return _result(ids, found.groupBy("vec_id").agg(F.sum("links").alias("n_links")), together)


def _result(ids: DataFrame, links: DataFrame | None, together: DataFrame | None) -> DataFrame:
    if links is not None:
        ids = ids.join(links, "vec_id", "left").join(
            together.withColumnRenamed("node", "vec_id"), "vec_id", "left"
        )
    else:
        ids = ids.select("vec_id", F.lit(0).alias("n_links"), F.lit(None).cast("long").alias("component"))
    component = F.coalesce("component", "vec_id")
    return ids.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
