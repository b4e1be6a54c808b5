"""Nearest neighbours along shifted Hilbert curves, made exact by bounded blocks of the curve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, Window

from broadsheet.llm.common import partitions, written
from broadsheet.llm.vectors import checked, matrix

K = 20
CURVES, DIMENSIONS, BITS = 4, 6, 10
# Rows of a window block; rows of a group and queries of a chunk in the exact pass.
BLOCK, GROUP, CHUNK = 256, 8_192, 2_048
SEED = 42


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (rows, 0 to 2**bits - 1) on the Hilbert curve.

    Skilling's transform (AIP Conf. Proc. 707, 2004), a whole column of points at a time.
    """
    x = [c.astype(np.uint64) for c in points.T]
    zero = np.uint64(0)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(len(x)):
            turned = (x[i] & q) > 0
            swap = np.where(turned, zero, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            if i:
                x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - np.uint64(1), zero)
        q >>= np.uint64(1)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for column in x:
            key = key << np.uint64(1) | (column ^ turn) >> np.uint64(b) & np.uint64(1)
    return key.astype(np.int64)


def curve_keys(units: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on one curve: a random projection of its own, then a random shift."""
    rng = np.random.default_rng((SEED, curve))
    width = units.shape[1]
    used = min(DIMENSIONS, width)
    axes = np.linalg.qr(rng.normal(size=(width, used)))[0]
    # Components of unit vectors gather within a few 1/sqrt(width) of zero.
    spread = min(1.0, 4 / np.sqrt(width))
    shift = rng.random(used)
    scaled = ((units @ axes) / spread + 1 + shift) / 3
    return hilbert_keys(np.clip(scaled * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _best(scores: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
    """Per query its ``k`` best columns, ties to the smaller id: query, id and score in lists."""
    scores = np.where(queries[:, None] == ids[None, :], -np.inf, scores)
    if floor is not None:
        scores = np.where(scores >= floor[:, None], scores, -np.inf)
    if scores.shape[1] > k:
        last = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        scores = np.where(scores >= last[:, None], scores, -np.inf)
    q, c = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[c], -scores[q, c], q))
    q, c = q[order], c[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    q, c = q[rank < k], c[rank < k]
    return queries[q], ids[c], scores[q, c]


def _found(query, ids, score) -> pa.Table:
    return pa.table({"query_id": query, "vec_id": ids, "score": score})


_FOUND = "query_id long, vec_id long, score double"


def _window(table: pa.Table, k: int) -> pa.Table:
    """One block of a curve against the queries of this block and the two beside it."""
    ask = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
    ids, rows = table.column("vec_id").to_numpy(), matrix(table.column("data"))
    if ask.all() or not ask.any():
        return _found(ids[:0], ids[:0], np.zeros(0))
    return _found(*_best(rows[ask] @ rows[~ask].T, ids[ask], ids[~ask], k))


def _exact(table: pa.Table, k: int) -> pa.Table:
    """A group of blocks against a chunk of queries. A block whose bounding ball cannot hold a
    score of at least a query's floor is left out for that query."""
    ask = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
    ids, rows = table.column("vec_id").to_numpy(), matrix(table.column("data"))
    floor = table.column("floor").to_numpy(zero_copy_only=False)[ask]
    block = table.column("block").to_numpy(zero_copy_only=False)
    queries, query_ids = rows[ask], ids[ask]
    length = np.linalg.norm(queries, axis=1)
    parts = []
    for b in np.unique(block[~ask]):
        chosen = np.flatnonzero(~ask & (block == b))
        some = rows[chosen]
        centre = some.mean(axis=0)
        radius = np.linalg.norm(some - centre, axis=1).max()
        highest = queries @ centre + length * radius
        near = np.flatnonzero(highest * (1 + 1e-12) + 1e-9 * length >= floor)
        if len(near):
            parts.append(_best(queries[near] @ some.T, query_ids[near], ids[chosen], k, floor[near]))
    if not parts:
        return _found(ids[:0], ids[:0], np.zeros(0))
    query, found, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return _found(query[rank < k], found[rank < k], score[rank < k])


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products with every query.

    ``queries`` says which rows (by ``vec_id``) ask; candidates are all other rows. All rows are
    put on several Hilbert curves over random projections, range-partitioned by key, and cut
    into blocks. A query is scored against its own and the two neighbouring blocks of every
    curve; merged, those windows give ``k`` candidates and a floor for its k-th score. An
    exact pass then reads the first curve in blocks of neighbouring keys and scores those
    that could still hold better rows: a block is left out where its bounding ball lies below
    the floor. Results are therefore exact; how many blocks are left out depends on how
    clustered the vectors are (evenly spread directions leave out few, and the pass is then
    queries times rows, in groups of 8,192 rows and 2,048 queries or so).

    Scores are inner products of the vectors as they are, in double precision. Ties go to the
    smaller ``vec_id``. Null, zero and non-finite vectors take no part; repeated rows of one
    ``vec_id`` are one vector; with fewer than ``k`` candidates all are returned.
    """
    spark = vectors.sparkSession
    rows = checked(vectors)

    def keyed(batches):
        for batch in batches:
            data = matrix(batch.column("data"))
            if not len(data):
                continue
            units = data / np.linalg.norm(data, axis=1)[:, None]
            for curve in range(CURVES):
                keys = pa.array(curve_keys(units, curve))
                number = pa.array(np.full(len(units), curve, np.int32))
                yield pa.RecordBatch.from_arrays([number, keys, *batch.columns], ["curve", "key", "vec_id", "data"])

    def numbered(batches):
        part, counts = TaskContext.get().partitionId(), [0] * CURVES
        for batch in batches:
            curves = batch.column("curve").to_numpy()
            place = np.zeros(len(curves), np.int64)
            for curve in np.unique(curves):
                own = np.flatnonzero(curves == curve)
                place[own] = counts[curve] + np.arange(len(own))
                counts[curve] += len(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("curve"), pa.array(np.full(len(curves), part, np.int32)), pa.array(place // BLOCK),
                 batch.column("vec_id"), batch.column("data")],
                ["curve", "part", "own_block", "vec_id", "data"],
            )

    on_curves = rows.mapInArrow(keyed, "curve int, key long, vec_id long, data binary")
    ordered = on_curves.repartitionByRange(partitions(spark), "curve", "key", "vec_id").sortWithinPartitions(
        "curve", "key", "vec_id"
    )
    placed = written(
        ordered.mapInArrow(numbered, "curve int, part int, own_block long, vec_id long, data binary"), "curves"
    )
    # Blocks are numbered along each curve; a row per curve and partition.
    blocks = placed.groupBy("curve", "part").agg((F.max("own_block") + 1).alias("n"))
    along = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("curve", "part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"))
    laid = placed.join(starts, ["curve", "part"]).select(
        "curve", (F.col("start") + F.col("own_block")).alias("block"), "vec_id", "data"
    )
    laid = written(laid, "curve-blocks")
    asking = laid.filter(queries)
    beside = F.explode(F.array(*[F.col("block") + d for d in (-1, 0, 1)]))
    windows = laid.withColumn("is_query", F.lit(False)).unionByName(
        asking.withColumn("beside", beside).select("curve", F.col("beside").alias("block"), "vec_id", "data", F.lit(True).alias("is_query"))
    )
    near = windows.groupBy("curve", "block").applyInArrow(lambda t: _window(t, k), _FOUND)
    merged = written(_ranked(near, k), "windows")
    floors = merged.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))

    first = laid.filter("curve = 0").drop("curve")
    last = first.agg(F.max("block")).first()[0] or 0
    groups, chunks = last // (GROUP // BLOCK) + 1, last // (CHUNK * 20 // BLOCK) + 1
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    data = first.select(
        F.expr(f"cast(block div {GROUP // BLOCK} as int)").alias("group"), every_chunk.alias("chunk"),
        "block", "vec_id", "data", F.lit(False).alias("is_query"), F.lit(0.0).alias("floor"),
    )
    asked = first.filter(queries).join(floors, "vec_id", "left").select(
        every_group.alias("group"), F.expr(f"cast(block div {CHUNK * 20 // BLOCK} as int)").alias("chunk"),
        "block", "vec_id", "data", F.lit(True).alias("is_query"),
        F.coalesce("floor", F.lit(float("-inf"))).alias("floor"),
    )
    further = data.unionByName(asked).groupBy("group", "chunk").applyInArrow(lambda t: _exact(t, k), _FOUND)
    both = merged.select("query_id", "vec_id", "score").unionByName(further)
    return _ranked(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
