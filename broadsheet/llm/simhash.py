"""SimHash near-duplicates: fingerprints of word shingles, linked by covering hash tables."""

from __future__ import annotations

from itertools import accumulate, combinations
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.common import written
from broadsheet.llm.components import components

BITS = 64
SEED = 42
# Shingles hashed at a time, so that a very long text needs no list of all its hashes.
CHUNK = 1 << 16
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_COLUMN = (np.arange(8) * 256)[None, :]


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The fingerprint of one UTF-8 text, unsigned; zero where there is no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    span = min(shingle, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    count = len(words) - span + 1
    digest = xxhash.xxh64_digest
    ones = np.zeros((8, 256), dtype=np.int64)
    for at in range(0, count, CHUNK):
        upto = min(count, at + CHUNK)
        hashes = b"".join(
            [digest(joined[s : e - 1], SEED) for s, e in zip(starts[at:upto], ends[at + span - 1 : upto + span - 1])]
        )
        rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8) + _COLUMN
        ones += np.bincount(rows.ravel(), minlength=2048).reshape(8, 256)
    set_bits = (ones @ _BITS_OF_BYTE) * 2 > count
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` of every document; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            values = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"]
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks such that any two values at most ``radius`` bits apart agree under one of them.

    Every bit gets a non-zero vector of ``radius + 1`` bits, evenly. The mask of a non-zero vector
    v keeps the bits whose vectors have an odd product with v. The vectors of ``radius`` bits
    span less than the whole space, so some v is orthogonal to all of them: its mask holds
    none of the differing bits.
    """
    order = list(range(bits))
    Random(SEED).shuffle(order)
    vectors = range(1, 2 ** (radius + 1))
    given = {bit: vectors[i % len(vectors)] for i, bit in enumerate(order)}
    return [
        sum(1 << b for b in range(bits) if (given[b] & v).bit_count() % 2 == 1) for v in vectors
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _flips(masks: list[int], radius: int) -> list[tuple[int, int, int]]:
    """Per table the patterns of at most half the radius outside its mask, and whether a pattern
    is beyond the lower half."""
    found = []
    for t, mask in enumerate(masks):
        free = [b for b in range(BITS) if not mask >> b & 1]
        for n in range((radius + 1) // 2 + 1):
            for chosen in combinations(free, n):
                found.append((t, _signed(sum(1 << b for b in chosen)), int(n > radius // 2)))
    return found


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints at most ``radius`` bits apart.

    ``nodes`` has distinct ``fp`` and ``node``. A fingerprint goes into one bucket of each covering
    table; a pair in range meets in at least one of them. Pairs in a bucket are not compared:
    two members in range have a midpoint that differs from both only outside the mask and by
    half the radius, so members meet again under their midpoints. The members of one
    midpoint are few (those within half the radius of it), all in range of each other (of its
    inner ones, for odd radii), and become a star. The work is linear in the size of a bucket,
    however large, and no pair is lost.
    """
    spark = nodes.sparkSession
    masks = covering_masks(radius)
    keys = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for t, m in enumerate(masks)
        ]
    )
    placed = nodes.select("fp", "node", F.inline(keys))
    shared = placed.groupBy("t", "key").count().filter("count > 1").select("t", "key")
    met = placed.join(shared, ["t", "key"], "left_semi")
    # Bounded by the radius alone: 7 tables of 28 or 29 patterns for radius 2.
    flips = F.broadcast(spark.createDataFrame(_flips(masks, radius), "t int, flip long, far int"))
    middles = met.join(flips, "t").select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"), F.struct("far", "node").alias("m")
    )
    balls = middles.groupBy("middle").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    stars = balls.filter((F.size("ms") > 1) & (F.col("ms")[0]["far"] == 0))
    return stars.select(
        F.col("ms")[0]["node"].alias("b"), F.explode(F.slice("ms", 2, 1 << 30)).alias("m")
    ).select(F.col("m.node").alias("a"), "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` of every document.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest
    ``doc_id`` reachable over links, the document itself included. A null or wordless text has
    fingerprint zero and is linked like any other. Repeated rows come back repeated. A row whose
    ``doc_id`` is null shares the component of the documents with its very fingerprint, or has
    a null one where there are none. Other columns are not read. An empty table gives an
    empty result.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(
        prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes"
    )
    found = components(links(nodes.filter(F.col("node").isNotNull()), radius))
    of_print = written(
        nodes.join(found, "node", "left").select(
            F.col("fp"), F.coalesce("component", "node").alias("component_id")
        ),
        "fingerprint-components",
    )
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The documents without near copies: of each component the row of the smallest ``doc_id``.

    All columns are kept. ``doc_id`` names a document, so repeated rows of one ``doc_id`` become
    one (the smallest row, if they differ; maps are compared as JSON text). Rows whose ``doc_id``
    is null are kept.
    """
    found = near_duplicates(docs, shingle, radius)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # The smallest row per id is an aggregate on the key that the join has already dealt out.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "doc_id"])
    rest = [f for f in docs.schema if f.name != "doc_id"]
    if any("map<" in f.dataType.simpleString() for f in rest):
        texts = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in rest]
        least = F.min_by(whole, F.struct(*texts))
    else:
        least = F.min(whole)
    first = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(least.alias("row"))
    named = first.select("doc_id", "row.*").select(*[F.col(f"`{c}`") for c in docs.columns])
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
