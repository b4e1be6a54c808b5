"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.common import drop_table, written


def _lowest(pairs: DataFrame) -> DataFrame:
    """Smallest id in each node's neighbourhood. Written, so that the join after it reads plain
    tables on both sides and adaptive execution can split a node with very many edges."""
    low = pairs.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"))
    return written(low, "stars")


def _star(pairs: DataFrame, both_ways: bool) -> tuple[DataFrame, DataFrame]:
    low = _lowest(pairs)
    joined = pairs.join(low, "a")
    if both_ways:  # larger neighbours move to the smallest one
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:  # smaller neighbours and the node itself do
        moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
    return moved.filter(F.col("a") != F.col("b")).distinct(), low


def _signature(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node.

    ``edges`` has two long columns ``a, b``; direction, repeats and loops do not matter, rows
    with a null are left out. The driver sees two numbers a round. Rounds grow with the
    logarithm of the number of nodes.
    """
    current = written(
        edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("b"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("x") != F.col("b")))
        .select(F.col("x").alias("a"), "b")
        .distinct(),
        "edges",
    )
    seen = _signature(current)
    while seen[0]:
        turned = current.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large, low_large = _star(current.unionByName(turned), True)
        middle = written(large, "edges")
        small, low_small = _star(middle, False)
        following = written(small, "edges")
        now = _signature(following)
        for table in (low_large, middle, low_small, current):
            drop_table(table)
        current = following
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
