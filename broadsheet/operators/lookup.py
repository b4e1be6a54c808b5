"""Joins on keys of which a few hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A key is hot if it holds at least one row in this many; no more keys than that can be hot.
SHARE = 1_000
# Rows of hot keys are dealt over so many places, as they need none.
SPREAD = 4_096


def hot_keys(counts: DataFrame, key: str, count: str = "count", share: int = SHARE) -> DataFrame:
    """The keys of ``counts`` that hold at least one in ``share`` of all rows: ``share`` at most."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.filter(F.col(key).isNotNull() & (F.col(count) * share >= total)).select(key)


def lookup(
    rows: DataFrame, table: DataFrame, key: str, value: str, hot: DataFrame, by: Column
) -> DataFrame:
    """``rows`` with ``value`` of the one row of ``table`` with its ``key``, null where there is none.

    Rows of ``hot`` keys (few, see ``hot_keys``) find their value in a broadcast table of those
    alone and are then dealt out by ``by``, any column that tells rows apart; all others meet
    their key in a plain join. The table is not copied, and no task gets more rows of a key
    than one in ``SHARE``.
    """
    pairs = table.select(key, value).filter(F.col(key).isNotNull())
    few = pairs.join(F.broadcast(hot.select(key)), key, "left_semi").select(
        F.col(key).alias("_hot_key"), F.col(value).alias("_hot_value")
    )
    marked = rows.join(F.broadcast(few), rows[key] == F.col("_hot_key"), "left")
    # The second key of the join tells hot rows apart; those of the table have none there.
    place = F.when(F.col("_hot_key").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SPREAD)) + 1).otherwise(F.lit(0))
    rest = pairs.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(0).cast("long").alias("_zero"))
    left = marked.withColumn("_place", place.cast("long"))
    found = left.join(rest, (left[key] == F.col("_key")) & (F.col("_place") == F.col("_zero")), "left")
    return found.select(*rows.columns, F.coalesce("_hot_value", "_value").alias(value))
