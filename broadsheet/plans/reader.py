"""The reading path: what to show next, and its text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from broadsheet.operators.articles import render
from broadsheet.operators.selection import latest, random_batch_unseen, random_one_unseen

START_COUNT = 10
BATCH_SIZE, BATCH_MIN_AGE_DAYS = 5, 3


def opening(archive: DataFrame) -> DataFrame:
    """What a reader starts with."""
    return latest(archive, START_COUNT)


def next_batch(
    archive: DataFrame, history: DataFrame, now: datetime | Column, seed: int | str
) -> DataFrame:
    """The next rows for a reader who has read to the end of the history."""
    return random_batch_unseen(
        archive, history, now, seed, min_age_days=BATCH_MIN_AGE_DAYS, n=BATCH_SIZE
    )


def previous_one(archive: DataFrame, history: DataFrame, seed: int | str) -> DataFrame:
    """A row to put before the start of the history."""
    return random_one_unseen(archive, history, seed)


def extend_history(history: DataFrame, batch: DataFrame) -> DataFrame:
    """History plus a batch."""
    return history.unionByName(batch, allowMissingColumns=True)


def spoken(rows: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """``id, spoken`` sentences of archive rows."""
    fields = ["title", "publisher", "publish_time", "category", "content"]
    return rows.select("id", render(*map(F.col, fields), now, zone).alias("spoken"))
