"""Latest and random selections over the archive, and exact seeded splits.

Random order is the order of ``md5(seed:id)``: reproducible, and a lost task that is run again
picks the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from broadsheet.operators.lookup import hot_keys, lookup
from broadsheet.schemas import BUCKET_COLUMN, PARTITION_COLUMN, UNDATED
from broadsheet.session import kept


def seeded_key(seed: int | str, key: Column) -> Column:
    """Position of a row in the seeded random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


# Picks at most whose ids are put into the query, and whose keys are broadcast.
_FEW = 1_000


def _fetch(archive: DataFrame, picks: DataFrame, n: int) -> DataFrame:
    """Full rows of at most ``n`` picked keys of the stored archive.

    Only narrow columns are read to pick, and the picks are checkpointed, so they are made once.
    The rows come from a second read of the buckets that the picks fall into, at most ``n``; all
    others are pruned when the query runs. The ids of few picks are pushed down to the files,
    where rows are sorted by id.
    """
    keys = ["id", "url", PARTITION_COLUMN, BUCKET_COLUMN]
    place = F.struct(PARTITION_COLUMN, BUCKET_COLUMN)
    places = picks.agg(F.collect_set(place)).scalar()
    opened = archive.filter(F.array_contains(places, place))
    wanted = picks.select(*keys)
    if n > _FEW:
        return opened.join(wanted, keys, "left_semi")
    ids = [r.id for r in wanted.select("id").collect()]
    return opened.filter(F.col("id").isin(ids)).join(F.broadcast(wanted), keys, "left_semi")


def _is_stored(archive: DataFrame) -> bool:
    return PARTITION_COLUMN in archive.columns


def _narrow(archive: DataFrame) -> DataFrame:
    if not _is_stored(archive):
        return archive
    return archive.select("id", "url", "publish_time", PARTITION_COLUMN, BUCKET_COLUMN)


def _newest_days(archive: DataFrame, n: int) -> DataFrame:
    """The newest days that together hold ``n`` rows; the undated day is the oldest.

    Rows per day need no column, only the files' row counts. The window runs over days.
    """
    newer = Window.orderBy(F.desc(PARTITION_COLUMN)).rowsBetween(Window.unboundedPreceding, -1)
    days = archive.groupBy(PARTITION_COLUMN).agg(F.count("*").alias("rows"))
    needed = days.withColumn("before", F.coalesce(F.sum("rows").over(newer), F.lit(0)))
    first = needed.filter(F.col("before") < n).agg(F.min(PARTITION_COLUMN).alias("day")).scalar()
    return archive.filter(F.col(PARTITION_COLUMN) >= first)


def latest(archive: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` newest rows, undated ones last, ties by id."""
    order = [F.desc_nulls_last("publish_time"), F.asc("id")]
    recent = _newest_days(archive, n) if _is_stored(archive) else archive
    top = _narrow(recent).orderBy(*order).limit(n)
    if not _is_stored(archive):
        return top
    return _fetch(archive, kept(top), n).orderBy(*order).limit(n)


def unseen(archive: DataFrame, history: DataFrame) -> DataFrame:
    """Rows not in the reader's history.

    Ids are hashes of URLs, so where both sides have the URL it is part of the key.
    """
    keys = ["id", "url"] if "url" in archive.columns and "url" in history.columns else ["id"]
    return archive.join(history.select(*keys).distinct(), keys, "left_anti")


def random_one_unseen(archive: DataFrame, history: DataFrame, seed: int | str) -> DataFrame:
    """One random unseen row; none at all when the archive has one row or fewer."""
    enough = archive.select("id").limit(2).agg((F.count("*") > 1).alias("enough")).scalar()
    candidates = unseen(_narrow(archive), history).filter(enough)
    picked = candidates.orderBy(seeded_key(seed, F.col("id")), "id").limit(1)
    return _fetch(archive, kept(picked), 1) if _is_stored(archive) else picked


def random_batch_unseen(
    archive: DataFrame,
    history: DataFrame,
    now: datetime | Column,
    seed: int | str,
    min_age_days: int = 7,
    n: int = 10,
) -> DataFrame:
    """Exactly ``n`` random unseen rows at least ``min_age_days`` old, or none.

    The candidates are read once: the picks are checkpointed, and the guard counts those.
    """
    if n <= 0:
        return archive.limit(0)
    moment = now if isinstance(now, Column) else F.lit(now)
    cutoff = moment - F.make_dt_interval(F.lit(max(0, min_age_days)))
    old = _narrow(archive).filter(F.col("publish_time") <= cutoff)
    if _is_stored(archive):  # days after the cutoff are never opened, nor is that of undated rows
        last_day = F.to_date(F.to_utc_timestamp(cutoff, F.current_timezone()))
        old = old.filter((F.col(PARTITION_COLUMN) <= last_day) & (F.col(PARTITION_COLUMN) != F.lit(UNDATED).cast("date")))
    order = [seeded_key(seed, F.col("id")), F.col("id")]
    picked = kept(unseen(old, history).orderBy(*order).limit(n))
    enough = picked.agg((F.count("*") == n).alias("enough")).scalar()
    return (_fetch(archive, picked, n) if _is_stored(archive) else picked).filter(enough)


def _bucket_cut(keyed: DataFrame, digits: int, wanted: Column) -> DataFrame:
    """The key prefix that holds row number ``wanted``, and how many rows to take from it.

    Prefix counts come from a partial aggregate; at most 16**4 of them are ranked.
    """
    counts = keyed.groupBy(F.substring("_key", 1, digits).alias("prefix")).agg(
        F.count("*").alias("rows")
    )
    upto = counts.withColumn(
        "upto", F.sum("rows").over(Window.partitionBy().orderBy("prefix"))
    )
    return upto.withColumn("wanted", wanted).filter(
        (F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("rows") < F.col("wanted"))
    ).select(
        F.struct(
            F.col("prefix"), (F.col("wanted") - F.col("upto") + F.col("rows")).alias("take")
        ).alias("cut")
    )


def split_edge(
    rows: DataFrame, seed: int | str, id_column: str = "id", valid_share: float = 0.2
) -> Column:
    """``_key, _id`` of the last row, in seeded order, that is not held out.

    The cut point is found by counting key prefixes twice (four, then eight hex digits) and
    ranking only the rows that share the last prefix, about one in four billion. Ids must be
    unique. No global sort, no single-task window over the rows.
    """
    slim = rows.select(seeded_key(seed, F.col(id_column)).alias("_key"), F.col(id_column).alias("_id"))
    train = slim.agg(
        (F.count("*") - F.floor(F.count("*") * F.lit(float(valid_share)))).alias("n")
    ).scalar()

    first = _bucket_cut(slim, 4, train).scalar()
    near = slim.withColumn("_cut", first).filter(
        F.substring("_key", 1, 4) == F.col("_cut.prefix")
    )
    second = _bucket_cut(near.drop("_cut"), 8, first["take"]).scalar()
    return (
        slim.withColumn("_cut", second)
        .filter(F.substring("_key", 1, 8) == F.col("_cut.prefix"))
        .withColumn("_n", F.row_number().over(Window.partitionBy().orderBy("_key", "_id")))
        .filter(F.col("_n") == F.col("_cut.take"))
        .select(F.struct("_key", "_id").alias("edge"))
    ).scalar()


def split_at(rows: DataFrame, edge: Column, seed: int | str, id_column: str = "id") -> DataFrame:
    """Add ``split``: 'train' for rows up to ``edge`` (see ``split_edge``), 'valid' behind it."""
    keyed = rows.withColumn("_key", seeded_key(seed, F.col(id_column)))
    before = (F.col("_key") < F.col("_edge._key")) | (
        (F.col("_key") == F.col("_edge._key")) & (F.col(id_column) <= F.col("_edge._id"))
    )
    return (
        keyed.withColumn("_edge", edge)
        .withColumn("split", F.when(before, "train").otherwise("valid"))
        .drop("_key", "_edge")
    )


def split_exact(
    rows: DataFrame, seed: int | str, id_column: str = "id", valid_share: float = 0.2
) -> DataFrame:
    """Add ``split``: the last ``floor(share * n)`` rows in seeded order are 'valid'."""
    return split_at(rows, split_edge(rows, seed, id_column, valid_share), seed, id_column)


# Places per chunk when a reader's history is counted rather than listed.
CHUNK = 4096


def random_batch_per_reader(
    archive: DataFrame,
    history: DataFrame,
    now: datetime | Column,
    seed: int | str,
    min_age_days: int = 7,
    n: int = 10,
) -> DataFrame:
    """``random_batch_unseen`` for every reader of ``history(reader, id)`` at once.

    All readers share one seeded order, so a batch is the first ``n`` places of it that the
    reader has not seen, and the k-th of them is place k plus the number of seen places before
    it. No reader is paired with the whole archive. The order is made once, from two reads of
    the archive's narrow columns, and kept as a checkpoint. Articles that very many readers have
    seen, and places that very many readers are given, are looked up as hot keys.

    Seen places are counted per chunk of ``CHUNK`` places. Chunks seen in full, and chunks after
    the n-th unseen place, need no more than their count; only the at most ``n`` others per
    reader are listed. A reader who has seen most of the archive is spread over many tasks.

    Output: ``reader, pick, id`` with ``pick`` from 1 to ``n``.
    """
    if n <= 0:
        return history.select("reader", F.lit(0).alias("pick"), "id").limit(0)
    moment = now if isinstance(now, Column) else F.lit(now)
    cutoff = moment - F.make_dt_interval(F.lit(max(0, min_age_days)))
    old = archive.filter(F.col("publish_time") <= cutoff).select("id")
    placed = kept(with_place(old, seed).select("id", "place"))
    size = placed.agg(F.count("*").alias("n")).scalar()

    past = history.select("reader", "id").distinct()
    read_by = history.groupBy("id").count()
    seen = (
        lookup(past, placed, "id", "place", hot_keys(read_by, "id"), F.struct("reader", "id"))
        .filter(F.col("place").isNotNull())
        .select("reader", "place", F.floor((F.col("place") - 1) / CHUNK).alias("chunk"))
    )
    start = F.col("chunk") * CHUNK
    earlier = Window.partitionBy("reader").orderBy("chunk")
    counts = (
        seen.groupBy("reader", "chunk")
        .agg(F.count("*").alias("rows"))
        .withColumn("seen_before", F.sum("rows").over(earlier) - F.col("rows"))
        .withColumn("unseen_before", start - F.col("seen_before"))
        .filter(F.col("unseen_before") < n)
    )
    full = F.col("rows") == CHUNK
    whole = counts.filter(full).select("reader", "unseen_before", "rows")
    inside = Window.partitionBy("reader", "chunk").orderBy("place")
    listed = (
        seen.join(counts.filter(~full), ["reader", "chunk"])
        .withColumn("unseen_before", F.col("place") - F.col("seen_before") - F.row_number().over(inside))
        .select("reader", "unseen_before", F.lit(1).cast("long").alias("rows"))
    )
    # How many seen places stand before the k-th unseen one.
    before = [
        F.coalesce(F.sum(F.when(F.col("unseen_before") < k, F.col("rows"))), F.lit(0)).alias(f"b{k}")
        for k in range(1, n + 1)
    ]
    readers = history.select("reader").distinct()
    shifts = whole.unionByName(listed).groupBy("reader").agg(*before)
    picks = F.array(
        *[
            F.struct(
                F.lit(k).alias("pick"), (F.lit(k) + F.coalesce(f"b{k}", F.lit(0))).alias("place")
            )
            for k in range(1, n + 1)
        ]
    )
    # The last pick lies within the archive exactly when the reader has n unseen rows.
    batches = (
        readers.join(shifts, "reader", "left")
        .withColumn("size", size)
        .filter(F.lit(n) + F.coalesce(f"b{n}", F.lit(0)) <= F.col("size"))
        .select("reader", F.inline(picks))
    )
    given = hot_keys(batches.groupBy("place").count(), "place")
    picked = lookup(batches, placed, "place", "id", given, F.struct("reader", "pick"))
    return picked.select("reader", "pick", "id")


def with_place(rows: DataFrame, seed: int | str) -> DataFrame:
    """Add ``place``: the row's number, from 1, in the seeded order of all rows.

    Rows are ranked inside key-prefix buckets of a few rows each; bucket offsets come from
    counting the prefixes, so no task ranks more than one bucket.
    """
    keyed = rows.withColumn("_key", seeded_key(seed, F.col("id")))
    bucketed = keyed.withColumn("_bucket", F.substring("_key", 1, 4))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    offsets = counts.select(
        "_bucket",
        (F.sum("_rows").over(Window.partitionBy().orderBy("_bucket")) - F.col("_rows")).alias(
            "_offset"
        ),
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", "id"))
    # At most 16**4 offsets.
    return (
        bucketed.withColumn("_rank", inside)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("place", F.col("_rank") + F.col("_offset"))
        .drop("_key", "_bucket", "_rank", "_offset")
    )
