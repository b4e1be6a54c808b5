"""Mixing sources to target weights, by distributed prefix sums over random keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from broadsheet.llm.common import partitions, written

SHARE = 1.5
WEIGHTS = (5, 2, 1)
EPOCHS = 2
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """Add ``target`` to one row per source with ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
    sizes. A target stops at ``epochs`` times its source's size and the excess is dealt out anew
    until none is above. That ends at min(level * weight, cap), and the level follows from
    prefix sums over the sources in the order in which they fill up, so nothing is iterated.
    """
    in_turn = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    place = F.row_number().over(by_name) - 1
    weighed = sources.withColumn("weight", F.get(in_turn, (place % len(weights)).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * epochs)
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    full_before = F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still_open = F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    wanted = F.sum("source_size").over(everything) * F.lit(float(share))
    levels = weighed.withColumn("level", (wanted - full_before) / still_open).withColumn(
        "nth", F.row_number().over(fills)
    )
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))
    level = F.min(holds).over(everything)["level"]
    target = F.least(F.coalesce(level * F.col("weight"), F.col("cap")), F.col("cap"))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    share: float = SHARE,
    weights: tuple[float, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row of ``docs``.

    A row gets the key md5(seed:doc_id). Rows are range-partitioned by (source, key), sums of the
    parts give every part its offset, and running sums inside a part give every row the number
    of words before it. A source's budget is its target without the fraction: as many whole
    passes as fit, then the first rows in key order; the row on the cut is taken in part, so
    the words taken equal the budget exactly. Ties of a key go by ``doc_id`` and size. Equal
    input gives equal output.

    A null text has size 0 and is never taken; null sources form one source, the last; null
    ids share one key. Repeated rows count each. No source, however large, meets in one task.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        size_of(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )
    order = ["source", "key", "doc_id", "size"]
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order)
    # Written, because the numbers of range partitions must not change once sums refer to them.
    placed = written(ranged.withColumn("part", F.spark_partition_id()), "mix-keys")
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    per_source = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    goals = targets(per_source, share, weights, epochs)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "source", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("offset")
    )
    same = F.col("o.source").eqNullSafe(F.col("g.source"))
    plan = written(
        offsets.alias("o").join(goals.alias("g"), same).select(
            "o.source", "o.part", "o.offset", "g.source_size", "g.target"
        ),
        "mix-parts",
    )
    matched = F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part"))
    joined = placed.alias("r").join(plan.alias("p"), matched).select(
        "r.*", "p.offset", "p.source_size", "p.target"
    )
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")
    earlier = F.coalesce(
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = budget - passes * F.col("source_size")
    partly = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("earlier")))
    return joined.withColumn("earlier", earlier).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (passes * F.col("size") + partly).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for every pass over it, with all columns.

    The last copy of a row that is taken in part holds its first words, joined by one space, and
    its ``n_chars`` if there is such a column. Rows that are not taken, and those without a word,
    are left out. ``doc_id`` names a document: repeated rows of one id all get the largest share of any of them, and
    rows with a null id share one.
    """
    taken, size, copy = (_free(docs, name) for name in ("taken", "size", "copy"))
    shares = (
        mix(docs, **options).filter(F.col("taken") > 0).groupBy("doc_id")
        .agg(F.max("taken").alias(taken), F.max_by("size", "taken").alias(size))
        .withColumnRenamed("doc_id", f"{taken}_id")
    )
    worded = docs.filter(size_of(F.col("text")) > 0)
    joined = worded.join(shares, worded["doc_id"].cast("long").eqNullSafe(shares[f"{taken}_id"]))
    copies = F.expr(f"explode(sequence(1L, ({taken} + {size} - 1) div {size})) AS {copy}")
    rows = joined.select("*", copies)
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    left = F.col(taken) - (F.col(copy) - 1) * F.col(size)
    cut = F.array_join(F.slice(words, F.lit(1), left.cast("int")), " ")
    text = F.when(left >= F.col(size), F.col("text")).otherwise(cut)
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(left >= F.col(size), F.col("n_chars")).otherwise(F.length(text))
    return rows.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken or f"{name}_id" in taken:
        name = f"_{name}"
    return name
