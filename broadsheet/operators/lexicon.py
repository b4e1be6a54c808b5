"""A lexicon of Han words learned from texts: how often, how firmly, and among which neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from broadsheet.functions.text import HAN, LONGEST_RUN, LONGEST_WORD
from broadsheet.session import kept

LEXICON_SIZE = 50_000


def _entropy(neighbours: DataFrame, side: str) -> DataFrame:
    """``gram, cnt`` and the entropy of the characters on one side."""
    counts = neighbours.groupBy("gram", side).agg(F.sum("n").alias("n"))
    sums = counts.groupBy("gram").agg(F.sum("n").alias("cnt"), F.sum(F.col("n") * F.ln("n")).alias("logs"))
    return sums.select("gram", "cnt", (F.ln("cnt") - F.col("logs") / F.col("cnt")).alias(f"{side}_entropy"))


def learn_lexicon(
    rows: DataFrame,
    text: str = "text",
    size: int = LEXICON_SIZE,
    least_count: int = 5,
    least_entropy: float = 0.7,
    least_cohesion: float = 1.0,
) -> DataFrame:
    """``word, cnt, score`` of Han words of up to four characters.

    Every Han character is a word. A longer sequence is one if it occurs ``least_count`` times,
    if the characters before it and behind it vary (entropy, in nats, where the end of a run is
    a character of its own), and if it is that much more frequent than its parts would make it
    (the least pointwise mutual information over the places it can be cut). At most ``size`` of
    these are kept, the commonest; there are some 21,000 characters. ``score`` is a thousand times
    the logarithm of a word's share, rounded, so sums of scores are exact.

    Equal runs are counted first, and sequences with their neighbours before any join, so a
    character that is everywhere is one row per task and neighbour.
    """
    runs = (
        rows.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({HAN}{{1,{LONGEST_RUN}}})"), F.lit(1))).alias("run"))
        .groupBy("run").agg(F.count("*").alias("n"))
    )
    length = F.length("run")
    places = runs.select("run", "n", F.explode(F.sequence(F.lit(1), length)).alias("at"))
    spans = places.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), length - F.col("at") + 1))).alias("size"))
    neighbours = kept(
        spans.select(
            "n",
            F.substring("run", F.col("at"), F.col("size")).alias("gram"),
            F.when(F.col("at") > 1, F.substring("run", F.col("at") - 1, F.lit(1))).otherwise("").alias("left"),
            F.substring("run", F.col("at") + F.col("size"), F.lit(1)).alias("right"),
        ).groupBy("gram", "left", "right").agg(F.sum("n").alias("n"))
    )
    stats = kept(_entropy(neighbours, "left").join(_entropy(neighbours, "right").drop("cnt"), "gram"))
    total = stats.filter(F.length("gram") == 1).agg(F.sum("cnt")).scalar()

    frequent = stats.filter((F.length("gram") > 1) & (F.col("cnt") >= least_count)).filter(
        F.least("left_entropy", "right_entropy") >= least_entropy
    )
    cut = frequent.select("gram", "cnt", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("at"))
    heads = stats.select(F.col("gram").alias("head"), F.col("cnt").alias("head_cnt"))
    tails = stats.select(F.col("gram").alias("tail"), F.col("cnt").alias("tail_cnt"))
    parts = cut.withColumns(
        {"head": F.substring("gram", F.lit(1), F.col("at")), "tail": F.substring("gram", F.col("at") + 1, F.length("gram"))}
    ).join(heads, "head").join(tails, "tail")
    firmness = F.ln(F.col("cnt") * total / (F.col("head_cnt") * F.col("tail_cnt")))
    firm = parts.groupBy("gram", "cnt").agg(F.min(firmness).alias("cohesion")).filter(F.col("cohesion") >= least_cohesion)
    words = firm.orderBy(F.desc("cnt"), "gram").limit(size).select("gram", "cnt")
    single = stats.filter(F.length("gram") == 1).select("gram", "cnt")
    return words.unionByName(single).select(
        F.col("gram").alias("word"), "cnt", F.round(1000 * F.ln(F.col("cnt") / total)).cast("int").alias("score")
    )


def lexicon_scores(lexicon: DataFrame, limit: int = 2 * LEXICON_SIZE) -> dict[str, int]:
    """``word -> score`` on the driver, an error when there are more than ``limit`` words."""
    rows = lexicon.select("word", "score").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"lexicon has more than {limit} words")
    return {r["word"]: r["score"] for r in sorted(rows, key=lambda r: r["word"])}
