"""Labelled texts to training data: counts, vocabulary, labels, encoded sequences, metrics."""

from __future__ import annotations

import json
from collections.abc import Mapping
from zlib import crc32

from pyspark.sql import Column, DataFrame, Window, functions as F

from broadsheet.fixed import ENGLISH, PAD_ID, UNK_ID, UNK_TOKEN
from broadsheet.functions.core import let, or_empty
from broadsheet.functions.text import tokens
from broadsheet.operators.lookup import hot_keys, lookup

MAX_SEQUENCE = 50
# Largest vocabulary that is looked up inside each row instead of by a join.
LOCAL_VOCABULARY = 100_000
_BUCKETS = 4096


def with_tokens(
    rows: DataFrame, language: str = ENGLISH, text: str = "text", lexicon: Mapping[str, int] | None = None
) -> DataFrame:
    """Add ``tokens``. Compute once and persist when several operators need them."""
    return rows.withColumn("tokens", tokens(F.col(text), language, lexicon))


def token_frequency(tokenised: DataFrame) -> DataFrame:
    """``token, cnt`` over all rows. The no-words sentinel is not a word.

    Counts combine before the shuffle, so a token in every row is one record per task.
    """
    return (
        tokenised.select(F.explode(or_empty(F.col("tokens"), "array<string>")).alias("token"))
        .filter(F.col("token") != UNK_TOKEN)
        .groupBy("token")
        .agg(F.count("*").alias("cnt"))
    )


def vocabulary(frequency: DataFrame, max_size: int = 10_000) -> DataFrame:
    """``token, cnt, id`` of the commonest tokens, ties by token, ids from 2.

    Ranks are given after the limit: at most ``max_size`` rows ever meet in one task.
    """
    top = frequency.orderBy(F.desc("cnt"), "token").limit(max(0, max_size - 2))
    order = Window.partitionBy().orderBy(F.desc("cnt"), "token")
    return top.withColumn("id", (F.row_number().over(order) + 1).cast("int"))


def sequence_length(tokenised: DataFrame, limit: int = MAX_SEQUENCE) -> DataFrame:
    """One row: the longest token list, at most ``limit``, which also stands for no rows."""
    longest = F.coalesce(F.max(F.size("tokens")), F.lit(limit))
    return tokenised.agg(F.least(longest, F.lit(limit)).cast("int").alias("seq_len"))


def label_index(rows: DataFrame, label: str = "label") -> DataFrame:
    """``label, idx`` from 0 in label order. Fewer than two labels is an error.

    Labels are classes: their number is that of the model's outputs, not of the rows.
    """
    distinct = rows.select(F.col(label).alias("label")).distinct()
    counted = distinct.withColumn("_n", F.count("*").over(Window.partitionBy()))
    order = Window.partitionBy().orderBy("label")
    enough = F.when(F.col("_n") >= 2, F.row_number().over(order) - 1).otherwise(
        F.raise_error(F.lit("At least 2 unique labels are required."))
    )
    return counted.select("label", enough.cast("int").alias("idx"))


def require_rows(rows: DataFrame, least: int, message: str) -> DataFrame:
    """The rows unchanged, or an error when there are fewer than ``least``.

    Only ``least`` rows are looked at to decide.
    """
    seen = rows.limit(least).agg(F.count("*").alias("n")).scalar()
    return rows.filter(
        F.when(seen >= least, F.lit(True)).otherwise(
            F.raise_error(F.lit(message)).cast("boolean")
        )
    )


def fit_length(ids: Column, length: int | Column) -> Column:
    """Cut or pad (with 0) an id array to exactly ``length``."""
    size = F.lit(length) if isinstance(length, int) else length
    cut = F.slice(ids, F.lit(1), size)
    return let(cut, lambda c: F.concat(c, F.array_repeat(F.lit(PAD_ID), size - F.size(c))))


def vocabulary_words(vocab: DataFrame, limit: int = LOCAL_VOCABULARY) -> list[str]:
    """Tokens in id order on the driver, an error when there are more than ``limit``."""
    rows = vocab.select("id", "token").orderBy("id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"vocabulary has more than {limit} tokens; use encode_by_join")
    return [row["token"] for row in rows]


def _lookup_table(words: list[str]) -> Column:
    """The vocabulary as one constant ARRAY<MAP<token, id>>, bucketed by checksum.

    Each map holds a few tokens, so a lookup costs the same whatever the vocabulary's size.
    """
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for token_id, word in enumerate(words, start=2):
        buckets[crc32(word.encode()) % _BUCKETS][word] = token_id
    # Parsed once, when the optimizer folds constants.
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def encode(tokenised: DataFrame, words: list[str], length: int) -> DataFrame:
    """Add ``ids``: token ids in order, unknown tokens 1, cut or padded to ``length``.

    ``words`` is a vocabulary of at most ``LOCAL_VOCABULARY`` tokens in id order. Ids are
    looked up inside the row, so nothing is shuffled; ``encode_by_join`` serves larger ones.
    """
    if len(words) > LOCAL_VOCABULARY:
        raise ValueError(f"more than {LOCAL_VOCABULARY} tokens; use encode_by_join")
    table = _lookup_table(words)

    def one(token: Column) -> Column:
        bucket = F.pmod(F.crc32(token.cast("binary")), F.lit(_BUCKETS)).cast("int")
        return F.coalesce(F.try_element_at(F.get(table, bucket), token), F.lit(UNK_ID))

    ids = F.transform(F.slice("tokens", 1, length), one)
    return tokenised.withColumn("ids", fit_length(ids, length))


def encode_by_join(
    tokenised: DataFrame, vocab: DataFrame, length: int, key: str = "id"
) -> DataFrame:
    """``encode`` for a vocabulary of any size, joined on the token.

    Only the first ``length`` tokens of a row are exploded. The vocabulary's own counts say which
    tokens are hot: those are looked up in a broadcast table of at most a thousand, wherever
    their rows are, and every other token is joined with its one row. A vocabulary without
    ``cnt`` counts the tokens first.
    """
    words = tokenised.select(key, F.posexplode(F.slice("tokens", 1, length)).alias("pos", "token"))
    if "cnt" in vocab.columns:
        counts = vocab.select("token", F.col("cnt").alias("count"))
    else:
        counts = words.groupBy("token").count()
    ids = vocab.select("token", F.col("id").alias("token_id"))
    found = lookup(words, ids, "token", "token_id", hot_keys(counts, "token"), F.struct(key, "pos"))
    entries = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(UNK_ID)).alias("token_id"))))
    listed = found.groupBy(key).agg(
        fit_length(F.transform(entries, lambda e: e["token_id"]), length).alias("ids")
    )
    return tokenised.join(listed, key)


def evaluation(scored: DataFrame) -> DataFrame:
    """Mean cross-entropy and accuracy of ``label_idx, predicted_idx, probability`` rows.

    ``probability`` is the one given to the true label. Null on an empty set.
    """
    return scored.agg(
        F.avg(-F.ln("probability")).alias("loss"),
        F.avg((F.col("label_idx") == F.col("predicted_idx")).cast("int")).alias("accuracy"),
        F.count("*").alias("n"),
    )
