"""The training corpus: language, near copies, repeated passages, mixture, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; all but
the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.llm import bpe, language, mixing, simhash, substrings
from broadsheet.llm.common import importable, written

WORD_TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (or text) go; a missing ``lang`` is filled in.

    Other columns stay as they are, whatever their names; null ids and repeated rows are kept.
    """
    names = ("lang_pred", "score")
    while {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        names = tuple(f"_{n}" for n in names)
    found = language.predict(docs, language.train(docs), names).filter(F.col(names[0]) != language.UNDETERMINED)
    filled = F.coalesce("lang", names[0]).alias("lang")
    return found.select(*[filled if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest ``doc_id``.

    Null ids stay; repeated rows of one id become one.
    """
    return simhash.drop_near_duplicates(docs, shingle=3, radius=2)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that stand in a passage of 13 words of an earlier document; all rows and other
    columns stay."""
    return substrings.drop_repeated(docs, window=13)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every pass over a document in the mixture; rows with a null id share one share."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and the digest of the decoded text, a row for each row."""
    done = bpe.encode(docs, public_tokenizers.path(WORD_TOKENIZER))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_texts),
]

# Fingerprints, a fitted language model and merge ranks are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, f"stage-{number}")
    return docs
