"""Labelled corpora: sources, vocabulary, splits, encoding, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.operators.corpus import (
    encode,
    encode_by_join,
    evaluation,
    label_index,
    require_rows,
    sequence_length,
    token_frequency,
    vocabulary,
    vocabulary_words,
    with_tokens,
)
from broadsheet.operators.selection import split_exact
from broadsheet.queries.common import WS_CHARS_SQL, query, table
from broadsheet.session import shared_dir
from broadsheet.sources.corpora import (
    corpus_rejects,
    corpus_rows,
    read_delimited,
    read_labelled_csv,
    read_plain_csv,
)

VOCABULARY = 1000


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")
    )


def _tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(_documents(spark, sf_dir))


def _written(
    spark: SparkSession, lines: DataFrame, kind: str, header: str | None = None
) -> str:
    """Lines as text files in a new folder, each file led by the header when there is one."""
    if header is not None:
        # A file is a partition; its first row has position 0 in the low 33 bits.
        first = F.monotonically_increasing_id() % (1 << 33) == 0
        led = F.concat(F.lit(header + "\n"), "value")
        lines = lines.select(F.when(first, led).otherwise(F.col("value")).alias("value"))
    path = f"{shared_dir(spark)}/corpus-{kind}-{uuid.uuid4().hex}"
    lines.write.option("compression", "none").text(path)
    return path


# --- sources: documents written in each format and read back -------------------------------


@query(
    "corpus_csv",
    f"""
SELECT label, md5(text) AS text FROM (
  SELECT trim(lang) AS label, trim(text, {WS_CHARS_SQL}) AS text FROM documents
  WHERE doc_id % 10 NOT IN (3, 4)
) WHERE text <> ''""",
)
def corpus_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted titles with commas, quotes and line breaks; short and blank rows among them."""
    key = F.col("doc_id")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = table(spark, sf_dir, "documents").select(
        F.when(key % 10 == 3, F.col("lang"))
        .when(key % 10 == 4, F.concat(F.col("lang"), F.lit(",  ")))
        .when(key % 10 == 5, F.concat(F.lit(" "), "lang", F.lit(","), quoted, F.lit(",extra")))
        .otherwise(F.concat("lang", F.lit(","), quoted))
        .alias("value")
    )
    path = _written(spark, lines, "csv", "Category,Title")
    rows = read_labelled_csv(spark, path)
    return rows.select("label", F.md5("text").alias("text"))


_LINE = "regexp_replace(regexp_replace(text, '[\\n\\r]', ' ', 'g'), '_!_', ' ', 'g')"


def _one_line(separator: str):
    flat = F.regexp_replace("text", "[\\n\\r]", " ")
    return F.replace(flat, F.lit(separator), F.lit(" "))


@query(
    "corpus_delim",
    f"""
SELECT lang AS label, md5({_LINE}) AS text FROM documents WHERE doc_id % 10 <> 3""",
)
def corpus_delim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus_rows(read_delimited(spark, _delimited_path(spark, sf_dir)))
    return rows.select("label", F.md5("text").alias("text"))


def _delimited_path(spark: SparkSession, sf_dir: str) -> str:
    key = F.col("doc_id").cast("string")
    lines = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 10 == 3, F.concat_ws("_!_", key, F.lit("short")))
        .otherwise(F.concat_ws("_!_", key, F.lit("101"), "lang", _one_line("_!_"), F.lit("more")))
        .alias("value")
    )
    return _written(spark, lines, "delimited")


@query(
    "corpus_rejects",
    "SELECT count(*) FILTER (WHERE doc_id % 10 = 3) AS rejected, count(*) AS lines FROM documents",
)
def corpus_rejects_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_rejects(read_delimited(spark, _delimited_path(spark, sf_dir)))


@query(
    "corpus_plain",
    """
SELECT lang AS label, md5(replace(regexp_replace(text, '[\\n\\r]', ' ', 'g'), ',', ' ')) AS text
FROM documents WHERE doc_id % 10 <> 3""",
)
def corpus_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    lines = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 10 == 3, F.concat_ws(",", key, F.lit("short")))
        .otherwise(F.concat_ws(",", key, _one_line(","), "lang"))
        .alias("value")
    )
    path = _written(spark, lines, "plain", "ArticleId,Text,Category")
    rows = corpus_rows(read_plain_csv(spark, path))
    return rows.select("label", F.md5("text").alias("text"))


# --- vocabulary, labels, lengths ------------------------------------------------------------

SQL_TOKENS = """
tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'),
                             lambda w: w <> '') AS words
  FROM documents
),
freq AS (
  SELECT token, count(*) AS cnt FROM (SELECT unnest(words) AS token FROM tokens) GROUP BY token
)"""
SQL_VOCAB = f"""{SQL_TOKENS},
vocab AS (
  SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) + 1 AS id
  FROM freq ORDER BY cnt DESC, token LIMIT {VOCABULARY - 2}
)"""


@query("token_freq", f"WITH {SQL_TOKENS} SELECT token, cnt FROM freq")
def token_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frequency(_tokenised(spark, sf_dir))


@query("vocab_top_k", f"WITH {SQL_VOCAB} SELECT token, cnt, id FROM vocab")
def vocab_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(token_frequency(_tokenised(spark, sf_dir)), VOCABULARY)


@query(
    "seq_len",
    f"WITH {SQL_TOKENS} SELECT least(max(greatest(len(words), 1)), 50) AS seq_len FROM tokens",
)
def seq_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_length(_tokenised(spark, sf_dir))


@query(
    "label_index",
    """
SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx
FROM (SELECT DISTINCT lang AS label FROM documents)""",
)
def label_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_index(_documents(spark, sf_dir))


@query("distinct_labels", "SELECT DISTINCT lang AS label, source FROM documents")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), "source").distinct()


@query("row_guard", "SELECT doc_id AS id, lang AS label FROM documents")
def row_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("id", "label")
    return require_rows(rows, 2, "Dataset must have at least 2 samples.")


# --- splits, encoding, metrics ----------------------------------------------------------------


@query(
    "split_80_20",
    """
SELECT event_id,
       CASE WHEN row_number() OVER (ORDER BY md5('42:' || event_id), event_id)
                 <= count(*) OVER () - floor(count(*) OVER () * 0.2::DOUBLE)
            THEN 'train' ELSE 'valid' END AS split
FROM events""",
)
def split_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id")
    return split_exact(rows, 42, "event_id")


_SQL_ENCODED = f"""WITH {SQL_VOCAB},
words AS (
  SELECT doc_id, unnest(words[1:50]) AS token, generate_subscripts(words[1:50], 1) AS pos
  FROM tokens
),
ids AS (
  SELECT doc_id, list(coalesce(vocab.id, 1) ORDER BY pos) AS ids
  FROM words LEFT JOIN vocab USING (token) GROUP BY doc_id
)
SELECT doc_id AS id, array_to_string(list_resize(coalesce(ids, [1]), 50, 0), ' ') AS ids
FROM documents LEFT JOIN ids USING (doc_id)"""


@query("encode_pad", _SQL_ENCODED)
def encode_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenised = _tokenised(spark, sf_dir)
    words = vocabulary_words(vocabulary(token_frequency(tokenised), VOCABULARY))
    rows = encode(tokenised, words, 50)
    return rows.select("id", F.array_join("ids", " ").alias("ids"))


@query("encode_pad_join", _SQL_ENCODED)
def encode_pad_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ids from the join that serves vocabularies of any size."""
    tokenised = _tokenised(spark, sf_dir)
    rows = encode_by_join(tokenised, vocabulary(token_frequency(tokenised), VOCABULARY), 50)
    return rows.select("id", F.array_join("ids", " ").alias("ids"))


@query(
    "eval_metrics",
    """
SELECT round(avg(-ln(0.1 + (doc_id % 7) / 10.0::DOUBLE)), 9) AS loss,
       round(avg(CASE WHEN doc_id % 4 = doc_id % 3 THEN 1 ELSE 0 END), 9) AS accuracy,
       count(*) AS n
FROM documents""",
)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    scored = table(spark, sf_dir, "documents").select(
        (key % 4).alias("label_idx"),
        (key % 3).alias("predicted_idx"),
        (F.lit(0.1) + (key % 7) / F.lit(10.0)).alias("probability"),
    )
    result = evaluation(scored)
    return result.select(F.round("loss", 9).alias("loss"), F.round("accuracy", 9).alias("accuracy"), "n")
