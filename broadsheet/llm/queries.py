"""One query per operator over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.llm import bpe, cells, curves, language, licences, mixing, simhash, substrings
from broadsheet.llm import quality, repair, tokenfiles, warc, whitening
from broadsheet.llm.common import importable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: shingles of 3 words, 2 differing bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@_query()
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices."""
    return licences.licence_scan(_table(spark, sf_dir, "documents")).drop("spans")


_SQL_OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN counted USING (vec_id) LEFT JOIN least USING (vec_id)
"""


@_query(_SQL_OP3)
def op3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding near-duplicates at cosine 0.9."""
    return cells.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


@_query()
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


_SQL_OP5 = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
),
g AS (
  SELECT doc_id, i, count(*) OVER ahead AS n, string_agg(word, ' ') OVER ahead AS win
  FROM w WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
),
f AS (SELECT md5(win) AS h, min(doc_id) AS first FROM g WHERE n = 13 GROUP BY h),
bad AS (SELECT g.doc_id, g.i FROM g JOIN f ON md5(g.win) = f.h WHERE g.n = 13 AND f.first < g.doc_id),
marked AS (
  SELECT w.doc_id, w.i, w.word, count(b.i) OVER (PARTITION BY w.doc_id ORDER BY w.i
         ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM w LEFT JOIN bad b ON b.doc_id = w.doc_id AND b.i = w.i
),
done AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""


@_query(_SQL_OP5)
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 13 words that an earlier document has."""
    found = substrings.repeated(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SQL_OP6 = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
),
d AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS kept,
         array_to_string(list_transform(range(32), lambda k: substr('{_BASE32}',
           ((('0x' || substr(h, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '')
           AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM d
"""


@_query(_SQL_OP6)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back."""
    files = warc.write_archives(_table(spark, sf_dir, "pages"), warc.archive_folder(spark), min_bytes=0)
    chunks = warc.read_archives(files).filter("last")
    return chunks.select(
        "page_id",
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


_SQL_OP7 = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source
),
caps AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, row_number() OVER fills AS nth,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (fills ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (fills ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps WINDOW fills AS (ORDER BY cap / weight, source NULLS LAST)
),
goals AS (
  SELECT source, source_size, least(cap, coalesce(
    (SELECT level FROM levels WHERE level * weight <= cap ORDER BY nth LIMIT 1) * weight, cap)) AS target
  FROM levels
),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN g.source_size > 0 THEN floor(g.target)::BIGINT // g.source_size ELSE 0 END AS passes
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (passes * size + greatest(0, least(size, floor(target)::BIGINT - passes * source_size - before)))::BIGINT AS taken
FROM placed
"""


@_query(_SQL_OP7)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1 and 150% of all words."""
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


@_query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded by merge ranks and decoded."""
    done = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_SQL_OP9 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@_query(_SQL_OP9)
def op9_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every vector whose id is divisible by 20."""
    return curves.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@_query()
def op10_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in range-coded files, read back."""
    files = tokenfiles.write_token_files(
        _table(spark, sf_dir, "documents"), tokenfiles.token_folder(spark),
        public_tokenizers.path("byte_bpe_50k.json"), end_id=0,
    )
    read = tokenfiles.read_token_files(files)
    return read.select(
        "doc_id",
        F.col("start"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


_CRC_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_SQL_OP11 = rf"""
WITH RECURSIVE keyed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({_CRC_KEY}, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_resize([]::BIGINT[], 8, 0)),
      lambda c, bit: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) % 20 AS kind
  FROM conversations
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role[1] AS initial,
         rtrim(text, E' \t\n\x0B\x0C\r') AS body
  FROM damaged
),
judged AS (
  SELECT *, body = '' AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(body, 1) NOT IN ('.', '!', '?') AS cut,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
),
turns AS (SELECT conv_id, i, role, text, initial, blank OR again AS doomed, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM judged),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
         count(*) FILTER (illegal) AS illegal
  FROM judged GROUP BY conv_id
),
-- The least (cost, audit) of each state before turn i, insertions included.
walk(conv_id, i, w0, w1, w2, w3) AS (
  SELECT conv_id, 1::BIGINT, {{'c': 0::BIGINT, 'a': ''}}, {{'c': 99999999::BIGINT, 'a': ''}}, {{'c': 3::BIGINT, 'a': 'I'}}, {{'c': 6::BIGINT, 'a': 'II'}}
  FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, i, n0, n1, u, list_min([n3, {{'c': u.c + 3, 'a': u.a || 'I'}}]) FROM (
    SELECT *, list_min([n2, {{'c': n0.c + 3, 'a': n0.a || 'I'}}, {{'c': n1.c + 3, 'a': n1.a || 'I'}}, {{'c': n3.c + 3, 'a': n3.a || 'I'}}]) AS u FROM (
      SELECT w.conv_id, w.i + 1 AS i, {{'c': w0.c + 4, 'a': w0.a || 'D'}} AS n0,
        list_min([{{'c': w1.c + 4, 'a': w1.a || 'D'}}] || CASE WHEN NOT doomed AND initial = 's' THEN [{{'c': w0.c + more, 'a': w0.a || 'K'}}] ELSE [] END) AS n1,
        list_min([{{'c': w2.c + 4, 'a': w2.a || 'D'}}]
          || CASE WHEN NOT doomed THEN [{{'c': w0.c + more + 3, 'a': w0.a || 'R'}}, {{'c': w1.c + more + 3, 'a': w1.a || 'R'}}, {{'c': w3.c + more + 3, 'a': w3.a || 'R'}}] ELSE [] END
          || CASE WHEN NOT doomed AND initial = 'u' THEN [{{'c': w0.c + more, 'a': w0.a || 'K'}}, {{'c': w1.c + more, 'a': w1.a || 'K'}}, {{'c': w3.c + more, 'a': w3.a || 'K'}}] ELSE [] END) AS n2,
        list_min([{{'c': w3.c + 4, 'a': w3.a || 'D'}}]
          || CASE WHEN NOT doomed THEN [{{'c': w2.c + more + 3, 'a': w2.a || 'R'}}] ELSE [] END
          || CASE WHEN NOT doomed AND initial = 'a' THEN [{{'c': w2.c + more, 'a': w2.a || 'K'}}] ELSE [] END) AS n3
      FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i
    )
  )
),
best AS (
  SELECT conv_id, list_min([w0, w3]).c AS cost, list_min([w0, w3]).a AS audit FROM walk
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
),
letters AS (
  SELECT conv_id, j, audit[j] AS letter, len(replace(audit[1:j], 'I', '')) AS i, len(replace(audit[1:j], 'D', '')) AS k
  FROM best, unnest(range(1, len(audit) + 1)) AS places(j) WHERE audit[j] <> 'D'
),
kept AS (
  SELECT l.*, t.role, t.text, max(CASE WHEN k = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM letters l LEFT JOIN turns t ON letter <> 'I' AND t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i
),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body FROM kept GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@_query(_SQL_OP11)
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired at least cost."""
    conversations = _table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(conversations), conversations)


_CLOSE = quality.CLOSERS.replace("]", r"\]").replace("'", "''")
_NOTICES = "|".join([n.replace("(", "[(]").replace(")", "[)]") for n in quality.NOTICES] + ["^" + n.replace("(", "[(]").replace(")", "[)]") for n in quality.NOTICE_STARTS])
_SQL_OP12 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS d FROM documents),
lines AS (
  SELECT d, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM docs
),
judged AS (
  SELECT *, len(regexp_extract_all(line, '{quality.WORD}')) AS own,
         translate(trim(line, E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS p
  FROM lines
),
failed AS (
  SELECT *, row_number() OVER (PARTITION BY d, line ORDER BY i) > 1 AS again,
    NOT regexp_matches(p, '[{quality.SENTENCE_ENDS}][{_CLOSE}]*$') OR regexp_matches(p, '{quality.MARKED}')
    OR regexp_matches(p, '^[^{quality.DIVIDERS}]*[^ {quality.DIVIDERS}][^{quality.DIVIDERS}]*([{quality.DIVIDERS}][^{quality.DIVIDERS}]*[^ {quality.DIVIDERS}][^{quality.DIVIDERS}]*){{{quality.DIVIDED},}}$')
    OR regexp_full_match(rtrim(p, '{quality.FRAME_TAIL}'), '{quality.FRAME}') OR regexp_matches(p, '{_NOTICES}') AS fault
  FROM judged WHERE own > 0
),
by_line AS (
  SELECT d, sum(own) AS n_words, count(*) FILTER (again) AS dups, coalesce(sum(own) FILTER (fault), 0) AS lost FROM failed GROUP BY d
),
w AS (SELECT d, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT d, regexp_extract_all(t, '{quality.WORD}') AS ws FROM docs)),
windows AS (
  SELECT d, i, md5(string_agg(word, ' ') OVER ahead) AS win, count(*) OVER ahead AS n
  FROM w WINDOW ahead AS (PARTITION BY d ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
),
twice AS (SELECT d, i, n = 3 AND count(*) FILTER (n = 3) OVER (PARTITION BY d, win) > 1 AS twice FROM windows),
covered AS (SELECT d, bool_or(twice) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM twice),
repeats AS (SELECT d, count(*) FILTER (covered) AS n FROM covered GROUP BY d),
counts AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, length(regexp_replace(t, '[ 	-
]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM docs LEFT JOIN by_line USING (d) LEFT JOIN repeats USING (d)
),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT * EXCLUDE (lost), NOT base_failed AND 100 * lost <= {quality.MOST_LOST_PERCENT} * n_words AS kept FROM based
"""


@_query(_SQL_OP12)
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of every whole text."""
    found = quality.quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    # The operator's sum has 38 digits; one that a long cannot hold is null here.
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
