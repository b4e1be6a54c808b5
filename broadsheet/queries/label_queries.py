"""Language, tokens and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.fixed import CATEGORIES, CATEGORY_ALL, CATEGORY_BITS, CATEGORY_LABELS
from broadsheet.functions.categories import flags_to_chinese, flags_to_text, text_to_flags
from broadsheet.functions.text import (
    detect_language,
    han_count,
    han_ratio,
    han_tokens,
    han_words,
    latin_count,
    latin_tokens,
    short_hash,
)
from broadsheet.functions.timefmt import from_utc_iso, utc_iso
from broadsheet.operators.classify import label_rows
from broadsheet.operators.lexicon import learn_lexicon, lexicon_scores
from broadsheet.queries.common import instant, query, table

HAN = "[一-鿿]"

# Documents with part of their letters turned into Han characters: none, the first tenth, half
# or all of the text; every 19th has digits only and every 23rd is blank. Texts stay whole.
_CUT = "CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN len(text) // 10 WHEN 2 THEN len(text) // 2 ELSE len(text) END"
SQL_MIXED = f"""
mixed AS (
  SELECT doc_id, lang,
         CASE WHEN doc_id % 23 = 7 THEN e' \\n' WHEN doc_id % 19 = 3 THEN '12 345' ELSE
              translate(left(text, {_CUT}), 'etaoinsrhld', '中文新闻体育财经军事国')
              || substr(text, {_CUT} + 1) END AS text
  FROM documents
)"""


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, size = F.col("doc_id") % 4, F.length("text")
    cut = (
        F.when(kind == 0, 0)
        .when(kind == 1, F.floor(size / 10))
        .when(kind == 2, F.floor(size / 2))
        .otherwise(size)
        .cast("int")
    )
    head = F.substring("text", F.lit(1), cut)
    swapped = F.translate(head, "etaoinsrhld", "中文新闻体育财经军事国")
    text = (
        F.when(F.col("doc_id") % 23 == 7, " \n")
        .when(F.col("doc_id") % 19 == 3, "12 345")
        .otherwise(F.concat(swapped, F.substr("text", cut + 1)))
    )
    return table(spark, sf_dir, "documents").select("doc_id", "lang", text.alias("text"))


SQL_COUNTED = f"""{SQL_MIXED},
counted AS (
  SELECT doc_id, text, len(regexp_extract_all(text, '{HAN}')) AS han,
         len(regexp_extract_all(text, '[A-Za-z]')) AS latin
  FROM mixed
)"""


def sql_language(threshold: float) -> str:
    return f"""CASE WHEN han + latin = 0 THEN 'Unknown' WHEN latin = 0 THEN 'Chinese'
            WHEN han = 0 THEN 'English'
            WHEN han / (han + latin)::DOUBLE > {threshold} THEN 'Chinese' ELSE 'English' END"""


@query(
    "lang_detect",
    f"""WITH {SQL_COUNTED}
SELECT doc_id, {sql_language(0.5)} AS language, {sql_language(0.2)} AS language_low,
       {sql_language(1.0)} AS language_high
FROM counted""",
)
def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return mixed_documents(spark, sf_dir).select(
        "doc_id",
        detect_language(text).alias("language"),
        detect_language(text, 0.2).alias("language_low"),
        detect_language(text, 1.0).alias("language_high"),
    )


@query(
    "han_latin_counts",
    f"""WITH {SQL_COUNTED}
SELECT doc_id, han, latin,
       CASE WHEN han + latin > 0 THEN round(han / (han + latin)::DOUBLE, 9) END AS ratio
FROM counted""",
)
def han_latin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return mixed_documents(spark, sf_dir).select(
        "doc_id",
        han_count(text).alias("han"),
        latin_count(text).alias("latin"),
        F.round(han_ratio(text), 9).alias("ratio"),
    )


@query(
    "latin_tokens",
    f"""WITH {SQL_MIXED},
t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'),
                                 lambda w: w <> '') AS words FROM mixed)
SELECT doc_id, greatest(len(words), 1) AS n,
       md5(CASE WHEN len(words) = 0 THEN '<UNK>' ELSE array_to_string(words, ' ') END) AS tokens
FROM t""",
)
def latin_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed_documents(spark, sf_dir).withColumn("words", latin_tokens(F.col("text")))
    joined = F.md5(F.array_join("words", " "))
    return rows.select("doc_id", F.size("words").alias("n"), joined.alias("tokens"))


@query(
    "han_tokens",
    f"""WITH {SQL_MIXED},
t AS (
  SELECT doc_id, flatten(list_transform(
           regexp_extract_all(lower(text), '{HAN}+|[a-z0-9]+'),
           lambda run: CASE WHEN regexp_matches(run, '^{HAN}') AND len(run) > 1
             THEN list_transform(range(1, len(run)), lambda i: substr(run, i, 2))
             ELSE [run] END)) AS words
  FROM mixed
)
SELECT doc_id, greatest(len(words), 1) AS n,
       md5(CASE WHEN len(words) = 0 THEN '<UNK>' ELSE array_to_string(words, ' ') END) AS tokens
FROM t""",
)
def han_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed_documents(spark, sf_dir).withColumn("words", han_tokens(F.col("text")))
    joined = F.md5(F.array_join("words", " "))
    return rows.select("doc_id", F.size("words").alias("n"), joined.alias("tokens"))


_SQL_LEXICON = f"""{SQL_MIXED},
runs AS (
  SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{HAN}{{1,256}}')) AS run FROM mixed) GROUP BY run
),
spans AS (
  SELECT n, substr(run, pos, size) AS gram, CASE WHEN pos > 1 THEN substr(run, pos - 1, 1) ELSE '' END AS l,
         substr(run, pos + size, 1) AS r
  FROM runs, unnest(range(1, len(run) + 1)) AS p(pos), unnest(range(1, 5)) AS s(size) WHERE pos + size - 1 <= len(run)
),
lefts AS (SELECT gram, l, sum(n)::DOUBLE AS n FROM spans GROUP BY gram, l),
rights AS (SELECT gram, r, sum(n)::DOUBLE AS n FROM spans GROUP BY gram, r),
stats AS (
  SELECT gram, cnt, hl, hr FROM (SELECT gram, sum(n) AS cnt, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hl FROM lefts GROUP BY gram)
  JOIN (SELECT gram, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hr FROM rights GROUP BY gram) USING (gram)
),
total AS (SELECT sum(cnt) AS total FROM stats WHERE len(gram) = 1),
firm AS (
  SELECT f.gram, f.cnt
  FROM stats f, unnest(range(1, len(f.gram))) AS c(pos), total
  JOIN stats a ON a.gram = substr(f.gram, 1, pos) JOIN stats b ON b.gram = substr(f.gram, pos + 1)
  WHERE f.cnt >= 5 AND least(f.hl, f.hr) >= 0.7
  GROUP BY f.gram, f.cnt HAVING min(ln(f.cnt * total / (a.cnt * b.cnt))) >= 1.0
),
lexicon AS (
  SELECT gram AS word, cnt::BIGINT AS cnt, round(1000 * ln(cnt / total))::INT AS score
  FROM (SELECT * FROM firm UNION ALL SELECT gram, cnt FROM stats WHERE len(gram) = 1), total
)"""


@query("han_lexicon", f"WITH {_SQL_LEXICON} SELECT word, cnt, score FROM lexicon")
def han_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words learned from all texts."""
    return learn_lexicon(mixed_documents(spark, sf_dir))


@query(
    "han_words",
    f"""WITH RECURSIVE {_SQL_LEXICON},
floor AS (SELECT min(score) - 1000 AS floor FROM lexicon),
walk(run, i, best) AS (
  SELECT run, 0, [{{'sum': 0::BIGINT, 'n': 0}}] FROM runs
  UNION ALL
  SELECT run, i + 1, list_append(best, list_max(list_filter([
      {{'sum': best[i + 1].sum + coalesce(a.score, floor), 'n': 1}}, {{'sum': best[i].sum + b.score, 'n': 2}},
      {{'sum': best[i - 1].sum + c.score, 'n': 3}}, {{'sum': best[i - 2].sum + d.score, 'n': 4}}
    ], lambda way: way.sum IS NOT NULL)))
  FROM walk CROSS JOIN floor LEFT JOIN lexicon a ON a.word = run[i + 1]
  LEFT JOIN lexicon b ON i >= 1 AND b.word = run[i:i + 1] LEFT JOIN lexicon c ON i >= 2 AND c.word = run[i - 1:i + 1]
  LEFT JOIN lexicon d ON i >= 3 AND d.word = run[i - 2:i + 1]
  WHERE i < len(run)
),
back(run, best, i, words) AS (
  SELECT run, best, i, []::VARCHAR[] FROM walk WHERE i = len(run)
  UNION ALL
  SELECT run, best, i - best[i + 1].n, list_prepend(run[i - best[i + 1].n + 1:i], words) FROM back WHERE i > 0
),
segmented AS (SELECT run, words FROM back WHERE i = 0),
pieces AS (
  SELECT doc_id, unnest(found) AS piece, generate_subscripts(found, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{HAN}{{1,256}}|[a-z0-9]+') AS found FROM mixed)
),
joined AS (
  SELECT doc_id, sum(len(coalesce(words, [piece]))) AS n,
         string_agg(array_to_string(coalesce(words, [piece]), ' '), ' ' ORDER BY i) AS words
  FROM pieces LEFT JOIN segmented ON run = piece GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 1)::INT AS n, md5(coalesce(words, '<UNK>')) AS tokens FROM mixed LEFT JOIN joined USING (doc_id)""",
)
def han_words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts read as words of the lexicon that they teach."""
    rows = mixed_documents(spark, sf_dir)
    lexicon = lexicon_scores(learn_lexicon(rows))
    found = rows.withColumn("words", han_words(F.col("text"), lexicon))
    return found.select("doc_id", F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("tokens"))


@query("short_hash", "SELECT doc_id, upper(left(sha256(text), 12)) AS hash FROM documents")
def short_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", short_hash(F.col("text")).alias("hash")
    )


# Part rows carry one of the raw labels each, in mixed case, or an unknown one.
_LABELS = [raw for raw, _ in CATEGORY_LABELS]
_SQL_FLAG = " ".join(
    f"WHEN {i} THEN {CATEGORY_BITS[name]}" for i, (_, name) in enumerate(CATEGORY_LABELS)
)
_SQL_LABELS = f"[{', '.join(f'{chr(39)}{raw}{chr(39)}' for raw in _LABELS)}, 'weather']"


def _labelled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = len(_LABELS) + 1
    names = F.array(*map(F.lit, [*_LABELS, "weather"]))
    label = F.get(names, (F.col("p_partkey") % kinds).cast("int"))
    shown = F.when(F.col("p_partkey") % 2 == 0, F.upper(label)).otherwise(label)
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", shown.alias("label"))


@query(
    "label_to_flag",
    f"""
SELECT p_partkey,
       CASE WHEN p_partkey % 2 = 0 THEN upper({_SQL_LABELS}[p_partkey % 22 + 1])
            ELSE {_SQL_LABELS}[p_partkey % 22 + 1] END AS label,
       CASE p_partkey % 22 {_SQL_FLAG} ELSE -1 END AS category,
       p_partkey % 22 = 21 AS rejected
FROM part""",
)
def label_to_flag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_rows(_labelled_parts(spark, sf_dir))
    return rows.select(
        "p_partkey",
        "label",
        F.coalesce("category", F.lit(-1)).alias("category"),
        F.col("category").isNull().alias("rejected"),
    )


# One mask per brand and size: the labels of its parts that are known.
_SQL_MASKS = f"""
masks AS (
  SELECT p_brand, p_size, coalesce(bit_or(CASE p_partkey % 22 {_SQL_FLAG} END), 0) AS mask
  FROM part GROUP BY p_brand, p_size
),
varied AS (
  SELECT p_brand, p_size, CASE WHEN p_size % 17 = 0 THEN 0 WHEN p_size % 17 = 1 THEN {CATEGORY_ALL}
         WHEN p_size % 17 = 2 THEN mask + 524288 ELSE mask END AS mask
  FROM masks
)"""


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_rows(_labelled_parts(spark, sf_dir))
    return rows.groupBy("p_brand", "p_size").agg(
        F.coalesce(F.bit_or("category"), F.lit(0)).alias("mask")
    )


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, mask = F.col("p_size") % 17, F.col("mask")
    return _masks(spark, sf_dir).withColumn(
        "mask",
        F.when(kind == 0, 0)
        .when(kind == 1, CATEGORY_ALL)
        .when(kind == 2, mask + 524288)
        .otherwise(mask),
    )


def _sql_names(column: str, names: list[str], separator: str) -> str:
    items = ", ".join(
        f"CASE WHEN {column} & {1 << bit} <> 0 THEN '{name}' END" for bit, name in enumerate(names)
    )
    return f"concat_ws('{separator}', {items})"


@query("flags_bit_or", f"WITH {_SQL_MASKS} SELECT p_brand, p_size, mask FROM masks")
def flags_bit_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(spark, sf_dir)


_NAMES = [name for name, _ in CATEGORIES]
_CHINESE = [zh for _, zh in CATEGORIES]


@query(
    "flags_to_text",
    f"""WITH {_SQL_MASKS}
SELECT p_brand, p_size,
       CASE WHEN mask = 0 THEN 'None' WHEN mask = {CATEGORY_ALL} THEN 'All'
            WHEN mask > {CATEGORY_ALL} THEN mask::VARCHAR
            ELSE {_sql_names("mask", _NAMES, ", ")} END AS names
FROM varied""",
)
def flags_to_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir).select(
        "p_brand", "p_size", flags_to_text(F.col("mask")).alias("names")
    )


@query(
    "flags_zh",
    f"""WITH {_SQL_MASKS}
SELECT p_brand, p_size,
       CASE WHEN mask = 0 THEN '未分类' WHEN mask = {CATEGORY_ALL} THEN '全部'
            WHEN {_sql_names("mask", _CHINESE, "、")} = '' THEN '未分类'
            ELSE {_sql_names("mask", _CHINESE, "、")} END AS names
FROM varied""",
)
def flags_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(spark, sf_dir).select(
        "p_brand", "p_size", flags_to_chinese(F.col("mask")).alias("names")
    )


@query(
    "text_to_flags",
    f"""WITH {_SQL_MASKS}
SELECT p_brand, p_size, CASE WHEN p_size % 17 = 3 THEN 0 ELSE mask END AS mask FROM varied""",
)
def text_to_flags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from text in ragged case and spacing; one unknown name spoils the whole list."""
    text = flags_to_text(F.col("mask"))
    kind = F.col("p_size") % 17
    ragged = (
        F.when(kind == 3, F.concat(text, F.lit(", Weather")))
        .when(kind == 4, F.upper(F.replace(text, F.lit(", "), F.lit(" ,\t"))))
        .when(kind == 5, F.concat(F.lit(" "), F.lower(text), F.lit("\n")))
        .otherwise(text)
    )
    return _varied(spark, sf_dir).select(
        "p_brand", "p_size", text_to_flags(ragged).alias("mask")
    )


@query(
    "iso_utc",
    """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' AS iso,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS back
FROM events""",
)
def iso_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", utc_iso(instant("ts")).alias("iso"))
    return rows.withColumn(
        "back", F.date_format(from_utc_iso(F.col("iso")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
