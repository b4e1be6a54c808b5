"""The archive: writing, reading, selecting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from broadsheet.functions.timefmt import utc_iso
from broadsheet.operators.selection import (
    latest,
    random_batch_per_reader,
    random_batch_unseen,
    random_one_unseen,
    unseen,
)
from broadsheet.plans.reader import extend_history, next_batch, spoken
from broadsheet.queries.article_queries import NOW
from broadsheet.queries.common import instant, query, table
from broadsheet.session import shared_dir
from broadsheet.sources.archive import (
    append_archive,
    export_texts,
    read_archive,
    truncate_archive,
    with_text_forms,
)

# Events as archive rows: every 11th has no publish time.
SQL_ARCHIVE = """
archive AS (
  SELECT event_id AS id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS t
  FROM events
)"""
_SHOW_TIME = "strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS publish_time"


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = F.when(F.col("event_id") % 11 != 0, instant("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", published.alias("publish_time")
    )


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id",
        F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("publish_time"),
    )


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reader's past: the events of user 7, each listed twice."""
    seen = _archive(spark, sf_dir).filter("user_id = 7").select("id")
    return seen.unionByName(seen)


@query(
    "latest_n",
    f"""WITH {SQL_ARCHIVE}
SELECT id, {_SHOW_TIME} FROM archive ORDER BY t DESC NULLS LAST, id LIMIT 20""",
)
def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(latest(_archive(spark, sf_dir)))


@query(
    "history_anti",
    f"""WITH {SQL_ARCHIVE}
SELECT id, {_SHOW_TIME} FROM archive WHERE id NOT IN (SELECT id FROM archive WHERE user_id = 7)""",
)
def history_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(unseen(_archive(spark, sf_dir), _history(spark, sf_dir)))


@query(
    "random_one_unseen",
    f"""WITH {SQL_ARCHIVE}
SELECT id, {_SHOW_TIME} FROM archive
WHERE user_id <> 7 AND (SELECT count(*) FROM archive) > 1
ORDER BY md5('42:' || id), id LIMIT 1""",
)
def random_one_unseen_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(random_one_unseen(_archive(spark, sf_dir), _history(spark, sf_dir), 42))


_SQL_CANDIDATES = f"""{SQL_ARCHIVE},
candidates AS (
  SELECT * FROM archive WHERE user_id <> 7 AND t <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY
)"""


@query(
    "random_batch_unseen",
    f"""WITH {_SQL_CANDIDATES}
SELECT id, {_SHOW_TIME} FROM candidates WHERE (SELECT count(*) FROM candidates) >= 10
ORDER BY md5('42:' || id), id LIMIT 10""",
)
def random_batch_unseen_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return _shown(random_batch_unseen(_archive(spark, sf_dir), _history(spark, sf_dir), now, 42))


@query(
    "random_batch_too_few",
    f"""WITH {_SQL_CANDIDATES}
SELECT asked, count(id) AS n FROM (VALUES (10), (10000000)) AS asked(asked)
LEFT JOIN (SELECT id, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS all_rows FROM candidates)
  ON k <= asked AND all_rows >= asked
GROUP BY asked""",
)
def random_batch_too_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows are there; of more rows than there are nothing comes back."""
    now = F.lit(NOW).cast("timestamp")
    archive, history = _archive(spark, sf_dir), _history(spark, sf_dir)
    counts = [
        random_batch_unseen(archive, history, now, 42, n=asked)
        .agg(F.count("*").alias("n")).select(F.lit(asked).alias("asked"), "n")
        for asked in (10, 10_000_000)
    ]
    return counts[0].unionByName(counts[1])


@query(
    "random_batch_per_reader",
    f"""WITH {SQL_ARCHIVE},
readers AS (SELECT DISTINCT user_id AS reader FROM archive),
candidates AS (
  SELECT reader, id, row_number() OVER (PARTITION BY reader ORDER BY md5('42:' || id), id) AS rn,
         count(*) OVER (PARTITION BY reader) AS n
  FROM readers JOIN archive ON user_id <> reader AND t <= TIMESTAMP '{NOW}' - INTERVAL 7 DAY
)
SELECT reader, rn AS pick, id FROM candidates WHERE rn <= 10 AND n >= 10""",
)
def random_batch_per_reader_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's own past is their history."""
    archive = _archive(spark, sf_dir)
    history = archive.select(F.col("user_id").alias("reader"), "id")
    now = F.lit(NOW).cast("timestamp")
    return random_batch_per_reader(archive, history, now, 42).select("reader", "pick", "id")


@query(
    "history_union",
    f"""WITH {SQL_ARCHIVE},
last AS (SELECT id FROM archive ORDER BY t DESC NULLS LAST, id LIMIT 10),
candidates AS (
  SELECT id FROM archive
  WHERE id NOT IN (SELECT id FROM last) AND t <= TIMESTAMP '{NOW}' - INTERVAL 3 DAY
),
batch AS (
  SELECT id FROM candidates WHERE (SELECT count(*) FROM candidates) >= 5
  ORDER BY md5('7:' || id), id LIMIT 5
)
SELECT id FROM last UNION ALL SELECT id FROM batch""",
)
def history_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening ten and the batch that follows them."""
    archive = _archive(spark, sf_dir)
    history = latest(archive, 10)
    batch = next_batch(archive, history, F.lit(NOW).cast("timestamp"), 7)
    return extend_history(history, batch).select("id")


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _documents_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    return table(spark, sf_dir, "documents").join(events, "doc_id", "left").select(
        F.xxhash64("source", "doc_id").alias("id"),
        F.concat("source", F.lit(" #"), key.cast("string")).alias("title"),
        F.concat(F.lit("https://example.org/d/"), key.cast("string")).alias("url"),
        F.col("n_chars").alias("text_length"),
        (key % 3).alias("image_count"),
        F.when(key % 11 != 0, instant("ts")).alias("publish_time"),
        F.when(key % 4 != 0, F.col("source")).alias("publisher"),
        F.col("text").alias("content"),
        (key % 4).cast("int").alias("category"),
    )


_SQL_ROWS = """
SELECT source || ' #' || doc_id AS title, 'https://example.org/d/' || doc_id AS url,
       n_chars AS text_length, doc_id % 3 AS image_count,
       CASE WHEN doc_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' END
         AS publish_time,
       CASE WHEN doc_id % 4 <> 0 THEN source END AS publisher, md5(text) AS content,
       ['None', 'Edu', 'Entertainment', 'Edu, Entertainment'][doc_id % 4 + 1] AS category
FROM documents LEFT JOIN events ON doc_id = event_id"""


@query("archive_append", _SQL_ROWS)
def archive_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends into a cleared table, read back in the portable form."""
    path = _new_folder(spark, "archive")
    rows = _documents_as_rows(spark, sf_dir)
    append_archive(rows, path)
    truncate_archive(spark, path)
    append_archive(rows.filter(F.col("image_count") < 2), path)
    append_archive(rows.filter(F.col("image_count") >= 2), path)
    stored = with_text_forms(read_archive(spark, path))
    return stored.select(
        "title",
        "url",
        "text_length",
        "image_count",
        "publish_time",
        "publisher",
        F.md5("content").alias("content"),
        "category",
    )


@query(
    "archive_latest_stored",
    f"""WITH rows AS ({_SQL_ROWS})
SELECT url, publish_time FROM rows
ORDER BY publish_time DESC NULLS LAST, url LIMIT 15""",
)
def archive_latest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rows of the stored table: narrow columns first, then only the picked days."""
    path = _new_folder(spark, "archive")
    append_archive(_documents_as_rows(spark, sf_dir), path)
    rows = latest(read_archive(spark, path), 15)
    return rows.select("url", utc_iso(F.col("publish_time")).alias("publish_time"))


def _stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the stored archive; the id is that of the event."""
    path = _new_folder(spark, "archive")
    key = F.col("id").cast("string")
    rows = _archive(spark, sf_dir).select(
        "id",
        F.concat(F.lit("event "), key).alias("title"),
        F.concat(F.lit("https://example.org/e/"), key).alias("url"),
        F.length(key).cast("long").alias("text_length"),
        F.lit(0).cast("long").alias("image_count"),
        "publish_time",
        F.lit(None).cast("string").alias("publisher"),
        F.concat(F.lit("content of "), key).alias("content"),
        F.lit(0).alias("category"),
    )
    append_archive(rows, path)
    return read_archive(spark, path)


_SQL_STORED = f"SELECT id, {_SHOW_TIME}, 'https://example.org/e/' || id AS url, 'content of ' || id AS content"


def _shown_stored(rows: DataFrame) -> DataFrame:
    time = F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rows.select("id", time.alias("publish_time"), "url", "content")


@query(
    "random_one_stored",
    f"""WITH {SQL_ARCHIVE}
{_SQL_STORED} FROM archive
WHERE user_id <> 7 AND (SELECT count(*) FROM archive) > 1
ORDER BY md5('42:' || id), id LIMIT 1""",
)
def random_one_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One random unseen row of the stored table, fetched from its bucket."""
    rows = random_one_unseen(_stored_events(spark, sf_dir), _history(spark, sf_dir), 42)
    return _shown_stored(rows)


@query(
    "random_batch_stored",
    f"""WITH {_SQL_CANDIDATES}
{_SQL_STORED} FROM candidates WHERE (SELECT count(*) FROM candidates) >= 10
ORDER BY md5('42:' || id), id LIMIT 10""",
)
def random_batch_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random batch of the stored table, fetched from at most ten buckets."""
    now = F.lit(NOW).cast("timestamp")
    rows = random_batch_unseen(_stored_events(spark, sf_dir), _history(spark, sf_dir), now, 42)
    return _shown_stored(rows)


@query(
    "text_export",
    """
SELECT source || ' #' || doc_id || '_' ||
         upper(left(sha256('https://example.org/d/' || doc_id), 12)) AS archive_key,
       md5(text) AS content
FROM documents LEFT JOIN events ON doc_id = event_id""",
)
def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_folder(spark, "texts")
    export_texts(_documents_as_rows(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return stored.select("archive_key", F.md5("content").alias("content"))


@query(
    "spoken_latest",
    f"""WITH rows AS ({_SQL_ROWS.replace("md5(text) AS content", "text AS content, ts, doc_id")})
SELECT title || '。作者：' || coalesce(publisher, '佚名') || '。发布于' ||
       CASE date_diff('day', ts::DATE, DATE '2024-01-02') WHEN 0 THEN '今天 ' WHEN 1 THEN '昨天 '
            WHEN 2 THEN '前天 '
            ELSE ['星期日', '星期一', '星期二', '星期三', '星期四', '星期五', '星期六']
                 [dayofweek(ts) + 1] || ' ' END || strftime(ts, '%H:%M') ||
       '。分类：' || ['未分类', '教育', '娱乐', '教育、娱乐'][doc_id % 4 + 1] || '。正文：' ||
       CASE WHEN len(trim(content, e' \\n\\t')) > 800 THEN left(trim(content, e' \\n\\t'), 800) || '……'
            ELSE trim(content, e' \\n\\t') END AS spoken
FROM rows WHERE publish_time IS NOT NULL ORDER BY publish_time DESC, url LIMIT 10""",
)
def spoken_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader hears first."""
    rows = latest(_documents_as_rows(spark, sf_dir), 10)
    now = F.lit("2024-01-02 09:00:00").cast("timestamp")
    return spoken(rows, now).select("spoken")
