"""The archive table: Parquet, a directory per publish day and id bucket, and its URL keys."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from broadsheet.files import delete, exists, mark
from broadsheet.functions.categories import flags_to_text
from broadsheet.functions.text import archive_key
from broadsheet.functions.timefmt import utc_iso
from broadsheet.functions.urls import BUCKET_DIGITS, url_bucket
from broadsheet.schemas import ARCHIVE, ARCHIVE_STORED, BUCKET_COLUMN, KNOWN_URLS
from broadsheet.schemas import PARTITION_COLUMN, UNDATED, URL_BUCKET

# Buckets of ids within a day.
ID_BUCKETS = 4


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive, empty when nothing has been written yet."""
    return _read(spark, path, ARCHIVE_STORED)


def publish_day(publish_time: Column) -> Column:
    """UTC day of a publish time; undated rows share one fixed day."""
    utc = F.to_utc_timestamp(publish_time, F.current_timezone())
    return F.coalesce(F.to_date(utc), F.lit(UNDATED).cast("date"))


def url_id(url: Column) -> Column:
    """64-bit id of a row. A hash needs no counter, so appends never wait for each other.

    Two URLs can share an id once the archive has billions of rows; keys that must be exact
    use the URL as well.
    """
    return F.xxhash64(url)


def id_bucket(row_id: Column) -> Column:
    """Bucket of a row within its day."""
    return F.pmod(F.xxhash64(row_id), F.lit(ID_BUCKETS)).cast("int")


def append_archive(rows: DataFrame, path: str) -> None:
    """Append archive rows, and their URLs to the key table.

    The rebalance hint lets adaptive execution split a day that holds most of the rows and
    merge days that hold few, so files come out at the advisory size either way. Rows are sorted
    by id, so a fetch by ids skips the row groups without them. The rows are kept on the executors' disks between the two writes; a lost executor's part is computed again.

    A mark stands beside the table from before the first write until after the second. What finds
    it later (``restore_known``) adds the keys that were not written.
    """
    spark = rows.sparkSession
    restore_known(spark, path)
    stored = rows.select(*ARCHIVE.fieldNames()).withColumns(
        {PARTITION_COLUMN: publish_day(F.col("publish_time")), BUCKET_COLUMN: id_bucket(F.col("id"))}
    ).persist(StorageLevel.DISK_ONLY)
    try:
        mark(spark, unfinished_path(path))
        (
            stored.hint("rebalance", F.col(PARTITION_COLUMN), F.col(BUCKET_COLUMN))
            .sortWithinPartitions(PARTITION_COLUMN, BUCKET_COLUMN, "id")
            .write.mode("append")
            .partitionBy(PARTITION_COLUMN, BUCKET_COLUMN)
            .parquet(path)
        )
        append_known(stored, path)
        delete(spark, unfinished_path(path))
    finally:
        stored.unpersist()


def known_path(path: str) -> str:
    """The key table of an archive."""
    return f"{path.rstrip('/')}-known"


def unfinished_path(path: str) -> str:
    """The mark of an append that has not ended."""
    return f"{path.rstrip('/')}-unfinished"


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """``url, url_bucket`` of every row of the archive at ``path``."""
    return _read(spark, known_path(path), KNOWN_URLS)


def append_known(rows: DataFrame, path: str, digits: int = 1) -> None:
    """Add the URLs of archive rows to the key table.

    A bucket is named by ``digits`` hex digits of the URL's hash. An append goes into the 16
    coarse ones, so a batch leaves few files; ``compact_known`` spreads them over finer ones.
    Readers open a URL's buckets of every length.
    """
    keys = rows.select("url").filter(F.col("url").isNotNull())
    (
        keys.withColumn(URL_BUCKET, url_bucket(F.col("url"), digits))
        .hint("rebalance", F.col(URL_BUCKET))
        .write.mode("append")
        .partitionBy(URL_BUCKET)
        .parquet(known_path(path))
    )


def restore_known(spark: SparkSession, path: str, digits: int = 1) -> None:
    """Add missing keys after an append that was cut short, or to an archive that never had any.

    Does nothing in the usual case. One job may write to an archive at a time.
    """
    never = not exists(spark, known_path(path)) and exists(spark, path)
    if never or exists(spark, unfinished_path(path)):
        urls = read_archive(spark, path).select("url").distinct()
        append_known(urls.join(read_known(spark, path).select("url"), "url", "left_anti"), path, digits)
        delete(spark, unfinished_path(path))


def compact_known(spark: SparkSession, path: str, digits: int = BUCKET_DIGITS) -> None:
    """Write the key table anew from the archive, in finer buckets of few files.

    With three digits a URL's bucket holds one key in 4,096, and every append since then one in 16
    of its own. If this is cut short, the mark makes the next append restore what is missing.
    """
    mark(spark, unfinished_path(path))
    delete(spark, known_path(path))
    restore_known(spark, path, digits)


def truncate_archive(spark: SparkSession, path: str) -> None:
    """Delete every row and key; the table stays readable with its schema."""
    for target, schema in ((path, ARCHIVE_STORED), (known_path(path), KNOWN_URLS)):
        parts = [PARTITION_COLUMN, BUCKET_COLUMN] if schema is ARCHIVE_STORED else [URL_BUCKET]
        (
            spark.createDataFrame([], schema)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(*parts)
            .parquet(target)
        )
    delete(spark, unfinished_path(path))


def with_text_forms(archive: DataFrame) -> DataFrame:
    """Publish time as sortable UTC text and category as names, the portable row form."""
    return archive.withColumn("publish_time", utc_iso(F.col("publish_time"))).withColumn(
        "category", flags_to_text(F.col("category"))
    )


def export_texts(articles: DataFrame, root: str) -> None:
    """Write article texts keyed by ``{safe title}_{short hash}``.

    One table of keyed texts instead of one folder per article: millions of tiny files are no
    layout for a distributed file system.
    """
    if not root or not root.strip():
        raise ValueError("output root must not be blank")
    (
        articles.select(archive_key(F.col("title"), F.col("url")).alias("archive_key"), "content")
        .write.mode("append")
        .parquet(root)
    )
