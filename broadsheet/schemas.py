"""Table and struct types shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

LINK = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("url", T.StringType())]
)

EXTRACT_RESULT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("publisher", T.StringType()),
        T.StructField("publish_time", T.StringType()),
    ]
)

ARCHIVE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("text_length", T.LongType()),
        T.StructField("image_count", T.LongType()),
        T.StructField("publish_time", T.TimestampType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("category", T.IntegerType()),
    ]
)
# The archive is laid out by day, so that reads by time prune, and within a day by a bucket of
# the id, so that a fetch of a few rows opens no more buckets than rows.
PARTITION_COLUMN = "publish_date"
BUCKET_COLUMN = "id_bucket"
ARCHIVE_STORED = T.StructType(
    ARCHIVE.fields
    + [T.StructField(PARTITION_COLUMN, T.DateType()), T.StructField(BUCKET_COLUMN, T.IntegerType())]
)
# Day used for rows without a publish time: a partition value is never null.
UNDATED = "1900-01-01"

# URLs of the archive beside it, in buckets by the first digits of the URL's hash.
URL_BUCKET = "url_bucket"
KNOWN_URLS = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField(URL_BUCKET, T.StringType())]
)

CORPUS = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("label", T.StringType())]
)
