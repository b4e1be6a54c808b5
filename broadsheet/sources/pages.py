"""Fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from broadsheet.schemas import PAGES

FILES_PER_BATCH = 1000
# Pages as a fetcher lands them: ``title`` is the text of the link that was followed.
LANDED = T.StructType(PAGES.fields + [T.StructField("title", T.StringType())])


def read_pages(spark: SparkSession, path: str, http_status: bool = False) -> DataFrame:
    """Pages table; with ``http_status`` when the fetcher recorded it."""
    schema = PAGES
    if http_status:
        schema = T.StructType(PAGES.fields + [T.StructField("http_status", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def read_landed(spark: SparkSession, *paths: str) -> DataFrame:
    """Landed article pages of folders or files."""
    return spark.read.schema(LANDED).parquet(*paths)


def stream_landed(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Landed article pages as a stream over the files that arrive in ``path``."""
    return (
        spark.readStream.schema(LANDED)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )

