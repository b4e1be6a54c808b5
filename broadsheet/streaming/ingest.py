"""Incremental ingest: landed files in, archive rows out.

The set of known URLs lives beside the archive. A batch that is replayed after a failure
finds its rows already there, so at-least-once delivery still writes each URL once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.files import literal_path
from broadsheet.operators.classify import TextModel
from broadsheet.operators.rules import SITE_RULES, SiteRule
from broadsheet.plans.ingest import ingest_batch
from broadsheet.sources.pages import FILES_PER_BATCH, read_landed, stream_landed

EVERY = "10 minutes"


def start_ingest(
    spark: SparkSession,
    landing_path: str,
    archive_path: str,
    checkpoint: str,
    models: dict[str, TextModel] | None = None,
    rules: Iterable[SiteRule] = SITE_RULES,
    every: str | None = EVERY,
    files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Run ``ingest_batch`` on the files that have arrived, at once and then ``every`` interval.

    The stream itself carries only the names of the files of a batch (at most
    ``files_per_batch``). The batch reads them as a table, so URLs can be read without HTML, and
    HTML once. With ``every=None`` everything that is there is processed and the query ends.
    """
    rules = list(rules)
    names = stream_landed(spark, landing_path, files_per_batch).select(F.col("_metadata.file_path").alias("file"))

    def write(batch: DataFrame, _: int) -> None:
        files = sorted(r.file for r in batch.distinct().collect())
        if files:
            landed = read_landed(batch.sparkSession, *map(literal_path, files))
            ingest_batch(landed, archive_path, models, rules)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        names.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(write)
        .start()
    )
