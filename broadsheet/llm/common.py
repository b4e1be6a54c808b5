"""Shared folders, written tables and small helpers of the operators here."""

from __future__ import annotations

import ctypes
import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from broadsheet.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path that ``scratch`` gave."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(rows: DataFrame) -> None:
    """Remove the files of a table that ``written`` made."""
    for folder in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        delete(rows.sparkSession, folder)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def importable(spark: SparkSession) -> None:
    """Let local Python workers find this package where the driver did."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which a cluster sets to fit its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run):
    """``run`` over Arrow batches, after which a Python worker gives free memory back.

    Spark's workers live on and serve the stages that follow; what their allocators keep of one
    stage would lie beside what the next one needs.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Return memory that nothing uses, Arrow's and the C library's, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
