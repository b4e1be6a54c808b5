"""Paths on the file system that driver and executors share."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _resolve(spark, path)
    return files.exists(target)


def mark(spark: SparkSession, path: str) -> None:
    """Put an empty file there."""
    files, target = _resolve(spark, path)
    files.create(target, True).close()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder; one that is not there is no error."""
    files, target = _resolve(spark, path)
    files.delete(target, True)


def literal_path(uri: str) -> str:
    """A path that names the file of a URI such as ``_metadata.file_path``, whatever its characters."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in unquote(uri))
