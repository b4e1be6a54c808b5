"""Session helpers. A cluster's own settings always win over the ones here."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution coalesces small shuffles and splits skewed join partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, app: str = "broadsheet", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.ui.enabled": "false",
        # Building large expressions is several times faster without call-site capture.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or a local one where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="broadsheet-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``DataFrame.checkpoint`` has a directory, keeping any that is set."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    path = shared_dir(spark)
    spark.sparkContext.setCheckpointDir(path)
    return path


def kept(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and kept in the shared folder, where a lost executor loses nothing."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()
