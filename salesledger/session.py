"""Spark session settings and the shared working folder."""

from __future__ import annotations

import atexit
from collections.abc import Mapping
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key (one product, one customer, or null) is split by AQE.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Rewriting some months of a stored table leaves the other months alone.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Building a column does not look up the Python line it comes from.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(
    app: str = "salesledger", master: str | None = None, settings: Mapping[str, str] | None = None
) -> SparkSession:
    """A session with the settings above and any others given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor can reach.

    Without that setting there is no such folder, on one machine as on many.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def _path(spark: SparkSession, folder: str):
    """A folder and the file system that holds it."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def folders_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders right below a folder, none if it does not exist."""
    path, files = _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()) if files.exists(path) else []


def drop_folder(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)


def drop_at_exit(spark: SparkSession, folder: str) -> None:
    """Delete a staged folder when the process ends, if the session still lives then."""

    def drop() -> None:
        context = spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            drop_folder(spark, folder)

    atexit.register(drop)


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read from there; deleted when the process ends."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    drop_at_exit(spark, folder)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)
