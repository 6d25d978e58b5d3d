"""Where operators cut lineage: checkpoints and written tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; without one there is none, on one machine as on many."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(frame: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder; lost executors cost no recomputation."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


#: Spark deletes the shuffle files of a query at its end, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(frame: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, deleted when the process ends.

    drop_shuffles: the shuffle files behind the table go as soon as it is written, before the next step makes its own.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if drop_shuffles:
        spark.conf.set(CLEANUP, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(_drop, spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def small_hashes(n: int, size: int) -> int:
    """The greatest 63-bit hash to take, so that of n different ones at most about `size` are."""
    share = min(1.0, max(1.0, size - 6 * size**0.5) / max(n, 1))
    return min(2**63 - 1, int(share * 2**63))


def sampled(frame: DataFrame, key: str, size: int) -> DataFrame:
    """Rows whose 64-bit hash in column `key` is small, for at most about `size` different keys: the same rows on every run."""
    n = frame.select(key).distinct().count()
    return frame.where(F.shiftrightunsigned(F.col(key), 1) <= F.lit(small_hashes(n, size)))
