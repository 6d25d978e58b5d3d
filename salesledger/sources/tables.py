"""Stored tables: Parquet folders partitioned by the month of created_at (UTC).

A batch of new rows may be appended under a name; the ledger of names lies in the folder _batches of the table, which readers of the
table pass over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import folders_in
from .schema import TABLES

MONTH = "created_month"
# Fixed value: the name that Spark gives to the folder of a null partition.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
LEDGER = "_batches"


def month_key(created_at: Column) -> Column:
    """The partition value of a UTC time, as yyyy-MM text."""
    return F.substring(created_at.cast("date").cast("string"), 1, 7)


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Read a stored table under its fixed schema; nothing is inferred."""
    schema = StructType([*TABLES[table].fields, StructField(MONTH, StringType())])
    return spark.read.schema(schema).parquet(folder)


def write_table(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Write rows into their month partitions. An overwrite leaves months without new rows alone,
    whatever the session is set to.

    The rebalance hint lets AQE cut a hot month into several files and join small
    months, where a plain repartition by month would leave one task per month.
    Rows are sorted by time inside each file, so that Parquet row groups carry
    narrow time ranges and a filter on a day reads few of them.
    """
    (
        df.withColumn(MONTH, month_key(F.col("created_at")))
        .hint("rebalance", MONTH)
        .sortWithinPartitions(MONTH, "created_at")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH)
        .parquet(folder)
    )


def append_rows(df: DataFrame, folder: str) -> None:
    """Add new rows to a stored table."""
    write_table(df, folder, "append")


def months_of(spark: SparkSession, folder: str) -> list[str | None]:
    """The months a table has, in the order of latest rows: none at all first, then the newest."""
    names = [n.partition("=")[2] for n in folders_in(spark, folder) if n.startswith(f"{MONTH}=")]
    return [None for n in names if n == NO_MONTH] + sorted((n for n in names if n != NO_MONTH), reverse=True)


def in_months(df: DataFrame, months: list[str | None]) -> DataFrame:
    """Rows of some months of a stored table; only their folders are read."""
    named = [m for m in months if m is not None]
    kept = F.col(MONTH).isin(named) if named else F.lit(False)
    return df.where(kept | F.col(MONTH).isNull() if None in months else kept)


def newest_months(spark: SparkSession, folder: str, table: str, count: int) -> DataFrame:
    """The part of a stored table that holds its latest `count` rows.

    Months are asked one after another, newest first, until they have enough rows; each question stops at `count`
    rows. The other months are not opened.
    """
    stored, chosen, found = read_table(spark, folder, table), [], 0
    for month in months_of(spark, folder):
        chosen.append(month)
        found += in_months(stored, [month]).select(F.lit(1)).limit(count - found).count()
        if found >= count:
            break
    return in_months(stored, chosen)


def append_batch(df: DataFrame, folder: str, table: str, batch: str) -> bool:
    """Add new rows under the name of their batch, once; false where the batch is in the table already.

    Ids are checked as a primary key would: a null or doubled id, or an id of another batch, raises and nothing is written. A batch
    that was begun and not finished (its writer was lost) may be sent again: rows that got into the table are
    left out. A name holds letters, digits, dots, dashes and underscores.
    """
    spark = df.sparkSession
    if not batch or not all(c.isalnum() or c in "._-" for c in batch):
        raise ValueError(f"no name of a batch: {batch!r}")
    ledger = f"{folder.rstrip('/')}/{LEDGER}"
    marks = folders_in(spark, ledger)
    if f"{batch}.done" in marks:
        return False
    doubled = df.groupBy("id").count().where((F.col("count") > 1) | F.col("id").isNull()).limit(5).collect()
    if doubled:
        raise ValueError(f"null or doubled ids: {[r.id for r in doubled]}")
    if months_of(spark, folder):
        taken = read_table(spark, folder, table).select("id").join(df.select("id"), "id", "left_semi")
        if f"{batch}.begun" in marks:
            df = df.join(taken, "id", "left_anti")
        elif clash := taken.limit(5).collect():
            raise ValueError(f"ids are taken: {[r.id for r in clash]}")
    mark = spark.range(1).select(F.lit(batch).alias("batch"))
    mark.write.mode("overwrite").parquet(f"{ledger}/{batch}.begun")
    append_rows(df, folder)
    mark.write.mode("overwrite").parquet(f"{ledger}/{batch}.done")
    return True
