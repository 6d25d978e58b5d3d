"""Search of a stored list by an index of three-letter pieces.

The index holds, for each piece, the months and names that contain it, one row for each different name of a month. A search reads
the pieces of its text only, keeps the names that have all of them, looks at these names, and reads the months in which it found any.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_text
from ..sources.tables import MONTH
from .search import search

# Fixed value: letters in a piece. Shorter texts have no piece and are searched without the index.
PIECE = 3
BUCKETS = 64


def pieces(text: Column) -> Column:
    """The different pieces of a lower-case text."""
    places = F.sequence(F.lit(1), F.length(text) - (PIECE - 1))
    return F.when(F.length(text) >= PIECE, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(PIECE)))))


def _bucket(piece: Column) -> Column:
    return (F.crc32(piece.cast("binary")) % BUCKETS).cast("int")


def write_index(stored: DataFrame, column: str, folder: str) -> None:
    """Index a column of a stored table. Names are made different in every month before they are cut; inside a bucket the pieces are
    sorted, so that a search opens few row groups. A piece that very many names have is dealt over several files."""
    names = stored.select(MONTH, F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
    rows = names.select(F.explode(pieces(F.lower("name"))).alias("piece"), MONTH, "name").withColumn("bucket", _bucket(F.col("piece")))
    rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "piece")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(folder)


def found_names(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(month, name) of the indexed names that contain a text of at least PIECE letters."""
    text = query.lower()
    wanted = sorted({text[i : i + PIECE] for i in range(len(text) - PIECE + 1)})
    index = spark.read.schema(f"piece string, {MONTH} string, name string, bucket int").parquet(folder)
    buckets = sorted({crc32(w.encode()) % BUCKETS for w in wanted})
    rows = index.where(F.col("piece").isin(wanted) & F.col("bucket").isin(buckets))
    have = rows.groupBy(MONTH, "name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted))
    return have.where(contains_text(F.col("name"), query)).select(MONTH, "name")


def search_indexed(stored: DataFrame, column: str, query: str, folder: str) -> DataFrame:
    """What search gives, by the index in `folder`. Names that are found name the months to read."""
    if len(query.lower()) < PIECE:
        return search(stored, column, query)
    found = found_names(stored.sparkSession, folder, query)
    found = found.select(F.col(MONTH).alias("_month"), F.col("name").alias("_name"))
    here = (F.col(MONTH) == F.col("_month")) & (F.col(column) == F.col("_name"))
    untimed = stored.where(F.col(MONTH).isNull()).join(found.where(F.col("_month").isNull()), F.col(column) == F.col("_name"), "left_semi")
    return stored.join(found, here, "left_semi").unionByName(untimed)
