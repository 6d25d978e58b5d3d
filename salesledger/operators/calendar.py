"""The month calendar of open dates and changes to the set of open dates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_day, weekday
from ..sources.schema import ntz
from .periods import Period


def month_grid(open_dates: DataFrame, period: Period, now: datetime) -> DataFrame:
    """One row per day of a month with its place in a Sunday-first grid and its marks.

    Only the dates of the month, looked up by name in the scan and hence at most 31 after
    distinct, take part in the join.
    """
    month_days = [(period.start + timedelta(days=n)).date().isoformat() for n in range(period.days)]
    marks = (
        open_dates.where(F.col("date").isin(month_days))
        .select("date")
        .distinct()
        .withColumn("_open", F.lit(True))
    )
    first_day = F.lit(month_days[0]).cast("date")
    days = open_dates.sparkSession.range(1, period.days + 1, 1, 1).select(
        F.col("id").cast("int").alias("day"),
        F.date_add(first_day, (F.col("id") - 1).cast("int")).alias("_day"),
    )
    blanks = weekday(first_day)
    today = F.lit(now.date().isoformat())
    return (
        days.withColumn("date", iso_day(F.col("_day")))
        .join(F.broadcast(marks), "date", "left")
        .select(
            "date",
            "day",
            weekday(F.col("_day")).alias("weekday"),
            F.floor((blanks + F.col("day") - 1) / 7).cast("int").alias("grid_row"),
            F.coalesce("_open", F.lit(False)).alias("is_open"),
            (F.col("date") == today).alias("is_today"),
        )
        .withColumn(
            "style",
            F.when(F.col("is_open"), "open").when(F.col("is_today"), "today").otherwise("plain"),
        )
        .orderBy("day")
    )


def toggled(open_dates: DataFrame, toggles: DataFrame, now: datetime) -> DataFrame:
    """The set after each toggle (id, date) removed its date if present and added it if absent.

    A date stays when it was met an odd number of times. A stored date keeps its id and time; a new
    one gets the lowest id of its toggles and the time of the write. The counts are folded in
    every task first, so a date toggled very often does not load one task.
    """
    stored = open_dates.select("date", "id", "created_at", F.lit(None).cast("bigint").alias("_new"))
    asked = toggles.select("date", F.lit(None).cast("bigint"), F.lit(None).cast("timestamp_ntz"), "id")
    return (
        stored.unionAll(asked)
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id"), F.min("created_at").alias("created_at"), F.min("_new").alias("_new"))
        .where(F.col("_n") % 2 == 1)
        .select(
            F.coalesce("id", "_new").alias("id"),
            "date",
            F.when(F.col("id").isNull(), ntz(now)).otherwise(F.col("created_at")).alias("created_at"),
        )
    )


def unique_dates(open_dates: DataFrame) -> DataFrame:
    """One row per date: the one with the lowest id, as the unique rule would have kept it."""
    return (
        open_dates.groupBy("date")
        .agg(F.min("id").alias("_id"), F.min_by("created_at", "id").alias("created_at"))
        .select(F.col("_id").alias("id"), "date", "created_at")
    )


def duplicates(open_dates: DataFrame) -> DataFrame:
    """Dates that break the rule of one row per date, with their number of rows."""
    return open_dates.groupBy("date").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
