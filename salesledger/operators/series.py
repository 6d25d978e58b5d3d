"""Time series with a row for every bucket, 0 where nothing happened."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_name, to_local, week_of_month
from ..functions.money import net_revenue, or_zero
from .periods import Period


class Buckets(NamedTuple):
    """Buckets 1..count: the number of a fact's bucket, and the name of bucket `bucket`."""

    number: Column
    count: int
    name: Column


def days(period: Period, tz: str) -> Buckets:
    """The days of a month."""
    return Buckets(F.dayofmonth(to_local(F.col("created_at"), tz)), period.days, F.col("bucket").cast("string"))


def weeks(period: Period, tz: str) -> Buckets:
    """W1, W2, ... for days 1-7, 8-14, ... of a month."""
    week = week_of_month(to_local(F.col("created_at"), tz)) + 1
    return Buckets(week, ceil(period.days / 7), F.concat(F.lit("W"), F.col("bucket").cast("string")))


def months(tz: str) -> Buckets:
    """Jan to Dec of one year. The year itself is not looked at, so filter the period first."""
    return Buckets(F.month(to_local(F.col("created_at"), tz)), 12, month_name(F.col("bucket")))


def folded(facts: DataFrame, buckets: Buckets, measures: Mapping[str, Column]) -> DataFrame:
    """Sums of the measures in each bucket that has facts, at most 31 rows. Every task folds its facts before the shuffle."""
    return facts.groupBy(buckets.number.alias("bucket")).agg(*[F.sum(m).alias(key) for key, m in measures.items()])


def filled(sums: DataFrame, buckets: Buckets, measures: Iterable[str]) -> DataFrame:
    """A row for every bucket. The sums, no more than 31 rows, are what gets broadcast to the list of buckets."""
    spine = sums.sparkSession.range(1, buckets.count + 1, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    return (
        spine.join(F.broadcast(sums), "bucket", "left")
        .select("bucket", buckets.name.alias("name"), *[or_zero(F.col(key)).alias(key) for key in measures])
        .orderBy("bucket")
    )


def zero_filled(facts: DataFrame, buckets: Buckets, measures: Mapping[str, Column]) -> DataFrame:
    """Sum the measures in each bucket and add the empty buckets."""
    return filled(folded(facts, buckets, measures), buckets, measures)


def by_day(facts: DataFrame, period: Period, tz: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row per day of a month."""
    return zero_filled(facts, days(period, tz), measures)


def by_month(facts: DataFrame, tz: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row per month of a year."""
    return zero_filled(facts, months(tz), measures)


def revenue_series(orders: DataFrame, period: Period, tz: str = "UTC") -> DataFrame:
    """Revenue per day of a month, or per month of a year."""
    measures = {"revenue": net_revenue()}
    if period.kind == "year":
        return by_month(orders, tz, measures)
    return by_day(orders, period, tz, measures)


REPORT = ("revenue", "expenses")


def report_buckets(period: Period, tz: str = "UTC") -> Buckets:
    return months(tz) if period.kind == "year" else weeks(period, tz)


def report_sums(flows: DataFrame, period: Period, tz: str = "UTC") -> DataFrame:
    """Revenue and expenses of each bucket of a report that has any."""
    return folded(flows, report_buckets(period, tz), {n: F.col(n) for n in REPORT})


def report_series(flows: DataFrame, period: Period, tz: str = "UTC") -> DataFrame:
    """Revenue and expenses per week of a month, or per month of a year."""
    return filled(report_sums(flows, period, tz), report_buckets(period, tz), REPORT)
