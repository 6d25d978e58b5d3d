"""Named and chosen periods, and the filter on created_at."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import MONTHS, to_utc
from ..sources.schema import ntz
from ..sources.tables import MONTH, month_key

SECOND = timedelta(seconds=1)
MILLISECOND = timedelta(milliseconds=1)


@dataclass(frozen=True)
class Period:
    """A stretch of wall-clock time.

    The end is closed and lies one second before the next period starts (one
    millisecond for a week), so a row inside that last second belongs to no day,
    month or year. exclusive() gives the half-open form without this gap.
    """

    kind: str
    start: datetime
    following: datetime
    gap: timedelta = SECOND

    @property
    def end(self) -> datetime:
        return self.following - self.gap

    @property
    def label(self) -> str:
        """Mar 2026 for a month, Year 2026 for a year."""
        if self.kind == "year":
            return f"Year {self.start.year}"
        return f"{MONTHS[self.start.month - 1]} {self.start.year}"

    @property
    def days(self) -> int:
        return (self.following - self.start).days

    def exclusive(self) -> Period:
        return replace(self, gap=timedelta(0))


def local_now(as_of: datetime, tz: str) -> datetime:
    """Wall-clock form of as_of. A value without a zone is taken as wall-clock time already."""
    if as_of.tzinfo is None:
        return as_of
    return as_of.astimezone(ZoneInfo(tz)).replace(tzinfo=None)


def _midnight(moment: datetime) -> datetime:
    return datetime(moment.year, moment.month, moment.day)


def today(now: datetime) -> Period:
    start = _midnight(now)
    return Period("day", start, start + timedelta(days=1))


def this_week(now: datetime) -> Period:
    """Monday to Sunday; a Sunday belongs to the week that began six days before."""
    start = _midnight(now) - timedelta(days=now.weekday())
    return Period("week", start, start + timedelta(days=7), MILLISECOND)


def month(year: int, number: int) -> Period:
    following = datetime(year + number // 12, number % 12 + 1, 1)
    return Period("month", datetime(year, number, 1), following)


def year(number: int) -> Period:
    return Period("year", datetime(number, 1, 1), datetime(number + 1, 1, 1))


def this_month(now: datetime) -> Period:
    return month(now.year, now.month)


def this_year(now: datetime) -> Period:
    return year(now.year)


# The period names of the two lists, in menu order.
NAMED: dict[str, Callable[[datetime], Period] | None] = {
    "All": None,
    "Today": today,
    "This Week": this_week,
    "This Month": this_month,
    "This Year": this_year,
}
ORDER_PERIODS = ["All", "Today", "This Week", "This Month"]
EXPENSE_PERIODS = ["All", "Today", "This Month", "This Year"]


def named(name: str, now: datetime) -> Period | None:
    """The period of a menu name; None stands for All."""
    make = NAMED[name]
    return make(now) if make else None


def report_years(now: datetime) -> list[int]:
    """The years a report offers: this one and the four before it, latest first."""
    return [now.year - back for back in range(5)]


def bounds(period: Period, tz: str = "UTC") -> tuple[Column, Column]:
    """First and last moment as UTC columns made of literals, which Catalyst folds."""
    return to_utc(ntz(period.start), tz), to_utc(ntz(period.end), tz)


def in_period(column: Column, period: Period, tz: str = "UTC") -> Column:
    first, last = bounds(period, tz)
    return (column >= first) & ((column <= last) if period.gap else (column < last))


def filter_period(
    df: DataFrame, period: Period | None, tz: str = "UTC", column: str = "created_at"
) -> DataFrame:
    """Rows of a period; all rows, null times included, where there is none.

    The stored column is compared with constants, so the filter reaches the Parquet
    scan. On a stored table the same bounds also select the month partitions, which
    Spark cannot work out from created_at by itself.
    """
    if period is None:
        return df
    kept = df.where(in_period(F.col(column), period, tz))
    if column == "created_at" and MONTH in df.columns:
        first, last = bounds(period, tz)
        kept = kept.where(F.col(MONTH).between(month_key(first), month_key(last)))
    return kept
