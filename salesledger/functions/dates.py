"""Local time, date parts and date text.

Times are stored as UTC without a zone. A function that looks at the day on the wall
takes a zone name and shifts the column first. date_format writes English names in
every session; the other names come from the lists below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month and weekday names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SHORT_DATE_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sept", "Oct", "Nov", "Dec"]
MONTHS_ID = [
    "Januari", "Februari", "Maret", "April", "Mei", "Juni",
    "Juli", "Agustus", "September", "Oktober", "November", "Desember",
]
WEEKDAYS_ID = ["Min", "Sen", "Sel", "Rab", "Kam", "Jum", "Sab"]


def to_local(moment: Column, tz: str) -> Column:
    """UTC time -> wall-clock time in a zone."""
    if tz == "UTC":
        return moment
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), moment)


def to_utc(moment: Column, tz: str) -> Column:
    """Wall-clock time in a zone -> UTC time."""
    if tz == "UTC":
        return moment
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), moment)


def _pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index)


def month_name(number: Column) -> Column:
    """1 -> Jan"""
    return _pick(MONTHS, number)


def week_of_month(day: Column) -> Column:
    """Seven-day buckets counted from the 1st: 0 for days 1-7, 1 for days 8-14 and so on."""
    return F.floor((F.dayofmonth(day) - 1) / 7).cast("int")


def weekday(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def iso_day(day: Column) -> Column:
    """2026-03-07"""
    return day.cast("date").cast("string")


def short_date(day: Column) -> Column:
    """07 Mar 2026; September is written Sept."""
    number = F.lpad(F.dayofmonth(day).cast("string"), 2, "0")
    return F.concat(
        number, F.lit(" "), _pick(SHORT_DATE_MONTHS, F.month(day)), F.lit(" "), F.year(day).cast("string")
    )


def day_stamp(day: Column) -> Column:
    """07/03/2026"""
    return F.date_format(day, "dd/MM/yyyy")


def long_date(day: Column) -> Column:
    """Saturday, 7 March 2026"""
    return F.date_format(day, "EEEE, d MMMM yyyy")


def indonesian_date(day: Column, with_weekday: bool = False) -> Column:
    """7 Maret 2026, or Sab, 7 Maret 2026"""
    date = F.concat_ws(
        " ",
        F.dayofmonth(day).cast("string"),
        _pick(MONTHS_ID, F.month(day)),
        F.year(day).cast("string"),
    )
    if with_weekday:
        date = F.concat(_pick(WEEKDAYS_ID, F.dayofweek(day)), F.lit(", "), date)
    return F.when(day.isNotNull(), date)


def order_instant(date_text: Column) -> Column:
    """The time stored for an order dated by text: midnight UTC of that day."""
    return date_text.try_cast("date").cast("timestamp_ntz")


def expense_instant(date_text: Column, tz: str) -> Column:
    """The time stored for an expense dated by text: noon in the local zone."""
    noon = F.timestamp_add("HOUR", F.lit(12), date_text.try_cast("date").cast("timestamp_ntz"))
    return to_utc(noon, tz)
