from __future__ import annotations

from datetime import datetime, timezone

import pytest
from conftest import at
from salesledger.operators import periods
from salesledger.operators.periods import filter_period


def test_today():
    day = periods.today(at("1998-08-15 10:00:00"))
    assert (day.start, day.end) == (at("1998-08-15"), at("1998-08-15 23:59:59"))


@pytest.mark.parametrize(
    ("now", "first", "last"),
    [
        ("1998-08-15 10:00:00", "1998-08-10", "1998-08-16 23:59:59.999"),
        ("1998-08-16 23:00:00", "1998-08-10", "1998-08-16 23:59:59.999"),  # a Sunday
        ("1998-08-17 00:00:00", "1998-08-17", "1998-08-23 23:59:59.999"),  # a Monday
    ],
)
def test_week_runs_from_monday_to_sunday(now, first, last):
    week = periods.this_week(at(now))
    assert (week.start, week.end) == (at(first), at(last))


@pytest.mark.parametrize(
    ("year", "month", "days", "last"),
    [(2026, 2, 28, "2026-02-28"), (2024, 2, 29, "2024-02-29"), (1998, 8, 31, "1998-08-31"), (1998, 12, 31, "1998-12-31")],
)
def test_month(year, month, days, last):
    period = periods.month(year, month)
    assert period.days == days
    assert period.end == at(f"{last} 23:59:59")


def test_year_and_labels():
    assert periods.year(1998).end == at("1998-12-31 23:59:59")
    assert periods.year(2026).label == "Year 2026"
    assert periods.month(2026, 3).label == "Mar 2026"


def test_menu_names():
    now = at("1998-08-15 10:00:00")
    assert periods.named("All", now) is None
    assert periods.named("This Month", now) == periods.month(1998, 8)
    assert {*periods.ORDER_PERIODS, *periods.EXPENSE_PERIODS} == set(periods.NAMED)
    assert periods.report_years(now) == [1998, 1997, 1996, 1995, 1994]


def test_now_of_a_zone():
    instant = datetime(2026, 3, 31, 20, tzinfo=timezone.utc)
    assert periods.local_now(instant, "Asia/Jakarta") == at("2026-04-01 03:00:00")
    assert periods.local_now(at("2026-04-01"), "Asia/Jakarta") == at("2026-04-01")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_last_second_is_dropped_but_not_from_a_week(make):
    orders = make.orders(
        {"created_at": "1998-08-31 23:59:59"},
        {"created_at": "1998-08-31 23:59:59.400"},
        {"created_at": "1998-08-16 23:59:59.400"},
        {"created_at": None},
    )
    august = periods.month(1998, 8)
    assert ids(filter_period(orders, august)) == [1, 3]
    assert ids(filter_period(orders, august.exclusive())) == [1, 2, 3]
    assert ids(filter_period(orders, periods.this_week(at("1998-08-15")))) == [3]
    assert ids(filter_period(orders, periods.today(at("1998-08-16")))) == []
    assert ids(filter_period(orders, None)) == [1, 2, 3, 4]


def test_zone_moves_the_bounds(make):
    orders = make.orders({"created_at": "2026-03-31 20:00:00"}, {"created_at": "2026-03-31 16:00:00"})
    april = periods.month(2026, 4)
    assert ids(filter_period(orders, april)) == []
    assert ids(filter_period(orders, april, "Asia/Jakarta")) == [1]


def test_zone_with_daylight_saving(make):
    # New York is five hours behind in early March and four from the 8th on.
    orders = make.orders(
        {"created_at": "2026-03-01 04:59:59"},
        {"created_at": "2026-03-01 05:00:00"},
        {"created_at": "2026-04-01 03:59:59"},
        {"created_at": "2026-04-01 04:00:00"},
    )
    assert ids(filter_period(orders, periods.month(2026, 3), "America/New_York")) == [2, 3]
