from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from conftest import at
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from salesledger.functions import dates, money, text


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    ("amount", "kind", "shown"),
    [
        (Decimal(15000), "decimal(18,2)", "Rp 15.000"),
        (None, "decimal(18,2)", "Rp 0"),
        (float("nan"), "double", "Rp 0"),
        (1234567.5, "double", "Rp 1.234.568"),
        (Decimal(-15000), "decimal(18,2)", "-Rp 15.000"),
        (Decimal("-0.40"), "decimal(18,2)", "Rp 0"),
        (Decimal("9999999999999999.00"), "decimal(18,2)", "Rp 9.999.999.999.999.999"),
    ],
)
def test_rupiah(spark, amount, kind, shown):
    assert one(spark, money.rupiah(F.col("x")), amount, kind) == shown


@pytest.mark.parametrize(
    ("price", "shown"),
    [("15000", "Box — Rp 15.000"), ("15000.50", "Box — Rp 15.000,5"), ("0.25", "Box — Rp 0,25")],
)
def test_product_label(spark, price, shown):
    assert one(spark, money.product_label(F.lit("Box"), F.col("x")), Decimal(price), "decimal(18,2)") == shown


@pytest.mark.parametrize(
    ("day", "short", "long", "indonesian", "stamp"),
    [
        ("2026-09-09", "09 Sept 2026", "Wednesday, 9 September 2026", "Rab, 9 September 2026", "09/09/2026"),
        ("2026-11-29", "29 Nov 2026", "Sunday, 29 November 2026", "Min, 29 November 2026", "29/11/2026"),
        ("2026-03-07", "07 Mar 2026", "Saturday, 7 March 2026", "Sab, 7 Maret 2026", "07/03/2026"),
        ("2026-12-01", "01 Dec 2026", "Tuesday, 1 December 2026", "Sel, 1 Desember 2026", "01/12/2026"),
    ],
)
def test_date_text(spark, day, short, long, indonesian, stamp):
    x = F.col("x")
    forms = (
        (dates.short_date(x), short),
        (dates.long_date(x), long),
        (dates.indonesian_date(x, with_weekday=True), indonesian),
        (dates.indonesian_date(x), indonesian.split(", ")[1]),
        (dates.day_stamp(x), stamp),
        (dates.iso_day(x), day),
    )
    for column, expected in forms:
        assert one(spark, column, at(f"{day} 23:30:00"), "timestamp_ntz") == expected
        assert one(spark, column, None, "timestamp_ntz") is None


def test_date_parts(spark):
    x = F.col("x")
    moment = at("2024-02-29 12:00:00")
    parts = (
        (dates.weekday(x), 4), (dates.days_in_month(x), 29), (dates.week_of_month(x), 4),
        (dates.month_name(F.month(x)), "Feb"),
    )
    for column, expected in parts:
        assert one(spark, column, moment, "timestamp_ntz") == expected


def test_local_day(spark):
    local = dates.iso_day(dates.to_local(F.col("x"), "Asia/Jakarta"))
    assert one(spark, local, at("2026-03-31 20:00:00"), "timestamp_ntz") == "2026-04-01"


def test_stored_time_of_chosen_dates(spark):
    assert one(spark, dates.order_instant(F.col("x")), "2026-03-07", "string") == datetime(2026, 3, 7)
    noon = dates.expense_instant(F.col("x"), "America/New_York")
    assert one(spark, noon, "2026-03-07", "string") == datetime(2026, 3, 7, 17)
    assert one(spark, noon, "2026-03-08", "string") == datetime(2026, 3, 8, 16)  # daylight saving begins
    assert one(spark, noon, "soon", "string") is None


@pytest.mark.parametrize(
    ("typed", "number"),
    [("", "0"), (None, "0"), (" 7.5 ", "7.5"), (" 7\t", "7"), ("abc", None), ("1e3", "1000"), ("-2", "-2")],
)
def test_number_input(spark, typed, number):
    expected = None if number is None else Decimal(number)
    assert one(spark, text.number_from_text(F.col("x")), typed, "string") == expected


@pytest.mark.parametrize(("typed", "number"), [("", 0), ("3", 3), ("3.0", 3), ("1e2", 100), ("2.5", None), ("9" * 12, None)])
def test_whole_number_input(spark, typed, number):
    assert one(spark, text.number_from_text(F.col("x"), IntegerType()), typed, "string") == number


@pytest.mark.parametrize(
    ("query", "found"),
    [("AN", ["Ani"]), ("", ["Ani", "B%n"]), ("%", ["B%n"]), ("_", [])],
)
def test_search_is_literal(spark, query, found):
    names = spark.createDataFrame([("Ani",), (None,), ("B%n",)], "name string")
    kept = names.where(text.contains_text(F.col("name"), query)).collect()
    assert sorted(r.name for r in kept) == found


def test_labels(spark):
    x = F.col("x")
    cases = (
        (text.status_label(x), {None: "In Progress", "done": "Done", "process": "In Progress", "new": "In Progress"}),
        (text.status_name(x), {None: None, "done": "Done", "process": "In Progress", "new": None}),
        (text.payment_code(x), {None: "-", "": "-", "tf": "TF"}),
        (text.payment_name(x), {None: None, "cash": "Cash", "tf": "Transfer", "card": None}),
        (text.dash_if_blank(x), {None: "-", "": "-", "a": "a"}),
        (text.empty_if_null(x), {None: "", "": "", "0": "0"}),
    )
    for column, expected in cases:
        for value, shown in expected.items():
            assert one(spark, column, value, "string") == shown
