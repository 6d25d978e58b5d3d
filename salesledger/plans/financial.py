"""The financial report of a month or a year."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import short_date, to_local
from ..functions.money import net_revenue, or_zero, rupiah
from ..functions.text import dash_if_blank, empty_if_null, payment_code, status_label
from ..operators.metrics import money_flows, report_totals
from ..operators.ordering import with_ordinal
from ..operators.periods import Period, filter_period
from ..operators.series import REPORT, filled, report_buckets, report_series, report_sums
from ..session import staged
from ..sources.sinks import head_lines, report_title, write_report


class FinancialReport(NamedTuple):
    totals: DataFrame
    series: DataFrame
    orders: DataFrame
    expenses: DataFrame


def flows_of(orders: DataFrame, expenses: DataFrame, period: Period, tz: str = "UTC") -> DataFrame:
    """Revenue and expense rows of the period."""
    return money_flows(filter_period(orders, period, tz), filter_period(expenses, period, tz))


def financial_report(
    orders: DataFrame, expenses: DataFrame, period: Period, tz: str = "UTC", stage: bool = False
) -> FinancialReport:
    """Totals, series and the rows of both detail sections, each a plan of its own.

    Totals are sums of the buckets of the series. With stage, these sums (31 rows at most) are written to the shared folder by
    one job, and totals and series read them there: one pass over orders and expenses for both.
    """
    sums = report_sums(flows_of(orders, expenses, period, tz), period, tz)
    if stage:
        sums = staged(sums, "figures")
    return FinancialReport(
        totals=report_totals(sums).withColumn("period", F.lit(period.label)),
        series=filled(sums, report_buckets(period, tz), REPORT),
        orders=filter_period(orders, period, tz),
        expenses=filter_period(expenses, period, tz),
    )


def _stacked(rows: DataFrame, lines: list[tuple[Column, Column]]) -> DataFrame:
    """A one-row DataFrame turned into numbered lines of metric and value."""
    entries = [
        F.struct(F.lit(i).alias("line"), metric.alias("metric"), value.alias("value"))
        for i, (metric, value) in enumerate(lines, 1)
    ]
    return rows.select(F.inline(F.array(*entries))).orderBy("line")


def summary_grid(totals: DataFrame) -> DataFrame:
    """The printed summary: four lines of text."""
    return _stacked(totals, [
        (F.lit("Period"), F.col("period")),
        (F.lit("Total Revenue (excl. shipping)"), rupiah(F.col("revenue"))),
        (F.lit("Total Expenses"), rupiah(F.col("expenses"))),
        (F.lit("Net Profit"), rupiah(F.col("profit"))),
    ])


def summary_sheet(totals: DataFrame, period: Period) -> DataFrame:
    """The summary sheet: title, empty line, header and four lines with plain numbers."""
    empty = F.lit("")

    def plain(name: str) -> Column:
        return F.col(name).cast("decimal(38,2)").cast("string")

    return _stacked(totals, [
        (F.lit(report_title(period.label)), empty),
        (empty, empty),
        (F.lit("Metric"), F.lit("Value")),
        (F.lit("Period"), F.col("period")),
        (F.lit("Total Revenue (excl. shipping)"), plain("revenue")),
        (F.lit("Total Expenses"), plain("expenses")),
        (F.lit("Net Profit"), plain("profit")),
    ])


def _order_columns(orders: DataFrame) -> DataFrame:
    return orders.select(
        "id", "created_at", "customer_name", "quantity", "total_price",
        "shipping_fee", "payment_method", "status", "notes",
    )


def order_detail_grid(orders: DataFrame, tz: str = "UTC", in_order: bool = False) -> DataFrame:
    """The printed order section: nine columns."""
    return with_ordinal(_order_columns(orders), in_order=in_order).select(
        F.col("no").alias("#"),
        short_date(to_local(F.col("created_at"), tz)).alias("Date"),
        F.col("customer_name").alias("Customer"),
        F.col("quantity").alias("Qty"),
        rupiah(net_revenue()).alias("Revenue"),
        rupiah(F.col("shipping_fee")).alias("Shipping"),
        payment_code(F.col("payment_method")).alias("Payment"),
        status_label(F.col("status")).alias("Status"),
        dash_if_blank(F.col("notes")).alias("Notes"),
    )


def order_detail_sheet(orders: DataFrame, tz: str = "UTC", in_order: bool = False) -> DataFrame:
    """The order sheet: ten columns, money as numbers, the gross total added."""
    return with_ordinal(_order_columns(orders), in_order=in_order).select(
        F.col("no").alias("#"),
        short_date(to_local(F.col("created_at"), tz)).alias("Date"),
        F.col("customer_name").alias("Customer"),
        F.col("quantity").alias("Qty"),
        net_revenue().alias("Revenue (excl. shipping)"),
        or_zero(F.col("shipping_fee")).alias("Shipping"),
        F.col("total_price").alias("Total"),
        payment_code(F.col("payment_method")).alias("Payment"),
        status_label(F.col("status")).alias("Status"),
        empty_if_null(F.col("notes")).alias("Notes"),
    )


def expense_detail(expenses: DataFrame, tz: str = "UTC", printed: bool = True, in_order: bool = False) -> DataFrame:
    """The expense section: six columns; text in print, numbers in a sheet."""
    rows = with_ordinal(expenses.select("id", "created_at", "name", "amount", "price", "notes"), in_order=in_order)
    price, notes = F.col("price"), F.col("notes")
    return rows.select(
        F.col("no").alias("#"),
        short_date(to_local(F.col("created_at"), tz)).alias("Date"),
        F.col("name").alias("Item"),
        F.col("amount").alias("Qty"),
        (rupiah(price) if printed else price).alias("Price"),
        (dash_if_blank(notes) if printed else empty_if_null(notes)).alias("Notes"),
    )


def report_head(flows: DataFrame, period: Period, now: datetime) -> DataFrame:
    """Title and day of printing, above the printed report, and how many rows its sections have."""
    return head_lines(flows.agg(F.count(F.lit(1)).alias("rows")), report_title(period.label), now)


def report_overview(orders: DataFrame, expenses: DataFrame, period: Period, tz: str = "UTC") -> DataFrame:
    """The series of the report with its totals beside each bucket: one pass over orders and expenses.
    The window runs over the buckets, at most twelve."""
    rows = report_series(flows_of(orders, expenses, period, tz), period, tz)
    whole = Window.partitionBy()
    sums = {n: F.sum(n).over(whole) for n in ("revenue", "expenses")}
    return rows.select("*", *[e.alias(f"total_{n}") for n, e in sums.items()], (sums["revenue"] - sums["expenses"]).alias("profit"))


def export_report(
    orders: DataFrame, expenses: DataFrame, period: Period, folder: str, tz: str = "UTC", printed: bool = False,
    now: datetime | None = None,
) -> str:
    """Write the three sections and return the report folder. A printed report begins with title and day, and needs now."""
    report = financial_report(orders, expenses, period, tz)
    order_rows = order_detail_grid if printed else order_detail_sheet
    head = {}
    if printed:
        if now is None:
            raise ValueError("a printed report needs the time of printing")
        head = {"Head": report_head(flows_of(orders, expenses, period, tz), period, now)}
        summary = summary_grid(report.totals).coalesce(1).select(F.col("metric").alias("Metric"), F.col("value").alias("Value"))
    else:
        summary = summary_sheet(report.totals, period)
    return write_report(
        head | {
            "Summary": summary,
            "Orders": order_rows(report.orders, tz, in_order=True),
            "Expenses": expense_detail(report.expenses, tz, printed, in_order=True),
        },
        folder,
        period.label,
    )
