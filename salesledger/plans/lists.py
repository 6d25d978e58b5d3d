"""The order list and the expense list: period, search, key figures and exports.

Grids and sheets with in_order come out in the order of their numbers (see ordering.with_ordinal), as write_sheet takes them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import short_date, to_local
from ..functions.money import rupiah
from ..functions.text import dash_if_blank, empty_if_null, payment_name, status_name
from ..operators.ordering import with_ordinal
from ..operators.periods import Period, filter_period
from ..operators.search import search
from ..sources.sinks import head_lines, list_file_name, list_title, sheet_title, write_sheet


def order_list(orders: DataFrame, period: Period | None, query: str = "", tz: str = "UTC") -> DataFrame:
    return search(filter_period(orders, period, tz), "customer_name", query)


def expense_list(expenses: DataFrame, period: Period | None, query: str = "", tz: str = "UTC") -> DataFrame:
    return search(filter_period(expenses, period, tz), "name", query)


def order_table(listed: DataFrame, tz: str = "UTC") -> DataFrame:
    """The order list on the page, numbered and latest first."""
    listed = listed.select(
        "id", "created_at", "customer_name", "quantity", "total_price",
        "payment_method", "shipping_fee", "notes", "status",
    )
    return with_ordinal(listed).select(
        "no",
        "id",
        short_date(to_local(F.col("created_at"), tz)).alias("date"),
        "customer_name",
        "quantity",
        rupiah(F.col("total_price")).alias("total"),
        payment_name(F.col("payment_method")).alias("payment"),
        rupiah(F.col("shipping_fee")).alias("shipping"),
        dash_if_blank(F.col("notes")).alias("notes"),
        status_name(F.col("status")).alias("status"),
    )


def expense_table(listed: DataFrame, tz: str = "UTC") -> DataFrame:
    """The expense list on the page."""
    return with_ordinal(listed.select("id", "created_at", "name", "amount", "price", "notes")).select(
        "no",
        "id",
        short_date(to_local(F.col("created_at"), tz)).alias("date"),
        "name",
        "amount",
        rupiah(F.col("price")).alias("price"),
        dash_if_blank(F.col("notes")).alias("notes"),
    )


def order_grid(listed: DataFrame, tz: str = "UTC", in_order: bool = False) -> DataFrame:
    """The printed order list: numbered, latest first, all cells as text."""
    listed = listed.select(
        "id", "created_at", "customer_name", "quantity", "total_price",
        "payment_method", "shipping_fee", "status",
    )
    return with_ordinal(listed, in_order=in_order).select(
        F.col("no").alias("#"),
        empty_if_null(short_date(to_local(F.col("created_at"), tz))).alias("Date"),
        empty_if_null(F.col("customer_name")).alias("Customer"),
        empty_if_null(F.col("quantity")).alias("Qty"),
        rupiah(F.col("total_price")).alias("Total"),
        empty_if_null(F.upper("payment_method")).alias("Payment"),
        rupiah(F.col("shipping_fee")).alias("Shipping"),
        empty_if_null(F.col("status")).alias("Status"),
    )


def order_sheet(listed: DataFrame, tz: str = "UTC", in_order: bool = False) -> DataFrame:
    """The order list for a spreadsheet: numbers stay numbers, a missing one is an empty cell."""
    listed = listed.select(
        "id", "created_at", "customer_name", "quantity", "total_price",
        "payment_method", "shipping_fee", "notes", "status",
    )
    return with_ordinal(listed, in_order=in_order).select(
        F.col("no").alias("#"),
        empty_if_null(short_date(to_local(F.col("created_at"), tz))).alias("Date"),
        empty_if_null(F.col("customer_name")).alias("Customer"),
        F.col("quantity").alias("Qty"),
        F.col("total_price").alias("Total"),
        empty_if_null(F.col("payment_method")).alias("Payment"),
        F.col("shipping_fee").alias("Shipping"),
        empty_if_null(F.col("notes")).alias("Notes"),
        empty_if_null(F.col("status")).alias("Status"),
    )


def expense_grid(listed: DataFrame, tz: str = "UTC", in_order: bool = False) -> DataFrame:
    """The printed expense list."""
    return with_ordinal(listed.select("id", "created_at", "name", "amount", "price", "notes"), in_order=in_order).select(
        F.col("no").alias("#"),
        empty_if_null(short_date(to_local(F.col("created_at"), tz))).alias("Date"),
        empty_if_null(F.col("name")).alias("Item"),
        empty_if_null(F.col("amount")).alias("Qty"),
        rupiah(F.col("price")).alias("Price"),
        dash_if_blank(F.col("notes")).alias("Notes"),
    )


def expense_sheet(listed: DataFrame, tz: str = "UTC", in_order: bool = False) -> DataFrame:
    """The expense list for a spreadsheet."""
    return with_ordinal(listed.select("id", "created_at", "name", "amount", "price", "notes"), in_order=in_order).select(
        F.col("no").alias("#"),
        empty_if_null(short_date(to_local(F.col("created_at"), tz))).alias("Date"),
        empty_if_null(F.col("name")).alias("Item"),
        F.col("amount").alias("Qty"),
        F.col("price").alias("Price"),
        empty_if_null(F.col("notes")).alias("Notes"),
    )


def list_head(listed: DataFrame, table: str, period_name: str, now: datetime) -> DataFrame:
    """Title and day of printing, above a printed list."""
    return head_lines(listed.agg(F.count(F.lit(1)).alias("rows")), list_title(table, period_name), now)


def export_list(
    listed: DataFrame, table: str, period_name: str, folder: str, now: datetime, tz: str = "UTC", printed: bool = False
) -> str:
    """Write a list as one job: a folder with the name of table and period, that holds the sheet Orders or Expenses, or, printed,
    the head and the grid. Returns the folder."""
    target = f"{folder.rstrip('/')}/{list_file_name(table, period_name)}"
    grid, sheet = {"orders": (order_grid, order_sheet), "expenses": (expense_grid, expense_sheet)}[table]
    if printed:
        write_sheet(list_head(listed, table, period_name, now), f"{target}/Head")
        write_sheet(grid(listed, tz, in_order=True), f"{target}/List", in_order=True)
    else:
        write_sheet(sheet(listed, tz, in_order=True), f"{target}/{sheet_title(table.capitalize())}", in_order=True)
    return target
