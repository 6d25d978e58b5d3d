"""The registered queries: every operator over the given test tables.

Each query takes a session and a folder of test tables and returns a lazy DataFrame.
Money leaves a query as DOUBLE, because Spark and the SQL check give decimal sums
different precisions.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions import dates, money, text
from ..operators import calendar, changes, ingest, lookup, metrics, ordering, periods, search_index, series
from ..operators.search import search
from ..session import drop_at_exit, folders_in, shared_folder
from ..sources.mapped import MappedTables
from ..sources.schema import ORDERS, conform
from ..sources.tables import append_batch, append_rows, newest_months, read_table
from . import dashboard, financial, lists, merging, saving

AS_OF = datetime(1998, 8, 15, 10, 0, 0)
TODAY = periods.today(AS_OF)
WEEK = periods.this_week(AS_OF)
MONTH = periods.this_month(AS_OF)
YEAR = periods.this_year(AS_OF)
CHOSEN = periods.month(1997, 3)
ZONE = "Asia/Jakarta"
CUSTOMER_QUERY = "CUSTOMER#0000001"
ITEM_QUERY = "RiNg"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Queries that write before they read.
SINKS = [
    "sink_roundtrip", "sink_one_month", "append_twice", "output_names", "search_orders_indexed", "recent_orders_stored",
    "merge_months", "kpis_after_changes", "report_staged", "dashboard_staged",
]


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimal columns as DOUBLE."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def query(name: str) -> Callable[[Callable[[MappedTables], DataFrame]], Callable[[MappedTables], DataFrame]]:
    """Register a function of the domain tables under a name."""

    def register(build: Callable[[MappedTables], DataFrame]) -> Callable[[MappedTables], DataFrame]:
        QUERIES[name] = lambda spark, folder: plain_numbers(build(MappedTables(spark, folder)))
        return build

    return register


# Columns that an order or an expense needs for its time and its money.
SOLD = ("total_price", "shipping_fee", "created_at")
SOLD_PCS = (*SOLD, "quantity")
SPENT = ("price", "created_at")


def flows(t: MappedTables, period: periods.Period, tz: str = "UTC") -> DataFrame:
    return metrics.money_flows(t.orders(*SOLD, period=period, tz=tz), t.expenses(*SPENT, period=period, tz=tz))


# Scans, sources and sinks


@query("scan_products")
def scan_products(t: MappedTables) -> DataFrame:
    return conform(t.products(), "products")


@query("scan_orders")
def scan_orders(t: MappedTables) -> DataFrame:
    return conform(t.orders(), "orders")


@query("scan_expenses")
def scan_expenses(t: MappedTables) -> DataFrame:
    return conform(t.expenses(), "expenses")


@query("scan_projected")
def scan_projected(t: MappedTables) -> DataFrame:
    return t.orders("total_price", "shipping_fee", "quantity", "created_at")


@query("sink_roundtrip")
def sink_roundtrip(t: MappedTables) -> DataFrame:
    """All orders written to month partitions and read back."""
    return read_table(t.spark, stored_orders(t), "orders")


@query("sink_one_month")
def sink_one_month(t: MappedTables) -> DataFrame:
    """One month of the stored orders: the scan is pruned to its partition."""
    return periods.filter_period(read_table(t.spark, stored_orders(t), "orders"), CHOSEN)


def new_folder(t: MappedTables, name: str) -> str:
    """A folder that is deleted when the process ends. A sink has to write before it is read."""
    folder = f"{shared_folder(t.spark)}/{name}-{uuid4().hex}"
    drop_at_exit(t.spark, folder)
    return folder


def stored_orders(t: MappedTables) -> str:
    """A folder with all orders."""
    folder = new_folder(t, "orders")
    append_rows(t.orders(), folder)
    return folder


@query("append_twice")
def append_twice(t: MappedTables) -> DataFrame:
    """All orders sent in two batches, each of them twice: the second time adds nothing."""
    folder = new_folder(t, "batches")
    early = F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    for _ in range(2):
        append_batch(t.orders().where(early), folder, "orders", "early")
        append_batch(t.orders().where(~early), folder, "orders", "late")
    return read_table(t.spark, folder, "orders")


@query("output_names")
def output_names(t: MappedTables) -> DataFrame:
    """The folders and sheets that the exports of a month write, and the rows in each."""
    folder = new_folder(t, "exports")
    orders, expenses = t.orders(period=MONTH), t.expenses(period=MONTH)
    lists.export_list(orders, "orders", "This Month", folder, AS_OF)
    lists.export_list(expenses, "expenses", "This Month", folder, AS_OF)
    financial.export_report(orders, expenses, MONTH, folder)
    sheets = [(f"{target}/{sheet}") for target in folders_in(t.spark, folder) for sheet in folders_in(t.spark, f"{folder}/{target}")]
    counts = [t.spark.read.csv(f"{folder}/{s}", header=True, multiLine=True).agg(F.lit(s).alias("sheet"), F.count(F.lit(1)).alias("rows")) for s in sheets]
    return reduce(DataFrame.unionByName, counts)


@query("ingest_defaults")
def ingest_defaults(t: MappedTables) -> DataFrame:
    return ingest.from_patch(t.order_payloads(), "orders", AS_OF)


@query("ingest_refused")
def ingest_refused(t: MappedTables) -> DataFrame:
    return ingest.refused_patches(t.order_payloads(), "orders")


@query("export_list_head")
def export_list_head(t: MappedTables) -> DataFrame:
    listed = lists.order_list(t.orders("customer_name", "created_at", period=MONTH), None)
    return lists.list_head(listed, "orders", "This Month", AS_OF)


@query("report_head")
def report_head(t: MappedTables) -> DataFrame:
    return financial.report_head(flows(t, MONTH), MONTH, AS_OF)


@query("export_orders_pdf")
def export_orders_pdf(t: MappedTables) -> DataFrame:
    return lists.order_grid(lists.order_list(t.orders(), None))


@query("export_orders_xls")
def export_orders_xls(t: MappedTables) -> DataFrame:
    return lists.order_sheet(lists.order_list(t.orders(), None))


@query("export_expenses_pdf")
def export_expenses_pdf(t: MappedTables) -> DataFrame:
    return lists.expense_grid(lists.expense_list(t.expenses(), None))


@query("export_expenses_xls")
def export_expenses_xls(t: MappedTables) -> DataFrame:
    return lists.expense_sheet(lists.expense_list(t.expenses(), None))


# Periods and filters


@query("filter_period")
def filter_period(t: MappedTables) -> DataFrame:
    return t.orders("id", "created_at", period=CHOSEN)


def _orders_in(name: str, period: periods.Period | None, tz: str = "UTC") -> None:
    query(name)(lambda t: t.orders("id", "total_price", "created_at", period=period, tz=tz))


def _expenses_in(name: str, period: periods.Period | None) -> None:
    query(name)(lambda t: t.expenses("id", "price", "created_at", period=period))


_orders_in("orders_all", None)
_orders_in("orders_today", TODAY)
_orders_in("orders_this_week", WEEK)
_orders_in("orders_this_month", MONTH)
_orders_in("orders_this_year", YEAR)
_orders_in("orders_today_in_zone", TODAY, ZONE)
_orders_in("orders_this_week_in_zone", WEEK, ZONE)
_orders_in("orders_this_month_half_open", MONTH.exclusive())
_expenses_in("expenses_all", None)
_expenses_in("expenses_today", TODAY)
_expenses_in("expenses_this_month", MONTH)
_expenses_in("expenses_this_year", YEAR)


@query("search_orders")
def search_orders(t: MappedTables) -> DataFrame:
    return search(t.orders("id", "customer_name"), "customer_name", CUSTOMER_QUERY)


@query("search_expenses")
def search_expenses(t: MappedTables) -> DataFrame:
    return search(t.expenses("id", "name"), "name", ITEM_QUERY)


@query("search_orders_indexed")
def search_orders_indexed(t: MappedTables) -> DataFrame:
    """The search of the order list by an index of the stored table."""
    stored, index = read_table(t.spark, stored_orders(t), "orders"), new_folder(t, "index")
    search_index.write_index(stored, "customer_name", index)
    return search_index.search_indexed(stored, "customer_name", CUSTOMER_QUERY, index).select("id", "customer_name")


@query("net_revenue")
def net_revenue(t: MappedTables) -> DataFrame:
    return t.orders("id", *SOLD).select("id", money.net_revenue().alias("net_revenue"))


# Joins


@query("orders_with_product")
def orders_with_product(t: MappedTables) -> DataFrame:
    joined = lookup.with_product(t.orders("id", "product_id", "quantity"), t.products())
    return joined.select(
        "id",
        "quantity",
        "product_id",
        F.col("product.name").alias("product_name"),
        F.col("product.price").alias("product_price"),
    )


@query("price_orders")
def price_orders(t: MappedTables) -> DataFrame:
    rows = lookup.priced(t.orders("id", "product_id", "quantity", "shipping_fee"), t.products())
    return rows.select("id", "quantity", "unit_price", "subtotal", "computed_total")


@query("orders_on_open_date")
def orders_on_open_date(t: MappedTables) -> DataFrame:
    return lookup.on_open_date(t.orders("id", "created_at"), t.open_dates())


@query("orphan_orders")
def orphan_orders(t: MappedTables) -> DataFrame:
    return lookup.orphans(t.orders("id", "product_id"), t.products())


@query("orphan_orders_of_accepted_products")
def orphan_orders_of_accepted_products(t: MappedTables) -> DataFrame:
    """Orders that would lose their product if only the accepted product forms were loaded."""
    accepted, _ = ingest.split(
        t.product_forms(), ingest.product_form_problem(F.col("name"), F.col("price_text"))
    )
    return lookup.orphans(t.orders("id", "product_id"), accepted)


@query("deletable_products")
def deletable_products(t: MappedTables) -> DataFrame:
    return lookup.deletable(t.products("id", "name"), t.orders("product_id"))


# Key figures and series


@query("dashboard_kpis_month")
def dashboard_kpis_month(t: MappedTables) -> DataFrame:
    return metrics.dashboard_kpis(t.orders(*SOLD_PCS, period=MONTH))


@query("dashboard_kpis_year")
def dashboard_kpis_year(t: MappedTables) -> DataFrame:
    return metrics.dashboard_kpis(t.orders(*SOLD_PCS, period=YEAR))


@query("order_list_kpis")
def order_list_kpis(t: MappedTables) -> DataFrame:
    return metrics.order_list_kpis(t.orders(*SOLD_PCS, query=CUSTOMER_QUERY))


@query("expense_list_kpis")
def expense_list_kpis(t: MappedTables) -> DataFrame:
    return metrics.expense_list_kpis(lists.expense_list(t.expenses("name", *SPENT), None, ITEM_QUERY))


@query("revenue_by_day")
def revenue_by_day(t: MappedTables) -> DataFrame:
    return series.revenue_series(t.orders(*SOLD, period=MONTH), MONTH)


@query("revenue_by_day_in_zone")
def revenue_by_day_in_zone(t: MappedTables) -> DataFrame:
    return series.revenue_series(t.orders(*SOLD, period=MONTH, tz=ZONE), MONTH, ZONE)


@query("revenue_by_month")
def revenue_by_month(t: MappedTables) -> DataFrame:
    return series.revenue_series(t.orders(*SOLD, period=YEAR), YEAR)


@query("report_by_month")
def report_by_month(t: MappedTables) -> DataFrame:
    return series.report_series(flows(t, YEAR), YEAR)


@query("report_by_week")
def report_by_week(t: MappedTables) -> DataFrame:
    return series.report_series(flows(t, MONTH), MONTH)


# Order, numbers and the latest rows


@query("order_ordinals")
def order_ordinals(t: MappedTables) -> DataFrame:
    return ordering.with_ordinal(t.orders("id", "created_at"))


@query("order_ordinals_fractions")
def order_ordinals_fractions(t: MappedTables) -> DataFrame:
    """Numbers where orders of a day share a second and differ in microseconds, and some have no time."""
    day = F.col("created_at").cast("date").cast("timestamp_ntz")
    time = F.when(F.col("id") % 97 != 0, F.timestamp_add("MICROSECOND", F.col("id") * 104729 % 1_000_000, day))
    return ordering.with_ordinal(t.orders("id", "created_at").select("id", time.alias("created_at")))


@query("expense_ordinals")
def expense_ordinals(t: MappedTables) -> DataFrame:
    """Numbers are given after the search."""
    return ordering.with_ordinal(lists.expense_list(t.expenses("id", "name", "created_at"), None, ITEM_QUERY))


@query("orders_sorted")
def orders_sorted(t: MappedTables) -> DataFrame:
    return ordering.latest_first(t.orders("id", "total_price", "created_at"))


@query("products_sorted")
def products_sorted(t: MappedTables) -> DataFrame:
    return ordering.oldest_first(t.products())


@query("open_dates_sorted")
def open_dates_sorted(t: MappedTables) -> DataFrame:
    return ordering.dates_ascending(t.open_dates().select("date"))


RECENT_COLUMNS = ("id", "customer_name", "quantity", "total_price", "created_at", "status")


def recent(t: MappedTables) -> DataFrame:
    """The latest five are picked first; customer and quantity are looked up for them only."""
    return t.with_parents(ordering.latest(t.order_rows(), dashboard.RECENT), RECENT_COLUMNS, picked=True)


query("recent_orders")(recent)


@query("recent_orders_stored")
def recent_orders_stored(t: MappedTables) -> DataFrame:
    """The latest orders of the stored table: its newest months are read, no others."""
    return dashboard.recent_rows(newest_months(t.spark, stored_orders(t), "orders", dashboard.RECENT))


@query("recent_orders_text")
def recent_orders_text(t: MappedTables) -> DataFrame:
    return dashboard.recent_text(recent(t))


@query("order_table")
def order_table(t: MappedTables) -> DataFrame:
    return lists.order_table(lists.order_list(t.orders(), None))


@query("expense_table")
def expense_table(t: MappedTables) -> DataFrame:
    return lists.expense_table(lists.expense_list(t.expenses(), None))


# Open dates


@query("po_calendar")
def po_calendar(t: MappedTables) -> DataFrame:
    return calendar.month_grid(t.open_dates(MONTH), MONTH, AS_OF)


@query("toggle_open_dates")
def toggle_open_dates(t: MappedTables) -> DataFrame:
    return calendar.toggled(t.open_dates(), t.toggles(), AS_OF)


@query("unique_open_dates")
def unique_open_dates(t: MappedTables) -> DataFrame:
    return calendar.unique_dates(t.open_date_rows())


@query("duplicate_open_dates")
def duplicate_open_dates(t: MappedTables) -> DataFrame:
    return calendar.duplicates(t.open_date_rows())


# Column functions


@query("fmt_currency")
def fmt_currency(t: MappedTables) -> DataFrame:
    return t.orders("id", "total_price", "shipping_fee").select(
        "id",
        money.rupiah(F.col("total_price")).alias("total_text"),
        money.rupiah(F.col("shipping_fee")).alias("fee_text"),
        money.rupiah(F.col("shipping_fee") - F.col("total_price")).alias("difference_text"),
    )


@query("fmt_date")
def fmt_date(t: MappedTables) -> DataFrame:
    day = F.col("created_at")
    return t.orders("id", "created_at").select(
        "id",
        dates.short_date(day).alias("short_text"),
        dates.long_date(day).alias("long_text"),
        dates.day_stamp(day).alias("stamp"),
        dates.iso_day(day).alias("day_key"),
    )


@query("fmt_date_id")
def fmt_date_id(t: MappedTables) -> DataFrame:
    day = F.col("date").cast("date")
    return t.open_dates().select(
        "date",
        dates.indonesian_date(day, with_weekday=True).alias("option_label"),
        dates.indonesian_date(day).alias("long_label"),
    )


@query("date_parts")
def date_parts(t: MappedTables) -> DataFrame:
    day = dates.to_local(F.col("created_at"), ZONE)
    return t.orders("id", "created_at").select(
        "id",
        F.dayofmonth(day).alias("day"),
        F.month(day).alias("month"),
        dates.weekday(day).alias("weekday"),
        dates.days_in_month(day).alias("days_in_month"),
        dates.week_of_month(day).alias("week"),
        dates.month_name(F.month(day)).alias("month_name"),
    )


@query("product_labels")
def product_labels(t: MappedTables) -> DataFrame:
    return t.products("id", "name", "price").select(
        "id", money.product_label(F.col("name"), F.col("price")).alias("label")
    )


@query("payment_labels")
def payment_labels(t: MappedTables) -> DataFrame:
    """The four forms of a payment method; the notes column brings null and empty values."""
    return t.orders("id", "payment_method", "notes").select(
        "id",
        text.payment_name(F.col("payment_method")).alias("pill"),
        F.upper("payment_method").alias("printed"),
        text.payment_code(F.col("payment_method")).alias("code"),
        text.payment_code(F.col("notes")).alias("notes_code"),
    )


@query("text_fallbacks")
def text_fallbacks(t: MappedTables) -> DataFrame:
    return t.orders("id", "status", "notes", "shipping_fee").select(
        "id",
        text.status_label(F.col("status")).alias("status"),
        text.dash_if_blank(F.col("notes")).alias("printed_notes"),
        text.empty_if_null(F.col("notes")).alias("sheet_notes"),
        text.empty_if_null(F.col("shipping_fee")).alias("fee_cell"),
        money.or_zero(F.col("shipping_fee")).alias("fee"),
    )


@query("coerce_numbers")
def coerce_numbers(t: MappedTables) -> DataFrame:
    return t.product_forms().select("id", text.number_from_text(F.col("price_text")).alias("price"))


@query("order_date_to_ts")
def order_date_to_ts(t: MappedTables) -> DataFrame:
    return t.open_dates().select("date", dates.order_instant(F.col("date")).alias("created_at"))


@query("expense_date_to_ts")
def expense_date_to_ts(t: MappedTables) -> DataFrame:
    return t.open_dates().select("date", dates.expense_instant(F.col("date"), ZONE).alias("created_at"))


# Changes


@query("apply_changes")
def apply_changes(t: MappedTables) -> DataFrame:
    return changes.apply_changes(t.orders(), t.change_feed(), "orders", AS_OF)


@query("refused_changes")
def refused_changes(t: MappedTables) -> DataFrame:
    return changes.refused_changes(t.change_feed(), "orders")


@query("delete_products_refused")
def delete_products_refused(t: MappedTables) -> DataFrame:
    """A delete of every product: those that orders name stay."""
    feed = t.products("id").select(F.col("id").alias("seq"), "id", F.lit("delete").alias("op"))
    return changes.split_deletes(feed, t.orders("product_id"))[1]


@query("changes_unknown_product")
def changes_unknown_product(t: MappedTables) -> DataFrame:
    """Changes of orders refused after a feed of products: their product does not exist, is deleted or no number."""
    left = changes.apply_changes(t.products(), t.product_changes(), "products", AS_OF, orders=t.orders("product_id"))
    return changes.refused_changes(t.product_choices(), "orders", products=left)


@query("changes_known_product")
def changes_known_product(t: MappedTables) -> DataFrame:
    """The product of each order after both feeds."""
    orders, _ = changes.apply_both(t.orders(), t.products(), t.product_choices(), t.product_changes(), AS_OF)
    return orders.select("id", "product_id")


@query("products_after_changes")
def products_after_changes(t: MappedTables) -> DataFrame:
    return changes.apply_changes(t.products(), t.product_changes(), "products", AS_OF, orders=t.orders("product_id"))


def merged_orders(t: MappedTables) -> tuple[str, merging.Merge]:
    """A stored table of all orders into which the change feed was merged."""
    folder = stored_orders(t)
    return folder, merging.merge_changes(t.spark, folder, "orders", t.change_feed(), AS_OF)


@query("merge_months")
def merge_months(t: MappedTables) -> DataFrame:
    return read_table(t.spark, merged_orders(t)[0], "orders").select(*ORDERS.names)


@query("kpis_after_changes")
def kpis_after_changes(t: MappedTables) -> DataFrame:
    """Key figures of a year from day sums that were kept up by what a merge changed."""
    sums = new_folder(t, "days")
    merging.write_day_sums(merging.day_sums(t.orders(*SOLD_PCS)), sums)
    merging.write_day_sums(merging.day_sums(merged_orders(t)[1].log), sums)
    return merging.kpis_of_days(merging.read_day_sums(t.spark, sums), YEAR)


@query("reprice_touched")
def reprice_touched(t: MappedTables) -> DataFrame:
    rows = changes.repriced(
        t.orders("id", "product_id", "quantity", "shipping_fee", "total_price"), t.products(), t.change_feed()
    )
    return rows.select("id", "total_price", "computed_total")


@query("product_quarantine")
def product_quarantine(t: MappedTables) -> DataFrame:
    _, refused = ingest.split(
        t.product_forms(), ingest.product_form_problem(F.col("name"), F.col("price_text"))
    )
    return refused.select("id", "name", "price_text", "reason")


@query("save_orders")
def save_orders(t: MappedTables) -> DataFrame:
    return saving.save_orders(t.order_forms(), t.products(), AS_OF)[0]


@query("save_orders_refused")
def save_orders_refused(t: MappedTables) -> DataFrame:
    return saving.save_orders(t.order_forms(), t.products(), AS_OF)[1]


@query("save_orders_closed_date")
def save_orders_closed_date(t: MappedTables) -> DataFrame:
    """The forms refused where a chosen date has to be open."""
    return saving.save_orders(t.order_forms(), t.products(), AS_OF, t.open_dates())[1]


@query("save_orders_taken_id")
def save_orders_taken_id(t: MappedTables) -> DataFrame:
    """Forms refused because their id is stored already or given twice, besides the others."""
    stored = t.orders("id", "created_at").where(F.year("created_at") >= 1998).select("id")
    forms = t.order_forms()
    return saving.save_orders(forms.unionByName(forms.where("id % 10 = 0")), t.products(), AS_OF, stored=stored)[1]


@query("edit_null_seq")
def edit_null_seq(t: MappedTables) -> DataFrame:
    """Edits refused for want of a seq, or because two different ones have the same."""
    return saving.order_edits_refused(t.clashing_edits(), t.products())


@query("save_expenses")
def save_expenses(t: MappedTables) -> DataFrame:
    return saving.save_expenses(t.expense_forms(), AS_OF, ZONE)[0]


@query("save_expenses_refused")
def save_expenses_refused(t: MappedTables) -> DataFrame:
    return saving.save_expenses(t.expense_forms(), AS_OF, ZONE)[1]


@query("save_products")
def save_products(t: MappedTables) -> DataFrame:
    return saving.save_products(t.product_forms(), AS_OF)[0]


@query("edit_orders")
def edit_orders(t: MappedTables) -> DataFrame:
    """All orders after the accepted forms were saved over them."""
    return changes.apply_rows(t.orders(), saving.order_edits(t.order_forms(), t.products()), "orders")


@query("edit_expenses")
def edit_expenses(t: MappedTables) -> DataFrame:
    return changes.apply_rows(t.expenses(), saving.expense_edits(t.expense_forms(), ZONE), "expenses")


@query("edit_products")
def edit_products(t: MappedTables) -> DataFrame:
    return changes.apply_rows(t.products(), saving.product_edits(t.product_forms()), "products")


# Reports


@query("report_summary_month")
def report_summary_month(t: MappedTables) -> DataFrame:
    return metrics.report_totals(flows(t, MONTH)).withColumn("period", F.lit(MONTH.label))


@query("report_summary_year")
def report_summary_year(t: MappedTables) -> DataFrame:
    return metrics.report_totals(flows(t, YEAR)).withColumn("period", F.lit(YEAR.label))


@query("report_period_choice")
def report_period_choice(t: MappedTables) -> DataFrame:
    """The report of a chosen month instead of the current one."""
    return metrics.report_totals(flows(t, CHOSEN)).withColumn("period", F.lit(CHOSEN.label))


@query("report_overview")
def report_overview(t: MappedTables) -> DataFrame:
    orders, expenses = t.orders("id", *SOLD, period=YEAR), t.expenses("id", *SPENT, period=YEAR)
    return financial.report_overview(orders, expenses, YEAR)


@query("report_staged")
def report_staged(t: MappedTables) -> DataFrame:
    """Totals (bucket 0) and series of a report that reads orders and expenses once for both."""
    report = financial.financial_report(t.orders(*SOLD, period=YEAR), t.expenses(*SPENT, period=YEAR), YEAR, stage=True)
    totals = report.totals.select(F.lit(0).alias("bucket"), F.col("period").alias("name"), "revenue", "expenses")
    return totals.unionByName(report.series)


@query("dashboard_staged")
def dashboard_staged(t: MappedTables) -> DataFrame:
    """Key figures (bucket 0) and series of a dashboard that reads the orders of its period once for both."""
    page = dashboard.dashboard(t.orders(period=MONTH), t.open_dates(), AS_OF, stage=True)
    kpis = page.kpis.select(F.lit(0).alias("bucket"), F.col("pcs").cast("string").alias("name"), "revenue")
    return kpis.unionByName(page.series)


@query("report_counts")
def report_counts(t: MappedTables) -> DataFrame:
    return metrics.report_counts(flows(t, YEAR))


@query("report_summary_rows")
def report_summary_rows(t: MappedTables) -> DataFrame:
    return financial.summary_grid(report_summary_month(t))


@query("report_summary_sheet")
def report_summary_sheet(t: MappedTables) -> DataFrame:
    return financial.summary_sheet(report_summary_year(t), YEAR)


@query("report_order_rows")
def report_order_rows(t: MappedTables) -> DataFrame:
    return financial.order_detail_grid(t.orders(period=MONTH))


@query("report_order_sheet")
def report_order_sheet(t: MappedTables) -> DataFrame:
    return financial.order_detail_sheet(t.orders(period=YEAR))


@query("report_expense_rows")
def report_expense_rows(t: MappedTables) -> DataFrame:
    return financial.expense_detail(t.expenses(period=MONTH))


@query("report_expense_sheet")
def report_expense_sheet(t: MappedTables) -> DataFrame:
    return financial.expense_detail(t.expenses(period=YEAR), printed=False)


@query("dashboard_overview")
def dashboard_overview(t: MappedTables) -> DataFrame:
    return dashboard.dashboard_overview(t.orders(*SOLD_PCS, period=MONTH), AS_OF, "month")


@query("dashboard_overview_year")
def dashboard_overview_year(t: MappedTables) -> DataFrame:
    return dashboard.dashboard_overview(t.orders(*SOLD_PCS, period=YEAR), AS_OF, "year")
