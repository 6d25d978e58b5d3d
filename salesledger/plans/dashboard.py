"""The dashboard of a month or a year."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import long_date, short_date, to_local
from ..functions.money import net_revenue, rupiah
from ..functions.text import status_label
from ..operators.calendar import month_grid
from ..operators.metrics import total
from ..operators.ordering import latest
from ..operators.periods import Period, filter_period, local_now, this_month, this_year
from ..operators.series import Buckets, days, filled, folded, months, zero_filled
from ..session import staged
from ..sources.schema import ntz

# Fixed value: how many orders the dashboard lists.
RECENT = 5


class Dashboard(NamedTuple):
    kpis: DataFrame
    series: DataFrame
    recent: DataFrame
    calendar: DataFrame


def recent_rows(orders: DataFrame) -> DataFrame:
    """The latest orders of all time, whatever the period of the dashboard."""
    return latest(
        orders.select("id", "customer_name", "quantity", "total_price", "created_at", "status"), RECENT
    )


def recent_text(recent: DataFrame, tz: str = "UTC") -> DataFrame:
    """The lines shown for the latest orders."""
    return recent.select(
        "id",
        "customer_name",
        F.concat(
            short_date(to_local(F.col("created_at"), tz)), F.lit(" · "), F.col("quantity").cast("string"), F.lit(" pcs")
        ).alias("detail"),
        rupiah(F.col("total_price")).alias("total"),
        status_label(F.col("status")).alias("status"),
    )


def dashboard_period(view: str, now: datetime) -> Period:
    return this_month(now) if view == "month" else this_year(now)


def _measures() -> dict[str, Column]:
    return {"pcs": F.col("quantity"), "revenue": net_revenue()}


def dashboard_buckets(period: Period, tz: str) -> Buckets:
    return months(tz) if period.kind == "year" else days(period, tz)


def dashboard(
    orders: DataFrame, open_dates: DataFrame, as_of: datetime, view: str = "month", tz: str = "UTC", stage: bool = False
) -> Dashboard:
    """Key figures, revenue series, latest orders and the calendar of the current month.

    Key figures are sums of the buckets of the series. With stage, these sums (31 rows at most) are written to the shared folder by
    one job, and both read them there: one pass over the orders of the period.
    """
    now = local_now(as_of, tz)
    period = dashboard_period(view, now)
    buckets = dashboard_buckets(period, tz)
    sums = folded(filter_period(orders, period, tz), buckets, _measures())
    if stage:
        sums = staged(sums, "figures")
    return Dashboard(
        kpis=sums.agg(*[total(F.col(n)).alias(n) for n in _measures()]),
        series=filled(sums, buckets, ["revenue"]),
        recent=recent_rows(orders),
        calendar=month_grid(open_dates, this_month(now), now),
    )


def dashboard_overview(orders: DataFrame, as_of: datetime, view: str = "month", tz: str = "UTC") -> DataFrame:
    """Series and key figures from one pass: pieces and revenue per bucket and their totals."""
    now = local_now(as_of, tz)
    period = dashboard_period(view, now)
    sold = filter_period(orders, period, tz)
    series = zero_filled(sold, dashboard_buckets(period, tz), _measures())
    # The window holds the whole series, which has at most 31 rows.
    whole = Window.partitionBy(F.lit(0))
    return series.select(
        "*",
        F.sum("pcs").over(whole).alias("total_pcs"),
        F.sum("revenue").over(whole).alias("total_revenue"),
        long_date(ntz(now)).alias("header"),
    )
