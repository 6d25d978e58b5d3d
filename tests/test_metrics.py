from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import at
from salesledger.operators import metrics, periods, series
from salesledger.plans.dashboard import dashboard, dashboard_overview
from salesledger.plans.financial import financial_report, flows_of


def test_two_meanings_of_revenue(make):
    orders = make.orders(
        {"total_price": 20000, "shipping_fee": 5000, "quantity": 2},
        {"total_price": 10000, "shipping_fee": None, "quantity": 1},
    )
    net = metrics.dashboard_kpis(orders).first()
    gross = metrics.order_list_kpis(orders).first()
    assert (net.pcs, net.revenue) == (3, 25000)
    assert (gross.quantity, gross.shipping, gross.gross_revenue) == (3, 5000, 30000)
    assert net.revenue + gross.shipping == gross.gross_revenue


def test_expense_price_is_a_total(make):
    row = metrics.expense_list_kpis(make.expenses({"amount": 10, "price": 500}, {"amount": 2, "price": 70})).first()
    assert (row["items"], row.total) == (2, 570)


def test_empty_period(make):
    orders, expenses = make.orders().limit(0), make.expenses().limit(0)
    month = periods.month(2026, 2)
    kpis = metrics.dashboard_kpis(orders).first()
    assert (kpis.pcs, kpis.revenue) == (0, 0)
    report = financial_report(orders, expenses, month)
    totals = report.totals.first()
    assert (totals.revenue, totals.expenses, totals.profit, totals.outcome) == (0, 0, 0, "profit")
    assert [(r.name, r.revenue, r.expenses) for r in report.series.collect()] == [
        (f"W{i}", 0, 0) for i in range(1, 5)
    ]


@pytest.mark.parametrize(("year", "month", "days", "weeks"), [(2026, 2, 28, 4), (2024, 2, 29, 5), (1998, 8, 31, 5)])
def test_series_lengths(make, year, month, days, weeks):
    period = periods.month(year, month)
    last = f"{period.end:%Y-%m-%d} 12:00:00"
    orders = make.orders({"created_at": last, "total_price": 100})
    expenses = make.expenses({"created_at": last, "price": 30})
    daily = series.revenue_series(orders, period).collect()
    assert [r.name for r in daily] == [str(d) for d in range(1, days + 1)]
    assert daily[-1].revenue == 100
    weekly = series.report_series(flows_of(orders, expenses, period), period).collect()
    assert [r.name for r in weekly] == [f"W{w}" for w in range(1, weeks + 1)]
    assert (weekly[-1].revenue, weekly[-1].expenses) == (100, 30)


def test_year_series_names_every_month(make):
    orders = make.orders({"created_at": "2026-03-31 20:00:00", "total_price": 100})
    year = periods.year(2026)
    rows = {r.name: r.revenue for r in series.revenue_series(orders, year).collect()}
    assert len(rows) == 12
    assert rows["Mar"] == 100
    shifted = {r.name: r.revenue for r in series.revenue_series(orders, year, "Asia/Jakarta").collect()}
    assert shifted["Mar"] == 0 and shifted["Apr"] == 100


def test_loss(make):
    flows = flows_of(
        make.orders({"created_at": "2026-03-01", "total_price": 10}),
        make.expenses({"created_at": "2026-03-02", "price": 25}),
        periods.month(2026, 3),
    )
    row = metrics.report_totals(flows).first()
    assert (row.profit, row.outcome) == (-15, "loss")
    counts = metrics.report_counts(flows).first()
    assert (counts.order_rows, counts.expense_rows) == (1, 1)


def test_series_add_up_to_the_totals(make):
    rows = [
        {"created_at": f"2026-03-{d:02d} 0{d % 10}:00:00", "total_price": Decimal(d * 100), "shipping_fee": Decimal(d), "quantity": d}
        for d in range(1, 32)
    ]
    orders = make.orders(*rows, {"created_at": None, "total_price": 7})
    month = periods.month(2026, 3)
    sold = periods.filter_period(orders, month)
    kpis = metrics.dashboard_kpis(sold).first()
    assert sum(r.revenue for r in series.revenue_series(sold, month).collect()) == kpis.revenue
    overview = dashboard_overview(orders, at("2026-03-10 09:00:00")).collect()
    assert {(r.total_pcs, r.total_revenue) for r in overview} == {(kpis.pcs, kpis.revenue)}
    assert overview[0].header == "Tuesday, 10 March 2026"


def test_dashboard_parts(make):
    orders = make.orders(*[{"created_at": f"2026-0{m}-10", "total_price": 100, "quantity": m} for m in range(1, 8)])
    page = dashboard(orders, make.dates("2026-03-03"), at("2026-03-10 09:00:00"), "year")
    assert page.kpis.first().pcs == 28
    assert page.series.count() == 12
    # The latest orders do not depend on the period.
    assert [r.id for r in page.recent.collect()] == [7, 6, 5, 4, 3]
    assert [r.day for r in page.calendar.where("is_open").collect()] == [3]
