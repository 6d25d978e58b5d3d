from __future__ import annotations

from datetime import timedelta
from decimal import Decimal

import pytest
from conftest import at
from salesledger.operators import lookup, ordering


def test_embedded_product(make):
    joined = lookup.with_product(
        make.orders({"product_id": 1}, {"product_id": None}, {"product_id": 9}),
        make.products({"name": "Box", "price": 15000}),
    )
    found = {r.id: r.product for r in joined.collect()}
    assert found[1].name == "Box" and found[1].price == 15000
    assert found[2] is None and found[3] is None


def test_missing_product_counts_as_zero(make):
    rows = lookup.priced(
        make.orders(
            {"product_id": 1, "quantity": 3, "shipping_fee": 5000},
            {"product_id": None, "quantity": 3, "shipping_fee": 5000},
            {"product_id": 9, "quantity": 3, "shipping_fee": None},
        ),
        make.products({"price": 15000}),
    )
    assert sorted((r.id, r.subtotal, r.computed_total) for r in rows.collect()) == [
        (1, 45000, 50000), (2, 0, 5000), (3, 0, 0),
    ]


def test_references(make):
    orders = make.orders({"product_id": 1}, {"product_id": None}, {"product_id": 9})
    products = make.products({}, {})
    assert [r.id for r in lookup.orphans(orders, products).collect()] == [3]
    assert [r.id for r in lookup.deletable(products, orders).collect()] == [2]


def test_open_date_membership(make):
    orders = make.orders(
        {"created_at": "2026-03-07 00:00:00"}, {"created_at": "2026-03-08 00:00:00"},
        {"created_at": "2026-03-06 20:00:00"}, {"created_at": None},
    )
    dates = make.dates("2026-03-07")
    assert [r.id for r in lookup.on_open_date(orders, dates).collect()] == [1]
    in_zone = lookup.on_open_date(orders, dates, "Asia/Jakarta").collect()
    assert sorted(r.id for r in in_zone) == [1, 3]


def test_null_order_and_ties(make):
    orders = make.orders(
        {"created_at": "2026-01-01"}, {"created_at": None}, {"created_at": "2026-02-01"},
        {"created_at": "2026-02-01"}, {"created_at": None},
    )
    assert [r.id for r in ordering.latest_first(orders).collect()] == [5, 2, 4, 3, 1]
    assert [r.id for r in ordering.oldest_first(orders).collect()] == [1, 3, 4, 2, 5]
    assert [r.id for r in ordering.latest(orders, 2).collect()] == [5, 2]
    dates = make.dates("2026-02-01", "2026-01-01")
    assert [r.date for r in ordering.dates_ascending(dates).collect()] == ["2026-01-01", "2026-02-01"]


def test_ordinals_over_several_partitions(make, setting, monkeypatch):
    """A third of the rows share one time and a few have none; numbers still have no gap."""
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(ordering, "ID_RUN", 100)
    monkeypatch.setattr(ordering, "CELL_ROWS", 50)
    start = at("2026-01-01")
    times = [
        start if i % 3 == 0 else None if i % 50 == 1 else start + timedelta(minutes=i * 7919 % 5000)
        for i in range(3000)
    ]
    orders = make.orders(*[{"created_at": t} for t in times]).repartition(5)
    numbered = ordering.with_ordinal(orders.select("id", "created_at"))
    assert numbered.rdd.getNumPartitions() > 1
    rows = sorted(numbered.collect(), key=lambda r: r.no)
    expected = sorted(
        ((t is None, t or start, i) for i, t in enumerate(times, 1)),
        key=lambda x: (x[0], x[1], x[2]), reverse=True,
    )
    assert [(r.no, r.id) for r in rows] == [(n, x[2]) for n, x in enumerate(expected, 1)]
    # Rows of one time were spread, not sent to one task.
    sizes = numbered.rdd.glom().map(len).collect()
    assert max(sizes) < 1000


@pytest.mark.parametrize("rows_in_a_cell", [1 << 20, 40, 1])
def test_ordinals_inside_a_second(spark, setting, monkeypatch, rows_in_a_cell):
    """Microseconds, ties and ids far apart: a later row with a low id comes before an earlier one with a high id."""
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(ordering, "CELL_ROWS", rows_in_a_cell)
    monkeypatch.setattr(ordering, "HOT_SHARE", 1 << 30)
    rows = [(1, at("2026-01-01 10:00:00.9"), "a"), (2_000_000, at("2026-01-01 10:00:00.1"), "b"), (None, at("2026-01-01 10:00:00.1"), "c")]
    rows += [(i << 19, at("2026-01-02 00:00:00.5"), "hot") for i in range(-150, 150)]
    rows += [(1000 + i, at("2026-01-02 00:00:00") + timedelta(microseconds=i * 7919 % 3), "near") for i in range(200)]
    rows += [(5000 + i, at("1969-12-31 23:59:59") + timedelta(microseconds=i * 104729 % 1_000_000), "old") for i in range(200)]
    rows += [(9000 + i, None, "never") for i in range(60)]
    rows += [(20_000 + i, at("2026-01-03") + timedelta(seconds=i * 37 % 90, microseconds=i % 2), "spread") for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, `odd {name}` string").repartition(7)
    low = -(1 << 62)
    latest = sorted(rows, key=lambda r: (r[1] is None, r[1] or at("1900-01-01"), low if r[0] is None else r[0]), reverse=True)
    expected = [(n, *r) for n, r in enumerate(latest, 1)]
    assert sorted(tuple(r) for r in ordering.with_ordinal(frame).collect()) == expected
    in_order = ordering.with_ordinal(frame, in_order=True)
    assert [tuple(r) for r in in_order.collect()] == expected  # collect keeps the order of partitions
    window = frame.selectExpr("row_number() over (order by created_at desc nulls first, id desc) as no", "*")
    assert sorted(tuple(r) for r in window.collect()) == expected


def test_full_cells_are_bounded_by_their_share(spark, monkeypatch):
    """A cell of many rows is left whole where there are more rows still; the number of cut cells has a bound."""
    monkeypatch.setattr(ordering, "CELL_ROWS", 1)
    monkeypatch.setattr(ordering, "HOT_SHARE", 4)
    frame = spark.range(2000).selectExpr("id", "timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(cast(id % 40 as int), 0, 0, id % 7) as created_at")
    rows = sorted(ordering.with_ordinal(frame).collect())
    assert [r.no for r in rows] == list(range(1, 2001))
    assert [(r.created_at, r.id) for r in rows] == sorted(((r.created_at, r.id) for r in rows), reverse=True)


def test_ordinals_of_nothing(make):
    assert ordering.with_ordinal(make.orders().limit(0)).collect() == []
    assert ordering.with_ordinal(make.orders().limit(0), in_order=True).collect() == []


def test_hot_product_is_split(make, spark, setting):
    """Half of the orders name one product and many name none: the merge join splits them."""
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }.items():
        setting(key, value)
    hot = spark.range(0, 60000, 1, 8).selectExpr(
        "id",
        "case when id % 2 = 0 then 7L when id % 5 = 0 then null else id % 1000 end as product_id",
        "cast(id % 4 as int) as quantity",
        "cast(1000 as decimal(18,2)) as shipping_fee",
    )
    products = make.products(*[{"id": i, "price": i} for i in range(900)])
    joined = lookup.priced(hot, products)
    got = {r.id: r.computed_total for r in joined.select("id", "computed_total").collect()}
    plan = joined._jdf.queryExecution()
    joined.collect()
    assert "skew=true" in plan.executedPlan().toString()
    for i in range(60000):
        product = 7 if i % 2 == 0 else None if i % 5 == 0 else i % 1000
        price = product if product is not None and product < 900 else 0
        assert got[i] == Decimal(price * (i % 4) + 1000)
