from __future__ import annotations

import random
from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import at
from pyspark.sql import functions as F
from salesledger.operators import calendar, changes, ingest, periods
from salesledger.plans import saving
from salesledger.sources.schema import TABLES

NOW = datetime(2026, 3, 10, 9)


def test_calendar(make):
    grid = calendar.month_grid(make.dates("2026-02-03", "2026-02-03", "2026-03-01"), periods.month(2026, 2), at("2026-02-14"))
    rows = grid.collect()
    assert len(rows) == 28
    assert (rows[0].weekday, rows[0].grid_row) == (0, 0)
    assert [r.date for r in rows if r.is_open] == ["2026-02-03"]
    assert [r.date for r in rows if r.is_today] == ["2026-02-14"]
    assert Counter(r.style for r in rows) == {"plain": 26, "open": 1, "today": 1}


def test_calendar_rows_and_open_today(make):
    rows = calendar.month_grid(make.dates("2026-08-31"), periods.month(2026, 8), at("2026-08-31")).collect()
    assert rows[0].weekday == 6 and rows[0].grid_row == 0 and rows[1].grid_row == 1
    assert rows[30].grid_row == 5 and rows[30].style == "open"


def test_toggles(make):
    base = make.dates("2026-02-01", "2026-02-02")
    toggles = make.dates("2026-02-02", "2026-02-03", "2026-02-04", "2026-02-04")
    assert sorted(r.date for r in calendar.toggled(base, toggles, datetime(2026, 3, 1)).collect()) == ["2026-02-01", "2026-02-03"]
    twice = calendar.toggled(calendar.toggled(base, toggles, datetime(2026, 3, 1)), toggles, datetime(2026, 3, 1))
    assert twice.columns == ["id", "date", "created_at"]
    assert sorted(r.date for r in twice.collect()) == ["2026-02-01", "2026-02-02"]


def test_unique_rule(make):
    dates = make.dates("2026-02-02", "2026-02-01", "2026-02-02")
    assert sorted((r.id, r.date) for r in calendar.unique_dates(dates).collect()) == [
        (1, "2026-02-02"), (2, "2026-02-01"),
    ]
    assert [(r.date, r.copies) for r in calendar.duplicates(dates).collect()] == [("2026-02-02", 2)]


def test_changes(make):
    snapshot = make.orders(
        {"customer_name": "a", "status": "process"}, {"customer_name": "b", "status": "process"},
        {"customer_name": "c", "status": "done"},
    )
    feed = make.feed(
        (1, 1, "update", {"status": "done"}), (2, 1, "update", {"notes": None}), (3, 3, "delete", None),
        (4, 4, "insert", {"customer_name": "d", "created_at": None}), (5, 4, "update", {"status": "done"}),
        (6, 9, "update", {"status": "done"}), (7, 8, "delete", {}),
        (8, 2, "update", {"quantity": " 4 ", "total_price": "12.5", "shipping_fee": None, "created_at": "2026-01-02 03:04:05"}),
    )
    after = changes.apply_changes(snapshot, feed, "orders", NOW)
    assert after.schema.names == TABLES["orders"].names
    assert [f.dataType for f in after.schema] == [f.dataType for f in TABLES["orders"]]
    rows = {r.id: r for r in after.collect()}
    assert {i: (r.customer_name, r.status) for i, r in rows.items()} == {
        1: ("a", "done"), 2: ("b", "process"), 4: ("d", "done"),
    }
    assert (rows[2].quantity, rows[2].total_price, rows[2].shipping_fee) == (4, Decimal("12.50"), None)
    assert rows[2].created_at == at("2026-01-02 03:04:05")
    assert rows[1].created_at is None  # left out of the patch: unchanged
    assert (rows[4].quantity, rows[4].payment_method, rows[4].shipping_fee) == (1, "cash", 0)
    assert rows[4].created_at is None  # given as null


def test_new_rows_get_the_time_of_the_write(make):
    feed = make.feed((1, 5, "insert", {"customer_name": "d"}))
    row = changes.apply_changes(make.orders().limit(0), feed, "orders", NOW).first()
    assert row.created_at == NOW and row.status == "process"


def brute_force(snapshot: dict, feed: list) -> dict:
    rows = {i: dict(r) for i, r in snapshot.items()}
    for _, id_, op, patch in sorted(feed, key=lambda change: change[0]):
        if op == "delete":
            rows.pop(id_, None)
        elif op == "insert":
            rows[id_] = {"status": "process", "notes": None, **patch}
        elif id_ in rows:
            rows[id_].update(patch)
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_changes_against_one_by_one(make, setting, seed, broadcast):
    """A third of the changes hit one order; each change is applied in turn by the check."""
    setting("spark.sql.autoBroadcastJoinThreshold", broadcast)
    pick = random.Random(seed)
    snapshot = {i: {"status": pick.choice(["process", "done", None]), "notes": None} for i in range(40)}
    feed, alive, next_id = [], set(snapshot), 1000
    for seq in range(600):
        id_ = 7 if seq % 3 == 0 else pick.choice([*sorted(alive), 5000])
        op = pick.choices(["update", "insert", "delete"], [8, 2, 1 if id_ != 7 else 0])[0]
        patch = {k: pick.choice(["x", "", None, str(seq)]) for k in ("status", "notes") if pick.random() < 0.6}
        if op == "insert":
            id_, next_id = next_id, next_id + 1
            alive.add(id_)
        elif op == "delete":
            alive.discard(id_)
            patch = None
        feed.append((seq, id_, op, patch))
    shuffled = feed[:]
    pick.shuffle(shuffled)
    table = make.orders(*[{"id": i, **r} for i, r in snapshot.items()]).select("id", "status", "notes")
    after = changes.apply_changes(table, make.feed(*shuffled).repartition(6), "orders", NOW, ["status", "notes"])
    got = {r.id: {"status": r.status, "notes": r.notes} for r in after.collect()}
    assert got == brute_force(snapshot, feed)
    # A batch that is applied again after a failure changes nothing more.
    again = changes.apply_changes(after, make.feed(*shuffled), "orders", NOW, ["status", "notes"])
    repeated = {r.id: {"status": r.status, "notes": r.notes} for r in again.collect()}
    assert repeated == got
    unchanged = changes.apply_changes(table, make.feed(*shuffled).limit(0), "orders", NOW, ["status", "notes"])
    assert sorted(unchanged.collect()) == sorted(table.collect())


def test_reprice_only_what_was_edited(make):
    orders = make.orders({"product_id": 1, "quantity": 2, "total_price": 1}, {"product_id": 1, "total_price": 1})
    feed = make.feed((1, 1, "update", {}), (2, 1, "update", {}), (3, 2, "delete", None))
    rows = changes.repriced(orders, make.products({"price": 500}), feed).collect()
    assert [(r.id, r.total_price, r.computed_total) for r in rows] == [(1, 1, 1000)]


def test_defaults(spark, make):
    given = spark.createDataFrame([(1, "Ani", None)], "id long, customer_name string, shipping_fee string")
    row = ingest.with_defaults(given, "orders", NOW).first()
    assert row.shipping_fee is None  # given as null
    assert (row.quantity, row.total_price, row.payment_method, row.status, row.created_at) == (1, 0, "cash", "process", NOW)


def test_missing_required(spark):
    rows = spark.createDataFrame([(1, None), (2, "a")], "id long, date string")
    good, bad = ingest.split(rows, ingest.missing_required("open_dates"))
    assert [r.id for r in good.collect()] == [2]
    assert [(r.id, r.reason) for r in bad.collect()] == [(1, "date is null")]


ORDER_FORM = (
    "id long, customer_name string, product_id string, quantity string, shipping_fee string, "
    "payment_method string, notes string, status string, order_date string"
)


def order_forms(spark):
    return spark.createDataFrame(
        [
            (11, "Ani", "1", "2", "", "cash", "", "process", ""),
            (12, "Budi", None, "2", "5000", "tf", "x", "done", "2026-03-07"),
            (13, "Cici", "77", "1", "0", "tf", "", "done", ""),
            (14, "Dodi", "", "1", "0", "tf", "", "done", ""),
            (15, "Edi", "1", "2.5", "0", "tf", "", "done", ""),
            (16, "Feri", "1", "", "free", "tf", "", "done", ""),
            (17, "Gani", "1", "", None, "tf", None, "done", None),
        ],
        ORDER_FORM,
    )


def test_saving_orders(spark, make):
    products = make.products({"price": 15000})
    rows, refused = saving.save_orders(order_forms(spark), products, NOW)
    found = {r.id: r for r in rows.collect()}
    assert {i: (r.quantity, r.total_price, r.shipping_fee) for i, r in found.items()} == {
        11: (2, 30000, 0), 12: (2, 5000, 5000), 17: (0, 0, 0),
    }
    assert found[11].created_at == NOW and found[12].created_at == at("2026-03-07")
    assert {r.id: r.reason for r in refused.collect()} == {
        13: "product does not exist",
        14: "product_id is no number",
        15: "quantity is no whole number",
        16: "shipping_fee is no number",
    }


def test_editing_orders(spark, make):
    products = make.products({"price": 15000})
    stored = make.orders(
        *[{"id": i, "product_id": 1, "total_price": 1, "notes": "old", "created_at": "2026-01-01"} for i in range(11, 14)]
    )
    edits = saving.order_edits(order_forms(spark).withColumn("seq", F.col("id")), products)
    rows = {r.id: r for r in changes.apply_rows(stored, edits, "orders").collect()}
    assert (rows[11].total_price, rows[11].notes, rows[11].created_at) == (30000, "", at("2026-01-01"))
    assert (rows[12].product_id, rows[12].total_price, rows[12].created_at) == (None, 5000, at("2026-03-07"))
    assert (rows[13].total_price, rows[13].notes) == (1, "old")  # its form was refused
    assert sorted(rows) == [11, 12, 13]


def test_saving_expenses_and_products(spark):
    forms = spark.createDataFrame(
        [(1, "Flour", "2", "7000", "2026-03-07", ""), (2, "Oil", "1", "", "", None), (3, "Gas", "x", "1", "", "")],
        "id long, name string, amount string, price string, expense_date string, notes string",
    )
    rows, refused = saving.save_expenses(forms, NOW, "Asia/Jakarta")
    assert sorted((r.id, r.amount, r.price, r.created_at) for r in rows.collect()) == [
        (1, 2, 7000, at("2026-03-07 05:00:00")), (2, 1, 0, NOW),
    ]
    assert [(r.id, r.reason) for r in refused.collect()] == [(3, "amount is no whole number")]
    products = spark.createDataFrame(
        [(1, "Box", "15000", "d"), (2, "", "1", None), (3, "Cup", "", None), (4, "Can", "abc", None)],
        "id long, name string, price_text string, description string",
    )
    rows, refused = saving.save_products(products, NOW)
    assert [(r.id, r.name, r.price, r.description, r.created_at) for r in rows.collect()] == [(1, "Box", 15000, "d", NOW)]
    assert {r.id: r.reason for r in refused.collect()} == {
        2: "name is missing", 3: "price is missing", 4: "price is no number",
    }


def test_refused_changes(make):
    """Nothing that the table forbids is written, and every refusal has a reason."""
    snapshot = make.orders({"customer_name": "a"}, {"customer_name": "b"})
    bad = [
        (1, None, "update", {"status": "done"}), (None, 1, "update", {"status": "done"}), (3, 1, "DELETE", None), (4, 1, None, None),
        (5, 1, "update", {"colour": "red"}), (6, 1, "update", {"quantity": "abc"}), (7, 1, "update", {"customer_name": None}),
        (8, 5, "insert", {"notes": "x"}), (9, 1, "update", {"created_at": "2026-13-45"}), (10, 5, "insert", None),
    ]
    feed = make.feed(*bad, (11, 2, "update", {"status": "done"}))
    reasons = {r.seq: r.reason for r in changes.refused_changes(feed, "orders").collect()}
    assert reasons == {
        1: "id is null", None: "seq is null", 3: "unknown op", 4: "unknown op", 5: "unknown column colour", 6: "quantity cannot be read",
        7: "customer_name is null", 8: "customer_name is null", 9: "created_at cannot be read", 10: "customer_name is null",
    }
    after = sorted(changes.apply_changes(snapshot, feed, "orders", NOW).collect())
    assert [(r.id, r.customer_name, r.status) for r in after] == [(1, "a", "process"), (2, "b", "done")]
    assert ingest.from_patch(make.feed(*bad[7:8]), "orders", NOW).count() == 0
    assert [r.reason for r in ingest.refused_patches(make.feed(*bad[7:8]), "orders").collect()] == ["customer_name is null"]


def test_bad_dates_and_totals_are_refused(spark, make):
    products = make.products({"price": 99999999})
    forms = spark.createDataFrame(
        [
            (1, "A", "1", "1", "0", "tf", "", "done", "not a date"), (2, "A", "1", "1", "0", "tf", "", "done", "2026-13-45"),
            (3, "A", "1", "2147483647", "0", "tf", "", "done", ""), (4, "A", "1", "1", "0", "tf", "", "done", "2026-03-07"),
        ],
        ORDER_FORM,
    )
    rows, refused = saving.save_orders(forms, products, NOW)
    assert [r.id for r in rows.collect()] == [4]
    assert {r.id: r.reason for r in refused.collect()} == {1: "order_date is no date", 2: "order_date is no date", 3: "total is too large"}
    closed = saving.save_orders(forms, products, NOW, make.dates("2026-03-08"))[1]
    assert {r.id: r.reason for r in closed.collect()}[4] == "order_date is not open"
    expenses = spark.createDataFrame([(1, 1, "F", "1", "1", "31/12/2026", "")], "seq long, id long, name string, amount string, price string, expense_date string, notes string")
    assert saving.save_expenses(expenses, NOW)[1].first().reason == "expense_date is no date"


def test_products_that_orders_name_stay(make):
    feed = make.feed((1, 1, "delete", None), (2, 2, "delete", None), (3, 1, "update", {"name": "x"}))
    kept, refused = changes.split_deletes(feed, make.orders({"product_id": 1}, {"product_id": 1}, {"product_id": None}))
    assert sorted(r.seq for r in kept.collect()) == [2, 3]
    assert [(r.seq, r.reason) for r in refused.collect()] == [(1, "orders name this product")]


def test_parents_may_be_missing(spark, tmp_path):
    """Rows of a table do not hang on the columns chosen."""
    from salesledger.sources.mapped import MappedTables

    for name in ("orders", "lineitem", "customer", "part"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        key = {"customer": "c_custkey", "part": "p_partkey"}.get(name)
        (rows.where(f"{key} % 2 = 0") if key else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    t = MappedTables(spark, str(tmp_path))
    assert t.orders().count() == t.orders("id").count() == spark.read.parquet(f"{tmp_path}/orders.parquet").count()
    assert t.expenses().count() == t.expenses("id").count()
