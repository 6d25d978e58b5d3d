"""Changes and forms that a table must not take, and results that never hang on the order of rows."""

from __future__ import annotations

from datetime import datetime

import pytest
from salesledger.operators import changes
from salesledger.plans import saving

NOW = datetime(2026, 3, 10, 9)


def reasons(frame):
    return sorted((r.seq, r.id, r.reason) for r in frame.collect())


def test_clashing_changes_are_refused(make):
    """Changes of one id under one seq: different ones go, whatever their order; repeated ones count once."""
    snapshot = make.orders({"status": "a"}, {"status": "b"}, {"status": "c"})
    rows = [
        (1, 1, "update", {"status": "x"}), (1, 1, "update", {"status": "y"}),
        (1, 2, "update", {"status": "z", "notes": "n"}), (1, 2, "update", {"notes": "n", "status": "z"}),
        (2, 3, "update", {"status": "kept"}), (3, 3, "update", {"status": "p"}), (3, 3, "delete", None),
        (4, 2, "update", {"notes": "last"}),
    ]
    for feed in (make.feed(*rows), make.feed(*reversed(rows)).repartition(3)):
        refused = changes.refused_changes(feed, "orders")
        assert reasons(refused) == [(1, 1, "seq is given twice")] * 2 + [(3, 3, "seq is given twice")] * 2
        after = changes.apply_changes(snapshot, feed, "orders", NOW)
        assert sorted((r.id, r.status, r.notes) for r in after.collect()) == [(1, "a", None), (2, "z", "last"), (3, "kept", None)]


def test_a_refused_change_clashes_too(make):
    """What was meant under a seq is open where one of two changes cannot be read; each keeps its own reason."""
    feed = make.feed((1, 1, "update", {"status": "x"}), (1, 1, "update", {"colour": "red"}), (2, 1, "update", {"quantity": "many"}))
    found = [r[2] for r in reasons(changes.refused_changes(feed, "orders"))]
    assert found == ["seq is given twice", "unknown column colour", "quantity cannot be read"]
    assert changes.apply_changes(make.orders({}), feed, "orders", NOW).first().status == "process"


def test_unknown_products(make):
    """Products change first; what they leave is what orders may name."""
    orders = make.orders({"product_id": 1}, {"product_id": None}, {"product_id": 2})
    products = make.products({"name": "a"}, {"name": "b"}, {"name": "c"})
    product_feed = make.feed((1, 1, "delete", None), (2, 3, "delete", None), (3, 9, "insert", {"name": "new", "price": "5"}))
    order_feed = make.feed(
        (1, 1, "update", {"product_id": "9"}), (2, 2, "update", {"product_id": "3"}), (3, 2, "update", {"product_id": "999"}),
        (4, 3, "update", {"product_id": None}), (5, 7, "insert", {"customer_name": "n", "product_id": "999"}),
        (6, 8, "insert", {"customer_name": "n"}), (7, 1, "delete", {"product_id": "999"}),
    )
    order_feed = order_feed.where("seq < 7")
    after, left = changes.apply_both(orders, products, order_feed, product_feed, NOW)
    assert sorted((r.id, r.product_id) for r in after.collect()) == [(1, 9), (2, None), (3, None), (8, None)]
    assert sorted(r.id for r in left.collect()) == [1, 2, 9]
    refused = changes.refused_changes(order_feed, "orders", products=left)
    assert reasons(refused) == [(s, i, "product does not exist") for s, i in ((2, 2), (3, 2), (5, 7))]
    assert reasons(changes.refused_changes(product_feed, "products", orders=orders)) == [(1, 1, "orders name this product")]
    assert after.join(left, after.product_id == left.id, "left_anti").where("product_id is not null").count() == 0


def sizes(frame):
    return frame.rdd.glom().map(len).collect()


def merging_joins(setting):
    for key in ("autoBroadcastJoinThreshold", "adaptive.autoBroadcastJoinThreshold"):
        setting(f"spark.sql.{key}", "-1")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")


def test_changes_without_a_product_are_spread(spark, make, setting):
    """Most changes name no product, or one that cannot be read: they don't meet in one task, and keep their reasons."""
    merging_joins(setting)
    feed = spark.range(0, 8000, 1, 4).selectExpr(
        "id as seq", "id", "'update' as op",
        "map('product_id', case when id % 10 = 0 then cast(id % 7 as string) when id % 10 < 4 then 'abc' end) as patch",
    )
    judged = changes.judged(feed, "orders", products=make.products({"id": 1}, {"id": 2}, {"id": 2}, {"id": 3}))
    assert max(sizes(judged)) < 2000 and judged.count() == 8000
    reasons = {i: "product does not exist" for i in range(0, 8000, 10) if i % 7 not in (1, 2, 3)}
    reasons |= {i: "product_id cannot be read" for i in range(8000) if 0 < i % 10 < 4}
    assert {r.id: r.reason for r in judged.collect() if r.reason} == reasons


def test_product_changes_other_than_deletes_are_spread(spark, make, setting):
    """Very many updates of one product, and changes without an id, need no look at the orders."""
    merging_joins(setting)
    feed = spark.range(0, 8000, 1, 4).selectExpr(
        "id as seq", "case when id % 10 = 0 then id % 4 when id % 2 = 0 then 1L end as id",
        "if(id % 10 = 0 or id % 2 = 1, 'delete', 'update') as op", "map('name', 'x') as patch",
    )
    orders = make.orders({"product_id": 1}, {"product_id": 2}, {"product_id": 2}, {"product_id": None})
    judged = changes.judged(feed, "products", orders=orders)
    kept, refused = changes.split_deletes(feed, orders)
    assert max(sizes(judged)) < 2000 and max(sizes(kept)) < 2000
    named = {i for i in range(0, 8000, 10) if i % 4 in (1, 2)}
    assert {r.seq for r in judged.collect() if r.reason == "orders name this product"} == named
    assert sorted(r.seq for r in refused.collect()) == sorted(named)
    assert sorted(r.seq for r in kept.collect()) == sorted(set(range(8000)) - named)


def test_a_number_that_an_unchecked_change_is_dealt_by_meets_nothing(spark, make):
    """An id may equal the hash by which a change without one is dealt."""
    place = spark.sql("select xxhash64(5L, cast(null as bigint)) as h").first().h
    feed = make.feed((5, None, "delete", None))
    orders = make.orders({"product_id": place})
    assert [r[2] for r in changes.judged(feed, "products", orders=orders).select("seq", "id", "reason").collect()] == ["id is null"]
    assert changes.split_deletes(feed, orders)[1].count() == 0 and changes.split_deletes(feed, orders)[0].count() == 1


def test_hot_product_of_changes_is_split(spark, make, setting):
    merging_joins(setting)
    setting("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "10KB")
    feed = spark.range(0, 60000, 1, 8).selectExpr("id as seq", "id", "'update' as op", "map('product_id', if(id % 2 = 0, '7', cast(id % 1000 as string))) as patch")
    judged = changes.judged(feed, "orders", products=make.products(*[{"id": i} for i in range(900)]))
    plan = judged._jdf.queryExecution()
    assert sorted(r.id for r in judged.collect() if r.reason) == [i for i in range(60000) if i % 2 and i % 1000 >= 900]
    assert "skew=true" in plan.executedPlan().toString()


def form(spark, *rows):
    names = ["seq", "id", "customer_name", "product_id", "quantity", "payment_method", "shipping_fee", "notes", "status", "order_date"]
    plain = dict(seq=1, customer_name="Ani", product_id=None, quantity="1", payment_method="cash", shipping_fee="0", notes="", status="process", order_date="")
    made = [tuple((plain | row).get(n) for n in names) for row in rows]
    return spark.createDataFrame(made, "seq long, id long, " + ", ".join(f"{n} string" for n in names[2:]))


def test_taken_and_doubled_ids(spark, make):
    forms = form(spark, {"id": 1}, {"id": 2}, {"id": 2, "notes": "again"}, {"id": 3}, {"id": 4}, {"id": 4, "quantity": "many"}, {"id": None}, {"id": None})
    rows, refused = saving.save_orders(forms, make.products(), NOW, stored=make.orders({}, {}))
    assert sorted(r.id for r in rows.collect()) == [3, 4]
    found = sorted((r.id or 0, r.reason) for r in refused.collect())
    assert found == [(0, "id is null"), (0, "id is null"), (1, "id is taken"), (2, "id is taken"), (2, "id is taken"), (4, "quantity is no whole number")]
    rows, refused = saving.save_orders(forms, make.products(), NOW)
    assert sorted(r.id for r in rows.collect()) == [1, 3, 4]
    assert [r.reason for r in refused.where("id = 2").collect()] == ["id is given twice"] * 2
    expenses = spark.createDataFrame([(1, "a", "1", "2", "", ""), (5, "b", "1", "2", "", "")], "id long, name string, amount string, price string, notes string, expense_date string")
    assert [r.id for r in saving.save_expenses(expenses, NOW, stored=make.expenses({}))[0].collect()] == [5]
    products = spark.createDataFrame([(7, "a", "1"), (7, "b", "1"), (8, "c", "1")], "id long, name string, price_text string")
    assert [r.id for r in saving.save_products(products, NOW, stored=make.products({}))[0].collect()] == [8]


def test_edits_need_a_seq_of_their_own(spark, make):
    rows = [{"id": 1, "seq": None, "notes": "lost"}, {"id": 2, "seq": 4, "notes": "x"}, {"id": 2, "seq": 4, "notes": "y"}, {"id": 3, "seq": 5, "notes": "z"}, {"id": 3, "seq": 5, "notes": "z"}]
    stored = make.orders({"notes": "1"}, {"notes": "2"}, {"notes": "3"})
    for order in (rows, rows[::-1]):
        forms = form(spark, *order)
        edits = saving.order_edits(forms, make.products())
        assert sorted((r.id, r.notes) for r in changes.apply_rows(stored, edits, "orders").collect()) == [(1, "1"), (2, "2"), (3, "z")]
        refused = saving.order_edits_refused(forms, make.products())
        assert sorted((r.id, r.reason) for r in refused.collect()) == [(1, "seq is null")] + [(2, "seq is given twice")] * 2
    expenses = spark.createDataFrame([(None, 1, "a", "1", "2", "", "")], "seq long, id long, name string, amount string, price string, notes string, expense_date string")
    assert saving.expense_edits(expenses).count() == 0 and saving.expense_edits_refused(expenses).first().reason == "seq is null"
    products = spark.createDataFrame([(None, 1, "a", "1")], "seq long, id long, name string, price_text string")
    assert saving.product_edits(products).count() == 0 and saving.product_edits_refused(products).first().reason == "seq is null"


@pytest.mark.parametrize("turned", [False, True])
def test_edits_given_directly_fold_in_one_order(spark, make, turned):
    rows = [(1, 1, "x"), (1, 1, "y"), (None, 1, "z")]
    edits = spark.createDataFrame(rows[::-1] if turned else rows, "seq long, id long, notes string").coalesce(1)
    first = changes.apply_rows(make.orders({}), edits, "orders").first().notes
    other = changes.apply_rows(make.orders({}), spark.createDataFrame(sorted(rows, key=str), edits.schema), "orders").first().notes
    assert first == other and first in "xy"
