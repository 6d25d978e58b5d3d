"""Stored tables that change: merges by month, batches, newest months, day sums, the search index and staged figures."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from conftest import at
from pyspark.sql import functions as F
from salesledger.operators import changes, ordering, periods, search_index
from salesledger.operators.metrics import dashboard_kpis, order_list_kpis
from salesledger.operators.search import search
from salesledger.plans import dashboard, financial, merging
from salesledger.sources import tables

NOW = datetime(2026, 6, 10, 9)


def parts(folder):
    """Data files by month."""
    return {m.name.partition("=")[2]: sorted(p.name for p in m.glob("*.parquet")) for m in Path(folder).glob(f"{tables.MONTH}=*")}


def files_of(frame):
    """The files that the rows of a frame lie in."""
    return {r[0] for r in frame.select(F.input_file_name()).distinct().collect()}


def plan_of(frame):
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("id", "customer_name", "status", "quantity", "created_at").collect()), key=str)


@pytest.fixture
def stored(make, tmp_path):
    rows = [{"created_at": f"2026-{m:02d}-{d:02d} 12:00:00", "quantity": m} for m in range(1, 6) for d in (3, 20)]
    orders = make.orders(*rows, {"created_at": None})
    folder = str(tmp_path / "orders")
    tables.append_rows(orders, folder)
    return orders, folder


def test_merge_rewrites_touched_months_only(spark, make, stored):
    orders, folder = stored
    before = parts(folder)
    feed = make.feed(
        (1, 3, "update", {"status": "done"}),  # February
        (2, 5, "delete", None), (3, 6, "delete", None),  # all of March
        (4, 7, "update", {"created_at": "2025-12-31 23:00:00"}),  # April to a month that is new
        (5, 50, "insert", {"customer_name": "New"}),  # the month of now
        (6, 77, "update", {"status": "done"}), (7, 1, "update", {"quantity": "many"}),  # unknown, refused
    )
    merge = merging.merge_changes(spark, folder, "orders", feed, NOW)
    assert set(merge.months) == {"2026-02", "2026-03", "2026-04", "2025-12", "2026-06"}
    assert [r.seq for r in merge.refused.collect()] == [7]
    after = parts(folder)
    for month in ("2026-01", "2026-05", tables.NO_MONTH):
        assert after[month] == before[month]
    assert "2026-03" not in after and {"2025-12", "2026-06"} <= after.keys() and after["2026-02"] != before["2026-02"]
    expected = rows_of(changes.apply_changes(orders, feed, "orders", NOW))
    assert rows_of(tables.read_table(spark, folder, "orders")) == expected
    log = sorted((r.sign, r.id) for r in merge.log.collect())
    assert log == [(-1, 3), (-1, 5), (-1, 6), (-1, 7), (1, 3), (1, 7), (1, 50)]
    again = merging.merge_changes(spark, folder, "orders", feed, NOW)
    assert rows_of(tables.read_table(spark, folder, "orders")) == expected
    assert sum(r.sign * r.quantity for r in again.log.collect()) == 0


def test_merge_of_rows_without_a_time_and_of_nothing(spark, make, stored):
    orders, folder = stored
    before = parts(folder)
    feed = make.feed((1, 11, "update", {"status": "done"}), (2, 1, "update", {"created_at": None}))
    merge = merging.merge_changes(spark, folder, "orders", feed, NOW)
    assert set(merge.months) == {None, "2026-01"}
    assert rows_of(tables.read_table(spark, folder, "orders")) == rows_of(changes.apply_changes(orders, feed, "orders", NOW))
    merging.merge_changes(spark, folder, "orders", make.feed((1, 11, "delete", None), (1, 1, "delete", None)), NOW)
    assert tables.NO_MONTH not in parts(folder)
    middle = parts(folder)
    nothing = merging.merge_changes(spark, folder, "orders", make.feed((1, 999, "delete", None)).limit(0), NOW)
    assert nothing.months == [] and nothing.log.count() == 0 and parts(folder) == middle
    assert before["2026-05"] == middle["2026-05"]


def test_touched_months_read_ids_only(spark, make, stored):
    table = tables.read_table(spark, stored[1], "orders")
    plan = table.select("id", tables.MONTH).join(make.feed((1, 1, "delete", None)).select("id"), "id", "left_semi")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    kept = tables.in_months(table, ["2026-02", None])
    assert re.search(r"PartitionFilters: \[.*created_month", plan_of(kept)) and len(files_of(kept)) == 2


def test_day_sums_follow_a_merge(spark, make, tmp_path):
    """Key figures from day sums equal those over the rows, also around the ends of closed periods, in a zone, after two merges."""
    r = random.Random(3)
    ends = [timedelta(0), timedelta(milliseconds=-400), timedelta(microseconds=-500), timedelta(seconds=-1), timedelta(seconds=-1, microseconds=1), timedelta(milliseconds=-1)]
    times = [at("2026-03-01") + timedelta(days=r.randrange(-3, 40)) + r.choice(ends) for _ in range(250)] + [None] * 3
    rows = [{"created_at": t, "quantity": r.randrange(9), "total_price": r.randrange(900), "shipping_fee": r.choice([None, 5])} for t in times]
    folder = str(tmp_path / "orders")
    tables.append_rows(make.orders(*rows), folder)
    for tz in ("UTC", "Asia/Jakarta"):
        sums = str(tmp_path / f"days-{tz[:3]}")
        merging.write_day_sums(merging.day_sums(tables.read_table(spark, folder, "orders"), tz), sums)
        for step in range(2):
            feed = make.feed(
                *[(i, i, "delete", None) for i in range(step + 1, 60, 7)],
                *[(500 + i, i, "update", {"quantity": str(i % 5), "created_at": f"2026-03-{i % 28 + 1:02d} 23:59:59.5"}) for i in range(60, 120, 3 + step)],
                (900, 1000 + step, "insert", {"customer_name": "n", "created_at": "2026-03-31 23:59:59", "total_price": "77"}),
            )
            merge = merging.merge_changes(spark, folder, "orders", feed, NOW)
            merging.write_day_sums(merging.day_sums(merge.log, tz), sums)
        table = tables.read_table(spark, folder, "orders")
        day = at("2026-03-11 08:00")
        for period in (periods.today(day), periods.this_week(day), periods.month(2026, 3), periods.year(2026), periods.month(2026, 3).exclusive(), None):
            found = merging.kpis_of_days(merging.read_day_sums(spark, sums), period)
            kept = periods.filter_period(table, period, tz)
            one, two, n = dashboard_kpis(kept).first(), order_list_kpis(kept).first(), kept.count()
            assert tuple(found.first()) == (n, one.pcs, one.revenue, two.shipping, two.gross_revenue)
            assert all("/days-" in f for f in found.inputFiles())


def test_batches_are_appended_once(spark, make, tmp_path):
    folder = str(tmp_path / "orders")
    batch = make.orders({"created_at": "2026-01-01"}, {"created_at": "2026-02-01"})
    assert tables.append_batch(batch, folder, "orders", "b-1") and not tables.append_batch(batch, folder, "orders", "b-1")
    assert tables.read_table(spark, folder, "orders").count() == 2
    with pytest.raises(ValueError, match="ids are taken: \\[2\\]"):
        tables.append_batch(make.orders({"id": 2}, {"id": 3}), folder, "orders", "b-2")
    with pytest.raises(ValueError, match="doubled ids: \\[5\\]"):
        tables.append_batch(make.orders({"id": 5}, {"id": 5}), folder, "orders", "b-3")
    with pytest.raises(ValueError, match="no name"):
        tables.append_batch(batch, folder, "orders", "../b")
    assert tables.read_table(spark, folder, "orders").count() == 2
    # A writer that was lost after a part of its rows: the ledger has a beginning and no end.
    spark.range(1).write.parquet(f"{folder}/{tables.LEDGER}/b-4.begun")
    rest = make.orders({"id": 8, "created_at": "2026-01-05"}, {"id": 9, "created_at": "2026-03-05"})
    tables.append_rows(rest.where("id = 8"), folder)
    assert tables.append_batch(rest, folder, "orders", "b-4")
    assert sorted(r.id for r in tables.read_table(spark, folder, "orders").collect()) == [1, 2, 8, 9]


def test_newest_months(spark, stored):
    orders, folder = stored
    table = tables.read_table(spark, folder, "orders")
    for count, months in ((1, 1), (2, 2), (3, 2), (4, 3), (100, 6)):
        part = tables.newest_months(spark, folder, "orders", count)
        assert len({f.split(tables.MONTH + "=")[1].split("/")[0] for f in files_of(part)}) == months
        assert re.search(r"PartitionFilters: \[.*created_month", plan_of(part))
        assert [r.id for r in ordering.latest(part, count).collect()] == [r.id for r in ordering.latest(table, count).collect()]
    assert tables.months_of(spark, folder) == [None, "2026-05", "2026-04", "2026-03", "2026-02", "2026-01"]


@pytest.fixture
def indexed(spark, make, tmp_path):
    r = random.Random(9)
    names = ["Ani Wijaya", "ANI", "budi", "B%n_d", "Štěpán", "ab", "", None, "aaaa", "İnci", "日本語テキスト", "x y  z"]
    rows = [{"customer_name": r.choice(names), "created_at": f"2026-{r.randrange(1, 9):02d}-05"} for _ in range(300)]
    rows += [{"customer_name": "Zulu Only", "created_at": "2026-08-09"}, {"customer_name": "Ani Wijaya", "created_at": None}]
    spark_rows = [(i, d.get("customer_name"), at(d["created_at"])) for i, d in enumerate(rows)]
    frame = spark.createDataFrame(spark_rows, "id long, customer_name string, created_at timestamp_ntz")
    folder = str(tmp_path / "names")
    tables.write_table(frame, folder)
    table = spark.read.schema(f"id long, customer_name string, created_at timestamp_ntz, {tables.MONTH} string").parquet(folder)
    search_index.write_index(table, "customer_name", str(tmp_path / "index"))
    return table, str(tmp_path / "index")


@pytest.mark.parametrize("query", ["", "a", "an", "ani", "ANI W", "%n_", "aaa", "aaaaa", "štěp", "本語テ", "zulu", "none at all", "y  z", "nci"])
def test_indexed_search_finds_the_same(indexed, query):
    table, folder = indexed
    found = search_index.search_indexed(table, "customer_name", query, folder)
    assert sorted(map(str, found.collect())) == sorted(map(str, search(table, "customer_name", query).collect()))


def test_indexed_search_reads_few_rows(indexed):
    """The months to read come from the index, and of the index only the buckets of the text are opened."""
    table, folder = indexed
    found = search_index.search_indexed(table, "customer_name", "zulu", folder)
    assert "dynamicpruning" in plan_of(found)
    names = search_index.found_names(table.sparkSession, folder, "zulu")
    assert re.search(r"PartitionFilters: \[bucket", plan_of(names)) and "In(piece" in plan_of(names)
    assert [(r[0], r[1]) for r in names.collect()] == [("2026-08", "Zulu Only")]


def test_staged_figures_read_their_facts_once(spark, make, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counting(frame):
        def run(batches):
            for batch in batches:
                read.add(len(batch))
                yield batch

        return frame.mapInPandas(run, frame.select("total_price", "shipping_fee", "quantity", "created_at").schema)

    rows = [{"created_at": f"2026-03-{d:02d}", "total_price": 10 * d, "quantity": d, "shipping_fee": 1} for d in range(1, 21)]
    orders = counting(make.orders(*rows).select("total_price", "shipping_fee", "quantity", "created_at"))
    expenses = make.expenses({"created_at": "2026-03-09", "price": 30})
    plain = financial.financial_report(orders, expenses, periods.month(2026, 3))
    expected = [plain.totals.collect(), plain.series.collect()]
    assert read.value == 40
    report = financial.financial_report(orders, expenses, periods.month(2026, 3), stage=True)
    assert [report.totals.collect(), report.series.collect()] == expected and read.value == 60
    assert expected[0][0].revenue == sum(10 * d - 1 for d in range(1, 21))
    named = orders.selectExpr("*", "1L as id", "'n' as customer_name", "'s' as status")
    page = dashboard.dashboard(named, make.dates(), at("2026-03-10"), stage=True)
    assert page.kpis.first().pcs == 210 and len(page.series.collect()) == 31 and read.value == 80
