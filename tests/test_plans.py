"""The shape of the plans: what reaches the scan, and what is never in a plan."""

from __future__ import annotations

import re

import pytest

from salesledger.plans.catalog import QUERIES, SINKS

FOLDER = "/root/testdata/sf0.001"


def plan_of(spark, name: str) -> str:
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(spark, name)
    assert not re.search(r"Python|Pandas|Arrow", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["orders_this_month", "dashboard_kpis_year", "revenue_by_day_in_zone", "report_by_week"])
def test_period_reaches_the_scan(spark, name):
    assert "GreaterThanOrEqual(o_orderdate" in plan_of(spark, name)


def test_top_rows_are_not_sorted_in_full(spark):
    plan = plan_of(spark, "recent_orders")
    assert "TakeOrderedAndProject" in plan and "Sort " not in plan


def test_only_needed_tables_and_columns_are_read(spark):
    plan = plan_of(spark, "revenue_by_day")
    assert plan.count("Scan parquet") == 2  # once in the tree, once in the details
    schema = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"}


@pytest.mark.parametrize("name", ["dashboard_kpis_month", "report_by_month", "deletable_products", "toggle_open_dates"])
def test_aggregates_fold_before_the_shuffle(spark, name):
    tree = plan_of(spark, name).split("\n\n")[0]
    assert re.search(r"HashAggregate[^\n]*\n[^\n]*Exchange[^\n]*\n[^\n]*HashAggregate", tree)


@pytest.mark.parametrize("name", ["order_ordinals", "export_orders_xls", "report_expense_sheet"])
def test_numbering_uses_no_single_task(spark, name):
    """A single partition only ever holds one count for each day."""
    tree = plan_of(spark, name).split("\n\n")[0]
    assert tree.count("SinglePartition") == 0 and "Checkpoint" not in tree
    details = plan_of(spark, name)
    single = re.findall(r"\((\d+)\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: SinglePartition", details)
    assert single and all(re.fullmatch(r"_day#\d+L, n#\d+L", columns) for _, columns in single)


def test_sheets_shuffle_their_rows_once(spark):
    """Wide rows meet the count of their cell, get their number and come out in order in one exchange."""
    from salesledger.plans import lists
    from salesledger.sources.mapped import MappedTables

    listed = lists.order_list(MappedTables(spark, FOLDER).orders("id", "customer_name", "total_price", "quantity", "payment_method", "shipping_fee", "notes", "status", "created_at"), None)
    for in_order, kind in ((False, "hashpartitioning"), (True, "rangepartitioning")):
        plan = lists.order_sheet(listed, in_order=in_order)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
        wide = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: (\w+)", plan)
        assert [k for columns, k in wide if "_start#" in columns and "notes" in columns] == [kind]


@pytest.mark.parametrize("name", ["expenses_today", "report_by_week", "report_expense_rows", "report_summary_month"])
def test_expense_period_reaches_the_scan(spark, name):
    assert "GreaterThanOrEqual(l_shipdate" in plan_of(spark, name)


def test_open_dates_of_a_month_reach_the_scan(spark):
    assert "GreaterThanOrEqual(o_orderdate" in plan_of(spark, "po_calendar")


@pytest.mark.parametrize("name", ["dashboard_kpis_month", "dashboard_overview", "order_list_kpis", "recent_orders"])
def test_line_items_are_picked_before_they_are_added_up(spark, name):
    logical = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    tree = logical[logical.index("l_quantity") :]
    assert re.search(r"Aggregate \[id#\d+L?\][^\n]*sum\(l_quantity[^\n]*\n(?:[^\n]*Project[^\n]*\n)?[^\n]*Join LeftSemi", logical), tree


def test_first_open_dates_fold_in_a_hash(spark):
    assert "SortAggregate" not in plan_of(spark, "unique_open_dates")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SINKS)))
def test_building_a_query_starts_no_job(spark, name):
    context = spark.sparkContext
    context.setJobGroup(f"build-{name}", name)
    try:
        QUERIES[name](spark, FOLDER)
        assert not context.statusTracker().getJobIdsForGroup(f"build-{name}")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
