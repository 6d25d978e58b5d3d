"""Key figures: one aggregate each, folded on the map side before the small shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import net_revenue, or_zero


def total(column: Column) -> Column:
    """Sum that is 0 over no rows."""
    return or_zero(F.sum(column))


def dashboard_kpis(orders: DataFrame) -> DataFrame:
    """Pieces sold and revenue without shipping."""
    return orders.agg(
        total(F.col("quantity")).alias("pcs"),
        total(net_revenue()).alias("revenue"),
    )


def order_list_kpis(orders: DataFrame) -> DataFrame:
    """Pieces, shipping and gross revenue. Here revenue includes shipping."""
    return orders.agg(
        total(F.col("quantity")).alias("quantity"),
        total(F.col("shipping_fee")).alias("shipping"),
        total(F.col("total_price")).alias("gross_revenue"),
    )


def expense_list_kpis(expenses: DataFrame) -> DataFrame:
    """Number of rows and money spent. price is already the total of its row."""
    return expenses.agg(
        F.count("*").alias("items"),
        total(F.col("price")).alias("total"),
    )


def money_flows(orders: DataFrame, expenses: DataFrame) -> DataFrame:
    """Both facts under one shape: created_at, revenue, expenses and two row marks.

    Aggregating the union takes one pass and one shuffle, with no join of two results.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    sold = orders.select(
        "created_at",
        net_revenue().alias("revenue"),
        zero.alias("expenses"),
        F.lit(1).alias("is_order"),
        F.lit(0).alias("is_expense"),
    )
    spent = expenses.select(
        "created_at",
        zero.alias("revenue"),
        F.col("price").alias("expenses"),
        F.lit(0).alias("is_order"),
        F.lit(1).alias("is_expense"),
    )
    return sold.unionByName(spent)


def report_totals(flows: DataFrame) -> DataFrame:
    """Revenue, expenses, profit and its sign."""
    return (
        flows.agg(total(F.col("revenue")).alias("revenue"), total(F.col("expenses")).alias("expenses"))
        .withColumn("profit", F.col("revenue") - F.col("expenses"))
        .withColumn("outcome", F.when(F.col("profit") >= 0, "profit").otherwise("loss"))
    )


def report_counts(flows: DataFrame) -> DataFrame:
    """Rows of the two detail sections."""
    return flows.agg(
        total(F.col("is_order")).alias("order_rows"),
        total(F.col("is_expense")).alias("expense_rows"),
    )
