"""Joins of orders with products and open dates.

No side is marked for broadcast here, because products and open dates may grow with
the data. Spark broadcasts the side whose size it knows to be below
spark.sql.autoBroadcastJoinThreshold; beyond that it sorts and merges, and AQE splits a
hot product, date or null key over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_day, to_local
from ..functions.money import or_zero


def with_product(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Each order with its product as a nested column, null where it has none."""
    parent = products.select(
        F.col("id").alias("product_id"), F.struct("name", "price").alias("product")
    )
    return orders.join(parent, "product_id", "left")


def order_total(price: Column, quantity: Column, fee: Column) -> Column:
    """Price times quantity plus shipping; an unknown product counts as 0."""
    return or_zero(price * quantity) + or_zero(fee)


def priced(orders: DataFrame, products: DataFrame, strict: bool = True) -> DataFrame:
    """Orders with subtotal and total worked out from the current product price.

    A total that does not fit raises, or is null where the caller refuses such rows (strict=False).
    """

    def fit(amount: Column) -> Column:
        return amount.cast(money) if strict else amount.try_cast(money)

    prices = products.select(F.col("id").alias("product_id"), F.col("price").alias("unit_price"))
    money = "decimal(18,2)"
    return (
        orders.join(prices, "product_id", "left")
        .withColumn("subtotal", fit(or_zero(F.col("unit_price") * F.col("quantity"))))
        .withColumn(
            "computed_total",
            fit(order_total(F.col("unit_price"), F.col("quantity"), F.col("shipping_fee"))),
        )
    )


def on_open_date(orders: DataFrame, open_dates: DataFrame, tz: str = "UTC") -> DataFrame:
    """Orders whose day is an open date."""
    day = iso_day(to_local(F.col("created_at"), tz))
    return orders.join(open_dates.select("date"), day == F.col("date"), "left_semi")


def orphans(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Orders that name a product which does not exist."""
    known = products.select(F.col("id").alias("product_id"))
    return orders.where(F.col("product_id").isNotNull()).join(known, "product_id", "left_anti")


def deletable(products: DataFrame, orders: DataFrame) -> DataFrame:
    """Products that no order names.

    The ids are made distinct first: each task then sends a product once, however
    many orders it has, and no task gets all orders of a hot product.
    """
    used = orders.select(F.col("product_id").alias("id")).where(F.col("id").isNotNull()).distinct()
    return products.join(used, "id", "left_anti")
