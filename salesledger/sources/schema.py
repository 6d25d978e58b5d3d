"""The four tables: column types, required columns and write defaults."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(18, 2)

# created_at holds UTC in every table.
PRODUCTS = StructType([
    StructField("id", LongType(), False),
    StructField("name", StringType(), False),
    StructField("price", MONEY, False),
    StructField("description", StringType()),
    StructField("created_at", TimestampNTZType()),
])

ORDERS = StructType([
    StructField("id", LongType(), False),
    StructField("customer_name", StringType(), False),
    StructField("product_id", LongType()),
    StructField("quantity", IntegerType(), False),
    StructField("total_price", MONEY, False),
    StructField("payment_method", StringType()),
    StructField("shipping_fee", MONEY),
    StructField("notes", StringType()),
    StructField("status", StringType()),
    StructField("created_at", TimestampNTZType()),
])

EXPENSES = StructType([
    StructField("id", LongType(), False),
    StructField("name", StringType(), False),
    StructField("amount", IntegerType(), False),
    StructField("price", MONEY, False),
    StructField("category", StringType()),
    StructField("notes", StringType()),
    StructField("created_at", TimestampNTZType()),
])

OPEN_DATES = StructType([
    StructField("id", LongType(), False),
    StructField("date", StringType(), False),
    StructField("created_at", TimestampNTZType()),
])

TABLES = {
    "products": PRODUCTS,
    "orders": ORDERS,
    "expenses": EXPENSES,
    "open_dates": OPEN_DATES,
}

# What a column holds when a new row leaves it out.
# created_at gets the time of the write, every other absent column is null.
DEFAULTS = {
    "products": {"price": "0"},
    "orders": {
        "quantity": "1",
        "total_price": "0",
        "payment_method": "cash",
        "shipping_fee": "0",
        "status": "process",
    },
    "expenses": {"amount": "1", "price": "0"},
    "open_dates": {},
}


def required(table: str) -> list[str]:
    """Columns that must not be null."""
    return [f.name for f in TABLES[table].fields if not f.nullable]


def ntz(moment: datetime) -> Column:
    """A timestamp literal without a zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def default_value(table: str, column: str, now: datetime) -> Column:
    """The value of a column that a new row leaves out."""
    kind = TABLES[table][column].dataType
    if column == "created_at":
        return ntz(now)
    return F.lit(DEFAULTS[table].get(column)).cast(kind)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast any DataFrame (file, catalog table, JDBC read) to a table's columns."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])
