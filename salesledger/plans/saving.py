"""Form input on its way into the tables: numbers, prices, times, checks, rows or changes.

A form row holds text as it was typed, and the id it is saved under. Rows that the tables
could not take are returned beside the accepted ones with a reason, never dropped silently. New rows need an id that is
neither stored nor given twice; edits need a seq, and two different edits of a row under one seq are refused.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from ..functions.dates import expense_instant, iso_day, order_instant
from ..functions.text import number_from_text
from ..operators.changes import clashing, refuse_clashes
from ..operators.ingest import product_form_problem, refuse_taken, with_defaults
from ..operators.lookup import priced
from ..sources.schema import conform, ntz


def _is_null(column: str, reason: str) -> Column:
    return F.when(F.col(column).isNull(), F.lit(reason))


def _no_date(text: str, instant: str, reason: str) -> Column:
    """A date was typed that cannot be read."""
    return F.when((F.coalesce(F.col(text), F.lit("")) != "") & F.col(instant).isNull(), F.lit(reason))


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and ids of the others with a reason."""
    good = rows.where(F.col("reason").isNull()).drop("reason")
    return good, rows.where(F.col("reason").isNotNull()).select("id", "reason")


def _edits(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edits of judged forms with their seq, and (seq, id, reason) of the others."""
    rows = rows.withColumn("reason", F.coalesce("reason", _is_null("seq", "seq is null")))
    content = F.xxhash64(*[c for c in columns if c != "total_price"])  # which follows from the others
    rows = refuse_clashes(rows, clashing(rows, content))
    good = rows.where(F.col("reason").isNull()).select("seq", "id", *columns)
    return good, rows.where(F.col("reason").isNotNull()).select("seq", "id", "reason")


def judged_orders(forms: DataFrame, products: DataFrame, open_dates: DataFrame | None = None) -> DataFrame:
    """Order forms with typed values, the total from the product price, and a reason, null for a form that can be saved.

    An order without a product costs its shipping fee. created_at is null where no date was chosen. With
    open_dates, a chosen date has to be one of them. A caller who needs both halves can store this frame and split it.
    """
    typed = forms.select(
        *[name for name in ("seq", "id") if name in forms.columns],
        "customer_name",
        F.when(F.col("product_id").isNotNull(), F.col("product_id").try_cast(LongType())).alias("product_id"),
        F.col("product_id").alias("_product_text"),
        number_from_text(F.col("quantity"), IntegerType()).alias("quantity"),
        "payment_method",
        number_from_text(F.col("shipping_fee")).alias("shipping_fee"),
        "notes",
        "status",
        F.col("order_date").alias("_date_text"),
        order_instant(F.nullif(F.col("order_date"), F.lit(""))).alias("created_at"),
    )
    product = F.col("product_id")
    rows = priced(typed, products, strict=False).withColumn("total_price", F.col("computed_total"))
    closed = F.lit(None).cast("string")
    if open_dates is not None:
        days = open_dates.select(F.col("date").alias("_open")).distinct()
        rows = rows.join(days, iso_day(F.col("created_at")) == F.col("_open"), "left")
        closed = F.when(F.col("created_at").isNotNull() & F.col("_open").isNull(), F.lit("order_date is not open"))
    problem = F.coalesce(
        _is_null("id", "id is null"),
        _is_null("customer_name", "customer_name is missing"),
        F.when(F.col("_product_text").isNotNull() & product.isNull(), "product_id is no number"),
        _is_null("quantity", "quantity is no whole number"),
        _is_null("shipping_fee", "shipping_fee is no number"),
        _no_date("_date_text", "created_at", "order_date is no date"),
        F.when(product.isNotNull() & F.col("unit_price").isNull(), "product does not exist"),
        _is_null("computed_total", "total is too large"),
        closed,
    )
    return rows.withColumn("reason", problem)


def save_orders(
    forms: DataFrame, products: DataFrame, now: datetime, open_dates: DataFrame | None = None, stored: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """New order rows, and the refused forms. Without a date an order gets the time of the write. stored: the orders
    whose ids are taken."""
    accepted, refused = _halves(refuse_taken(judged_orders(forms, products, open_dates), stored))
    dated = accepted.withColumn("created_at", F.coalesce(F.col("created_at"), ntz(now)))
    return conform(dated, "orders"), refused


ORDER_EDIT = [
    "customer_name", "product_id", "quantity", "total_price", "payment_method", "shipping_fee", "notes", "status", "created_at",
]


def order_edits(forms: DataFrame, products: DataFrame, open_dates: DataFrame | None = None) -> DataFrame:
    """Typed edits that rewrite an order from its form (see changes.apply_rows); seq is taken from the forms.

    The total follows today's product price. The stored time stays unless a date was chosen.
    """
    return _edits(judged_orders(forms, products, open_dates), ORDER_EDIT)[0]


def order_edits_refused(forms: DataFrame, products: DataFrame, open_dates: DataFrame | None = None) -> DataFrame:
    """(seq, id, reason) of the forms that order_edits leaves out."""
    return _edits(judged_orders(forms, products, open_dates), ORDER_EDIT)[1]


def judged_expenses(forms: DataFrame, tz: str = "UTC") -> DataFrame:
    """Expense forms with typed values and a reason. price is the total of the row as typed."""
    rows = forms.select(
        *[name for name in ("seq", "id") if name in forms.columns],
        "name",
        number_from_text(F.col("amount"), IntegerType()).alias("amount"),
        number_from_text(F.col("price")).alias("price"),
        "notes",
        F.col("expense_date").alias("_date_text"),
        expense_instant(F.nullif(F.col("expense_date"), F.lit("")), tz).alias("created_at"),
    )
    problem = F.coalesce(
        _is_null("id", "id is null"),
        _is_null("name", "name is missing"),
        _is_null("amount", "amount is no whole number"),
        _is_null("price", "price is no number"),
        _no_date("_date_text", "created_at", "expense_date is no date"),
    )
    return rows.withColumn("reason", problem)


def save_expenses(
    forms: DataFrame, now: datetime, tz: str = "UTC", stored: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """New expense rows, and the refused forms."""
    accepted, refused = _halves(refuse_taken(judged_expenses(forms, tz), stored))
    dated = accepted.withColumn("created_at", F.coalesce(F.col("created_at"), ntz(now)))
    return conform(dated.withColumn("category", F.lit(None).cast("string")), "expenses"), refused


def expense_edits(forms: DataFrame, tz: str = "UTC") -> DataFrame:
    """Typed edits of expenses. The stored time stays unless a date was chosen; the category is not on the form."""
    return _edits(judged_expenses(forms, tz), EXPENSE_EDIT)[0]


EXPENSE_EDIT = ["name", "amount", "price", "notes", "created_at"]


def expense_edits_refused(forms: DataFrame, tz: str = "UTC") -> DataFrame:
    """(seq, id, reason) of the forms that expense_edits leaves out."""
    return _edits(judged_expenses(forms, tz), EXPENSE_EDIT)[1]


def judged_products(forms: DataFrame) -> DataFrame:
    """Product forms with a price and a reason. The form itself asks for a name and a price."""
    rows = forms.withColumn("price", number_from_text(F.col("price_text")))
    problem = F.coalesce(
        _is_null("id", "id is null"),
        product_form_problem(F.col("name"), F.col("price_text")),
        _is_null("price", "price is no number"),
    )
    return rows.withColumn("reason", problem)


def save_products(forms: DataFrame, now: datetime, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New product rows, and the refused forms."""
    accepted, refused = _halves(refuse_taken(judged_products(forms), stored))
    return with_defaults(accepted, "products", now), refused


def product_edits(forms: DataFrame) -> DataFrame:
    """Typed edits of products: what the form has, and nothing else."""
    return _edits(judged_products(forms), _product_edit(forms))[0]


def _product_edit(forms: DataFrame) -> list[str]:
    return ["name", "price", *[c for c in ("description",) if c in forms.columns]]


def product_edits_refused(forms: DataFrame) -> DataFrame:
    """(seq, id, reason) of the forms that product_edits leaves out."""
    return _edits(judged_products(forms), _product_edit(forms))[1]
