"""Money columns and their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the space between the currency sign and the digits is U+00A0.
NO_BREAK_SPACE = "\u00a0"


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def net_revenue(total: str = "total_price", fee: str = "shipping_fee") -> Column:
    """What an order earns without its shipping fee."""
    return F.col(total) - or_zero(F.col(fee))


def rupiah(amount: Column) -> Column:
    """Rp 15.000 with a no-break space: whole rupiah, dots between groups, null and NaN as 0.
    An amount beyond 24 digits raises."""
    known = F.when(~F.isnan(amount.cast("double")), amount)
    whole = F.round(or_zero(known.cast("decimal(30,6)")), 0)
    digits = F.replace(F.format_number(F.abs(whole), 0), F.lit(","), F.lit("."))
    sign = F.when(whole < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("Rp" + NO_BREAK_SPACE), digits)


def product_label(name: Column, price: Column) -> Column:
    """name — Rp 15.000,5: plain space, up to three decimals."""
    digits = F.call_function("format_number", price, F.lit("#,##0.###"))
    return F.concat(name, F.lit(" — Rp "), F.translate(digits, ",.", ".,"))
