"""Labels, fallbacks and number input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from ..sources.schema import MONEY

# The label of a payment method in the order list.
PAYMENT_NAMES = {"cash": "Cash", "tf": "Transfer"}

# The label of a status in the order list.
STATUS_NAMES = {"process": "In Progress", "done": "Done"}

# What number input trims from both ends.
BLANKS = (
    " \t\n\r\f\u000b\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the notations of a decimal number.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def contains_text(column: Column, query: str) -> Column:
    """Literal substring search without regard to case. Null never matches."""
    return F.contains(F.lower(column), F.lower(F.lit(query)))


def status_label(status: Column) -> Column:
    """Done for done; In Progress for anything else and for null."""
    return F.when(status == "done", F.lit("Done")).otherwise(F.lit("In Progress"))


def dash_if_blank(column: Column) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("-"))


def empty_if_null(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def payment_code(method: Column) -> Column:
    """Upper case, with a dash for a missing method."""
    return dash_if_blank(F.upper(method))


def _named(column: Column, names: dict[str, str]) -> Column:
    label = F.lit(None).cast("string")
    for value, name in names.items():
        label = F.when(column == value, F.lit(name)).otherwise(label)
    return label


def payment_name(method: Column) -> Column:
    """Cash or Transfer; null for any other value."""
    return _named(method, PAYMENT_NAMES)


def status_name(status: Column) -> Column:
    """In Progress or Done in the order list; null for any other value."""
    return _named(status, STATUS_NAMES)


def number_from_text(text: Column, kind: DataType = MONEY) -> Column:
    """Number input: blank or missing text is 0, text that is no number is null.

    Blank text and ordinary numbers are settled first, without trimming. A failed cast is
    dear, so only text that looks like a number in another notation (3.0, 1e2) is cast again.
    """
    zero = F.lit(0).cast(kind)
    bare = F.btrim(text, F.lit(BLANKS))
    number = bare.try_cast(kind)
    if isinstance(kind, IntegralType):
        exact = bare.try_cast("decimal(38,6)")
        number = F.when(exact == F.floor(exact), exact.try_cast(kind))
    other = F.when(bare == "", zero).when(bare.rlike(NUMBER), number)
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    return F.when(blank, zero).otherwise(F.coalesce(text.try_cast(kind), other))
