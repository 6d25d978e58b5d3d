"""Search of the two lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_text


def search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column holds the query. Empty text matches every row that is not null."""
    return df.where(contains_text(F.col(column), query))
