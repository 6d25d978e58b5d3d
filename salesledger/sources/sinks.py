"""Report outputs: one folder of CSV files per sheet, and their names."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_stamp
from .schema import ntz

# Fixed value: a sheet title holds at most this many characters.
SHEET_TITLE_LENGTH = 31


def list_file_name(table: str, period_name: str) -> str:
    """orders + This Month -> orders_this_month"""
    return f"{table}_{period_name.lower().replace(' ', '_')}"


def report_file_name(period_label: str) -> str:
    """Mar 2026 -> report_Mar_2026"""
    return f"report_{period_label.replace(' ', '_')}"


def list_title(table: str, period_name: str) -> str:
    return f"{table.capitalize()} — {period_name}"


def report_title(period_label: str) -> str:
    return f"Financial Report — {period_label}"


def sheet_title(title: str) -> str:
    return title[:SHEET_TITLE_LENGTH]


def write_sheet(df: DataFrame, folder: str, mode: str = "errorifexists", in_order: bool = False) -> None:
    """Write columns under a header row; a null becomes an empty cell.

    Every partition writes its own file, and the files in name order hold the sheet in order: numbered rows are
    sorted by their number, unless they come in order already. A frame of lines is written without a header.
    """
    lines = "line" in df.columns
    if lines:
        df = df.orderBy("line").coalesce(1).drop("line", "rows")
    elif "#" in df.columns and not in_order:
        df = df.orderBy("#")
    (
        df.write.mode(mode)
        .option("header", not lines)
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )


def head_lines(counted: DataFrame, title: str, now: datetime) -> DataFrame:
    """The two lines above a printed grid, title and day of printing, with the number of rows below them. counted has
    that number in its one row."""
    stamp = F.concat(F.lit("Generated: "), day_stamp(ntz(now)))
    lines = [F.struct(F.lit(i).alias("line"), text.alias("text")) for i, text in ((1, F.lit(title)), (2, stamp))]
    return counted.select(F.inline(F.array(*lines)), "rows")


def write_report(sections: Mapping[str, DataFrame], folder: str, period_label: str) -> str:
    """Write each section, its rows in order, as a sheet under one report folder and return that folder."""
    target = f"{folder.rstrip('/')}/{report_file_name(period_label)}"
    for title, rows in sections.items():
        write_sheet(rows, f"{target}/{sheet_title(title)}", in_order=True)
    return target
