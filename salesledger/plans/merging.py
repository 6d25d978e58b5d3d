"""A feed of changes merged into a stored table, month by month, and key figures kept up by what changed.

A merge rewrites the months that a feed touches and no other file. It leaves a log of the touched rows as they were (sign -1) and
as they are (sign +1). Day sums fold orders to one row for each day; adding the signed log of a merge keeps them right, so
that the key figures after a save cost as much as the change, not as much as the table.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import to_local
from ..functions.money import net_revenue, or_zero
from ..operators.changes import accepted_changes, merged, refused_changes
from ..operators.ingest import typed
from ..operators.metrics import total
from ..operators.periods import MILLISECOND, SECOND, Period
from ..session import drop_at_exit, drop_folder, shared_folder, staged
from ..sources.schema import TABLES
from ..sources.tables import MONTH, NO_MONTH, in_months, month_key, months_of, read_table, write_table


class Merge(NamedTuple):
    months: list[str | None]
    log: DataFrame
    refused: DataFrame


def touched_months(stored: DataFrame, feed: DataFrame, table: str, now: datetime) -> list[str | None]:
    """Months in which rows of the feed's ids lie, or may lie afterwards. Of the stored table only ids are read, and they are
    cut down to those of the feed before anything is shuffled."""
    old = stored.select("id", MONTH).join(feed.select("id"), "id", "left_semi").select(MONTH)
    written = feed.where(F.col("op") != "delete")
    given = F.coalesce(F.map_contains_key("patch", F.lit("created_at")), F.lit(False))
    time = typed(F.try_element_at("patch", F.lit("created_at")), TABLES[table]["created_at"].dataType)
    moved = written.where(given).select(month_key(time))
    made = written.where(~given & (F.col("op") == "insert")).select(F.lit(now.strftime("%Y-%m")))
    return [r[0] for r in old.unionAll(moved).unionAll(made).distinct().collect()]


def merge_changes(
    spark: SparkSession, folder: str, table: str, feed: DataFrame, now: datetime,
    products: DataFrame | None = None, orders: DataFrame | None = None,
) -> Merge:
    """Apply a feed to a stored table and rewrite only the months it touches.

    The new months are staged in the shared folder and then put in the place of the old ones; a month that loses all
    its rows loses its folder. Merging a feed again changes nothing, so a merge that failed is run again. One writer at a
    time, and a reader may meet a month while it is replaced.
    """
    stored = read_table(spark, folder, table)
    against = {"products": products, "orders": orders}
    accepted = staged(accepted_changes(feed, table, **against), "feed")
    refused = staged(refused_changes(feed, table, **against), "refused")
    months = touched_months(stored, accepted, table, now)
    names = TABLES[table].names
    before = in_months(stored, months).select(*names)
    stage = f"{shared_folder(spark)}/months-{uuid4().hex}"
    drop_at_exit(spark, stage)
    write_table(merged(before, accepted, table, now, names[1:]), stage, "overwrite")
    after = read_table(spark, stage, table)
    ids = accepted.select("id").distinct()

    def image(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(*names).join(ids, "id", "left_semi").select(F.lit(sign).alias("sign"), *names)

    log = staged(image(before, -1).unionByName(image(after, 1)), "log")
    kept = months_of(spark, stage)
    if kept:
        write_table(after.select(*names), folder, "overwrite")
    for month in set(months) & set(months_of(spark, folder)) - set(kept):
        drop_folder(spark, f"{folder.rstrip('/')}/{MONTH}={NO_MONTH if month is None else month}")
    return Merge(months, log, refused)


def _lateness(local: Column) -> Column:
    """0 up to the last second of a day, 1 inside it, 2 in its last millisecond: where closed periods end."""
    rest = F.date_add(F.to_date(local), 1).cast("timestamp_ntz") - local
    return F.when(rest >= F.expr("interval 1 second"), 0).when(rest >= F.expr("interval '0.001' second"), 1).otherwise(2)


def day_sums(orders: DataFrame, tz: str = "UTC") -> DataFrame:
    """Sums of orders, or of a signed log of them, for each day on the wall; orders without a time have no day."""
    local = to_local(F.col("created_at"), tz)
    sign = F.col("sign") if "sign" in orders.columns else F.lit(1)
    measures = {
        "orders": sign, "pcs": sign * F.col("quantity"), "revenue": sign * net_revenue(),
        "shipping": sign * or_zero(F.col("shipping_fee")), "gross": sign * F.col("total_price"),
    }
    sums = [F.sum(m).cast("bigint" if n in ("orders", "pcs") else "decimal(38,2)").alias(n) for n, m in measures.items()]
    late = F.when(F.col("created_at").isNotNull(), _lateness(local)).cast("int")
    return orders.groupBy(F.to_date(local).alias("day"), late.alias("late")).agg(*sums)


def write_day_sums(sums: DataFrame, folder: str) -> None:
    """Add day sums to a folder of them: once for a whole table, then for the log of each merge."""
    sums.coalesce(1).write.mode("append").parquet(folder)


def read_day_sums(spark: SparkSession, folder: str) -> DataFrame:
    sums = "orders bigint, pcs bigint, revenue decimal(38,2), shipping decimal(38,2), gross decimal(38,2)"
    return spark.read.schema(f"day date, late int, {sums}").parquet(folder)


def kpis_of_days(sums: DataFrame, period: Period | None) -> DataFrame:
    """What dashboard_kpis and order_list_kpis give for a period, from day sums alone."""
    if period is not None:
        first, last = period.start.date(), (period.following - timedelta(days=1)).date()
        most = {SECOND: 0, MILLISECOND: 1}.get(period.gap, 2)
        ends = (F.col("day") < F.lit(last)) | (F.col("late") <= most)
        sums = sums.where(F.col("day").between(F.lit(first), F.lit(last)) & ends)
    names = ("orders", "pcs", "revenue", "shipping", "gross")
    return sums.agg(*[total(F.col(n)).alias(n) for n in names])
