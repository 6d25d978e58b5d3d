"""Batches of inserts, updates and deletes applied to a table.

A change has seq, id, op (insert, update or delete) and patch, a map from column
name to text. A change that the table could not take (no id or seq, another op, an unknown column, a value that
cannot be read, null where the table forbids it, a product that does not exist, the delete of a product that orders name, two
different changes of an id under one seq) is not applied; refused_changes gives it with a reason. Ids are identities: an
insert brings a new id, and a deleted id does not
come back. Giving an id that exists to an insert changes the row, so a batch may be
applied again after a failure with the same result. The result never hangs on the order of a feed's rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import TABLES, default_value
from .ingest import patch_problem, typed
from .lookup import priced

# What the changes of one id come to; the highest of them decides.
UPDATED, INSERTED, DELETED = 0, 1, 2


def said() -> Column:
    """A hash of what a change says, whatever the order of its columns."""
    patch = F.when(F.col("op") != "delete", F.sort_array(F.map_entries("patch")))
    return F.xxhash64("op", patch)


def clashing(rows: DataFrame, content: Column) -> DataFrame:
    """(_id, _seq) under which rows say different things; rows that only repeat do not clash. Every task folds its own rows
    first, so a change that is sent very often is no hot key."""
    seen = rows.groupBy("id", "seq").agg(F.min(content).alias("_low"), F.max(content).alias("_high"))
    return seen.where(F.col("_low") != F.col("_high")).select(F.col("id").alias("_id"), F.col("seq").alias("_seq"))


def same_place() -> Column:
    return (F.col("id") == F.col("_id")) & (F.col("seq") == F.col("_seq"))


def refuse_clashes(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """Rows (id, seq, reason) with a reason also where they clash."""
    met = rows.join(clashes, same_place(), "left")
    twice = F.when(F.col("_id").isNotNull(), F.lit("seq is given twice"))
    return met.withColumn("reason", F.coalesce("reason", twice)).drop("_id", "_seq")


def folded(feed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per id: the last value given for each column and what happened to the row.

    A column holds a one-field struct, null if no change names it, so that a null
    given on purpose differs from a column left out. Each task folds its own part of an
    id's changes before the shuffle, so an id with very many changes is no hot key.
    Accepted changes of an id have a seq of their own, so their order is never open.
    """
    last = [
        F.max_by(
            F.struct(F.try_element_at("patch", F.lit(name)).alias("value")),
            F.when(F.map_contains_key("patch", name), F.col("seq")),
        ).alias(name)
        for name in columns
    ]
    fate = F.when(F.col("op") == "delete", DELETED).when(F.col("op") == "insert", INSERTED).otherwise(UPDATED)
    return feed.groupBy("id").agg(F.max(fate).alias("_fate"), *last)


def checked(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows with _key, the id that a row is checked by or null, and _met, the same id if ids (one column) have it.

    Rows without a key meet nothing, yet as nulls they would all go to one task: they are dealt by their seq and id. The
    join asks for two equal columns, which the distinct ids are not dealt by, so both sides get an exchange of their own
    and AQE can split a hot id.
    """
    known = ids.toDF("_met").distinct()
    place = F.coalesce(F.col("_key"), F.xxhash64("seq", "id"))
    return rows.withColumn("_key", key).join(known, (place == F.col("_met")) & (F.col("_key") == F.col("_met")), "left")


OPS = ("insert", "update", "delete")


def judged(
    feed: DataFrame, table: str, names: list[str] | None = None, products: DataFrame | None = None, orders: DataFrame | None = None
) -> DataFrame:
    """The feed with a reason, null for a change that the table could take by itself.

    With products, a change of an order has to name one of them or none. With orders, a product that they name
    cannot be deleted. Ids on the checking side are made distinct before they are shuffled.
    """
    op, rows = F.col("op"), feed
    patch = patch_problem(table, F.col("patch"), op == "insert", names)
    reason = (
        F.when(F.col("id").isNull(), "id is null")
        .when(F.col("seq").isNull(), "seq is null")
        .when(~F.coalesce(op.isin(*OPS), F.lit(False)), "unknown op")
        .when(op != "delete", patch)
    )
    if table == "orders" and products is not None:
        wanted = F.when(op != "delete", typed(F.try_element_at("patch", F.lit("product_id")), TABLES[table]["product_id"].dataType))
        rows = checked(rows, wanted, products.select("id"))
        reason = F.coalesce(reason, F.when(F.col("_key").isNotNull() & F.col("_met").isNull(), "product does not exist"))
    if table == "products" and orders is not None:
        rows = checked(rows, deleted_id(), named_products(orders))
        reason = F.coalesce(reason, F.when(F.col("_met").isNotNull(), NAMED))
    return rows.withColumn("reason", reason).select(*feed.columns, "reason")


def refused_changes(feed: DataFrame, table: str, names: list[str] | None = None, **against: DataFrame | None) -> DataFrame:
    """The changes that apply_changes leaves out, and why; against: products or orders, as in judged."""
    rows = refuse_clashes(judged(feed, table, names, **against), clashing(feed, said()))
    return rows.where(F.col("reason").isNotNull()).select("seq", "id", "op", "reason")


def accepted_changes(feed: DataFrame, table: str, names: list[str] | None = None, **against: DataFrame | None) -> DataFrame:
    rows = judged(feed, table, names, **against).where(F.col("reason").isNull()).drop("reason")
    return rows.join(clashing(feed, said()), same_place(), "left_anti")


NAMED = "orders name this product"


def deleted_id() -> Column:
    return F.when(F.col("op") == "delete", F.col("id"))


def named_products(orders: DataFrame) -> DataFrame:
    return orders.select("product_id").where(F.col("product_id").isNotNull())


def split_deletes(feed: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes to products that may be applied, and deletes of products that orders name, with a reason.

    The products that orders name are made distinct first, so a hot product is sent once by each task.
    """
    met = checked(feed, deleted_id(), named_products(orders))
    kept = met.where(F.col("_met").isNull()).select(*feed.columns)
    return kept, met.where(F.col("_met").isNotNull()).select("seq", "id", F.lit(NAMED).alias("reason"))


def apply_rows(snapshot: DataFrame, edits: DataFrame, table: str) -> DataFrame:
    """The snapshot with the last edit of each id over it.

    An edit has seq, id and typed columns of the table. A column that edits lack keeps its stored value, and so
    does created_at where an edit has none. Edits of unknown ids change nothing. Edits are in the order of seq, then of
    their content.
    """
    names = [n for n in TABLES[table].names if n in edits.columns and n != "id"]
    place = F.struct(F.col("seq"), F.xxhash64(*names))
    last = edits.groupBy("id").agg(F.max_by(F.struct(*names), place).alias("_new"))
    new = {n: F.col(f"_new.{n}") for n in names}
    if "created_at" in new:
        new["created_at"] = F.coalesce(new["created_at"], F.col("created_at"))
    rows = snapshot.join(last, "id", "left")
    return rows.select(*[
        F.when(F.col("_new").isNotNull(), new[n]).otherwise(F.col(n)).alias(n) if n in new else F.col(n)
        for n in snapshot.columns
    ])


def apply_changes(
    snapshot: DataFrame, feed: DataFrame, table: str, now: datetime, columns: list[str] | None = None,
    products: DataFrame | None = None, orders: DataFrame | None = None,
) -> DataFrame:
    """The snapshot after the feed. products and orders are what the feed is checked against (see judged).

    The snapshot meets the folded feed in a left join, so a feed small enough to
    be broadcast never makes Spark shuffle the snapshot. New rows are added
    by a union; both sides read the same columns of the fold, so its shuffle is run once.
    Updates and deletes of unknown ids change nothing.
    """
    names = [n for n in (columns or TABLES[table].names) if n != "id"]
    accepted = accepted_changes(feed, table, names, products=products, orders=orders)
    return merged(snapshot, accepted, table, now, names, feed)


def merged(
    snapshot: DataFrame, feed: DataFrame, table: str, now: datetime, names: list[str], arriving: DataFrame | None = None
) -> DataFrame:
    """The snapshot after a feed of accepted changes. arriving: changes among which are all inserts of the feed, if
    they are cheaper to read than the feed."""
    schema = TABLES[table]
    changes = folded(feed, names)

    def value(name: str):
        return typed(F.col(f"c.{name}.value"), schema[name].dataType)

    kept = (
        snapshot.alias("s")
        .join(changes.alias("c"), F.col("s.id") == F.col("c.id"), "left")
        .where(F.coalesce(F.col("c._fate"), F.lit(UPDATED)) != DELETED)
        .select(
            F.col("s.id"),
            *[
                F.when(F.col(f"c.{n}").isNotNull(), value(n)).otherwise(F.col(f"s.{n}")).alias(n)
                for n in names
            ],
        )
    )
    inserts = (feed if arriving is None else arriving).where(F.col("op") == "insert").select("id")
    present = snapshot.select("id").join(inserts, "id", "left_semi")
    added = (
        changes.where(F.col("_fate") == INSERTED)
        .join(present, "id", "left_anti")
        .alias("c")
        .select(
            F.col("c.id"),
            *[
                F.when(F.col(f"c.{n}").isNotNull(), value(n))
                .otherwise(default_value(table, n, now))
                .alias(n)
                for n in names
            ],
        )
    )
    return kept.unionByName(added)


def repriced(orders: DataFrame, products: DataFrame, feed: DataFrame) -> DataFrame:
    """Orders that the feed updates, with the total worked out anew from today's price."""
    edited = accepted_changes(feed, "orders").where(F.col("op") == "update").select("id").distinct()
    return priced(orders.join(edited, "id", "left_semi"), products)


def apply_both(
    orders: DataFrame, products: DataFrame, order_feed: DataFrame, product_feed: DataFrame, now: datetime
) -> tuple[DataFrame, DataFrame]:
    """Orders and products after a feed for each. Products change first: a delete stays out where a stored order names the
    product, and changes of orders are checked against the products that are left, new ones included; so no order ends
    with a product that does not exist."""
    left = apply_changes(products, product_feed, "products", now, orders=orders)
    return apply_changes(orders, order_feed, "orders", now, products=left), left
