"""New rows: number input, defaults and the split of rows that cannot be taken."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType

from ..functions.text import number_from_text
from ..sources.schema import DEFAULTS, TABLES, default_value, required


def typed(text: Column, kind: DataType) -> Column:
    """Text of a change or form value in the type of its column; null stays null."""
    if isinstance(kind, StringType):
        return text
    if isinstance(kind, NumericType):
        return F.when(text.isNotNull(), number_from_text(text, kind))
    return text.try_cast(kind)


def with_defaults(df: DataFrame, table: str, now: datetime) -> DataFrame:
    """Complete rows of a DataFrame that lacks some columns; given nulls stay null."""
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else default_value(table, f.name, now)).alias(f.name)
        for f in TABLES[table].fields
    ])


def patch_problem(table: str, values: Column, new: Column, names: list[str] | None = None) -> Column:
    """Why a map of column values cannot be written; null for one that can.

    `new` is true for a row that does not exist yet, which must bring what has no default.
    """
    fields = [f for f in TABLES[table].fields if f.name != "id" and (names is None or f.name in names)]
    known = F.array(*[F.lit(f.name) for f in fields])
    stray = F.get(F.array_except(F.coalesce(F.map_keys(values), F.array().cast("array<string>")), known), F.lit(0))
    reasons = [F.when(stray.isNotNull(), F.concat(F.lit("unknown column "), stray))]
    for field in fields:
        given = F.coalesce(F.map_contains_key(values, field.name), F.lit(False))
        text = F.try_element_at(values, F.lit(field.name))
        if not isinstance(field.dataType, StringType):
            reasons.append(F.when(text.isNotNull() & typed(text, field.dataType).isNull(), F.lit(f"{field.name} cannot be read")))
        if not field.nullable:
            lacking = given & text.isNull()
            if field.name not in DEFAULTS[table]:
                lacking = lacking | (new & ~given)
            reasons.append(F.when(lacking, F.lit(f"{field.name} is null")))
    return F.coalesce(*reasons)


def judged_patches(df: DataFrame, table: str, patch: str = "patch", key: str = "id") -> DataFrame:
    """The rows with a reason, null where the map of column values makes a complete row."""
    problem = patch_problem(table, F.col(patch), F.lit(True))
    return df.withColumn("reason", F.when(F.col(key).isNull(), "id is null").otherwise(problem))


def refused_patches(df: DataFrame, table: str, patch: str = "patch", key: str = "id") -> DataFrame:
    """The rows that from_patch leaves out, and why."""
    return judged_patches(df, table, patch, key).where(F.col("reason").isNotNull()).select(key, "reason")


def from_patch(df: DataFrame, table: str, now: datetime, patch: str = "patch", key: str = "id") -> DataFrame:
    """Complete rows from one map of column values per row.

    A column missing from the map takes its default; a null in the map stays null. Rows that the
    table could not take are left to refused_patches.
    """
    df = judged_patches(df, table, patch, key).where(F.col("reason").isNull())
    values = F.col(patch)
    columns = [F.col(key).cast("bigint").alias("id")]
    for field in TABLES[table].fields[1:]:
        given = F.map_contains_key(values, field.name)
        value = typed(F.try_element_at(values, F.lit(field.name)), field.dataType)
        default = default_value(table, field.name, now)
        columns.append(F.when(given, value).otherwise(default).alias(field.name))
    return df.select(*columns)


def refuse_taken(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows (id, reason) with a reason also where otherwise acceptable ones bring an id that is stored or given twice.

    The stored ids are cut down to those of the rows before anything of them is shuffled. Ids given twice are counted in
    every task first, so an id that very many rows bring is no hot key.
    """
    good = rows.where(F.col("reason").isNull())
    counts = good.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.where(F.col("_n") > 1).select("_id", F.lit("id is given twice").alias("_why"))
    if stored is not None:
        taken = stored.select(F.col("id").alias("_id")).join(counts.select("_id"), "_id", "left_semi")
        found = found.unionByName(taken.withColumn("_why", F.lit("id is taken")))
    found = found.groupBy("_id").agg(F.max("_why").alias("_why"))  # taken comes before given twice
    met = rows.join(found, F.col("id") == F.col("_id"), "left")
    return met.withColumn("reason", F.coalesce("reason", "_why")).drop("_id", "_why")


def product_form_problem(name: Column, price_text: Column) -> Column:
    """Why the product form refuses a row; null for a row it takes."""
    return F.when(F.coalesce(name, F.lit("")) == "", "name is missing").when(
        F.coalesce(price_text, F.lit("")) == "", "price is missing"
    )


def missing_required(table: str) -> Column:
    """Which required column a row leaves null; null for a complete row."""
    return F.coalesce(*[
        F.when(F.col(name).isNull(), F.lit(f"{name} is null")) for name in required(table)
    ])


def split(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a problem, and the others with a reason column."""
    return df.where(problem.isNull()), df.withColumn("reason", problem).where(F.col("reason").isNotNull())
