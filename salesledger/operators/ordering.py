"""Sorts, the latest rows and row numbers.

Postgres puts nulls first when descending and last when ascending, and leaves ties
open; id settles them here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one instant that many rows share are numbered in runs of so many neighbouring ids.
ID_RUN = 1 << 20
# A stretch of time with more rows than this is cut further, and with more than this share of all rows in any case;
# so no more than HOT_SHARE stretches of a kind are cut, and they may be sent to every task.
CELL_ROWS = 1 << 20
HOT_SHARE = 1 << 16


def latest_keys() -> list[Column]:
    return [F.desc_nulls_first("created_at"), F.desc("id")]


def latest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(*latest_keys())


def oldest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("created_at"), F.asc("id"))


def dates_ascending(open_dates: DataFrame) -> DataFrame:
    return open_dates.orderBy(F.asc_nulls_last("date"))


def latest(df: DataFrame, count: int = 5) -> DataFrame:
    """The latest rows: every task keeps `count` rows, nothing is sorted in full."""
    return latest_first(df).limit(count)


KEYS = ("_day", "_second", "_micro", "_run")


def _rank_sql(columns: list[str], name: str, in_order: bool) -> str:
    """The numbering of with_ordinal over a view {df}.

    keys: four numbers that rise together in the order of latest_keys. counts0 to counts3: rows by day, then by second of the
    full days, by microsecond of the full seconds and by run of ids of the full microseconds, each with the number of rows before it.
    cut1 to cut3: what is full. cells: what isn't, which is where rows are numbered; keys that a cell does not use are 0.
    """
    parts = [f"""keys as (
        select coalesce(-cast(unix_date(to_date(created_at)) as bigint), {-(1 << 40)}) as _day,
          coalesce(-cast(hour(created_at) * 3600 + minute(created_at) * 60 + second(created_at) as bigint), 0) as _second,
          coalesce(-cast(extract(second from created_at) * 1000000 as bigint), 0) as _micro,
          coalesce(-cast(floor(id / {ID_RUN}) as bigint), {1 << 62}) as _run, * from {{df}})"""]
    cells = []
    for depth, key in enumerate(KEYS):
        by, above = ", ".join(KEYS[: depth + 1]), ", ".join(KEYS[:depth])
        if depth:
            source = f"select /*+ broadcast(cut{depth}) */ {by}, count(*) as n, max(c{depth}) as c from keys join cut{depth} using ({above}) group by {by}"
            most, base, along = "c.most", "c.start", f"partition by {above} "
        else:  # one row for each day of the calendar
            source = f"select {by}, count(*) as n from keys group by {by}"
            most, base, along = f"greatest({CELL_ROWS}L, floor(sum(n) over () / {HOT_SHARE}))", "0L", ""
        before = f"coalesce(sum(n) over ({along}order by {key} rows between unbounded preceding and 1 preceding), 0L)"
        parts.append(f"counts{depth} as (select {by}, n, {most} as most, {base} + {before} as start from ({source}))")
        rest = "".join(f", 0L as {k}" for k in KEYS[depth + 1 :])
        cells.append(f"select {by}{rest}, start as _start from counts{depth}")
        if depth + 1 < len(KEYS):
            cells[-1] += " where n <= most"
            parts.append(f"cut{depth + 1} as (select {by}, struct(most, start) as c{depth + 1} from counts{depth} where n > most)")
    joins = "".join(f" left join cut{d} using ({', '.join(KEYS[:d])})" for d in range(1, len(KEYS)))
    used = ", ".join([f"{KEYS[0]} as _day", *(f"if(c{d} is null, 0L, {k}) as {k}" for d, k in enumerate(KEYS[1:], 1))])
    named = ", ".join("`" + c.replace("`", "``").replace("{", "{{").replace("}", "}}") + "`" for c in columns)
    keys = ", ".join(KEYS)
    parts.append(f"""placed as (
        select /*+ broadcast(cut1, cut2, cut3) */ {used}, cast(null as bigint) as _start, {named} from keys{joins}
        union all
        select {keys}, _start, {", ".join(["null"] * len(columns))} from ({" union all ".join(cells)}))""")
    spread = f"/*+ repartition_by_range({keys}) */ " if in_order else ""
    along = f"over (partition by {keys} order by _start nulls last, created_at desc nulls first, id desc)"
    return f"""with {", ".join(parts)}
      select _no as `{name}`, {named} from (
        select max(_start) {along} + row_number() {along} - 1 as _no, _start, {named} from (select {spread}* from placed))
      where _start is null"""


def with_ordinal(df: DataFrame, name: str = "no", in_order: bool = False) -> DataFrame:
    """Number the rows 1..n in the order of latest_keys, exactly.

    A window over all rows would put the table into one task. Here rows are counted by cells: a day, or, where a day
    holds too many rows, smaller and smaller stretches of it down to a run of ids in one microsecond. Each cell sends one row, with
    the number of rows before it, along with its rows into the one shuffle of the whole rows, and a window numbers the
    cell from there; so nothing wide is joined, and a time that many rows share is dealt over many tasks. Counting
    reads created_at and id only, nothing is stored, and building the plan starts no job.

    With in_order that shuffle is by ranges of cells: rows come out in the order of their numbers, partition by partition, and a
    sink need not sort them again. Rows that share time and id follow each other in any order.
    """
    return df.sparkSession.sql(_rank_sql(df.columns, name, in_order), df=df)
