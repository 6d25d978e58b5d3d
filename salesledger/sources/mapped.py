"""The four domain tables derived from the given test tables.

Nothing is stored: each table is a lazy plan over the Parquet files. A caller names the
columns it reads, and the parents that only feed other columns are not joined at all. Parents are
joined from the left, so the rows of a table do not hang on the columns chosen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.periods import Period, bounds, filter_period
from ..operators.search import search
from .schema import EXPENSES, ORDERS, PRODUCTS

# The columns of the test tables that the mapping reads. Given to the reader, they spare
# it the look into a file that finds the schema out.
RAW = {
    "customer": "c_custkey bigint, c_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double",
}


STATUS = "case when o_orderstatus = 'F' then 'done' else 'process' end as status"
PAYMENT = "case when o_custkey % 2 = 0 then 'cash' else 'tf' end as payment_method"
ORDER_DAY = "cast(cast(o_orderdate as date) as string)"
PURCHASE = "((l_orderkey * 10 + l_linenumber) * 100000 + datediff(created_at, date'1970-01-01'))"


class MappedTables:
    """Domain tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")

    def order_rows(self, period: Period | None = None, tz: str = "UTC") -> DataFrame:
        """The columns an order holds itself, with o_custkey to find the customer.

        created_at is o_orderdate plus less than a day. The bounds of a period are
        therefore also set, a day wider, on o_orderdate, which the Parquet scan can use.
        """
        raw = self.raw("orders")
        if period is not None:
            first, last = bounds(period, tz)
            day_before = F.timestamp_add("DAY", F.lit(-1), first)
            raw = raw.where(F.col("o_orderdate").between(day_before, last))
        rows = raw.selectExpr(
            "o_orderkey as id",
            "cast(o_totalprice as decimal(18,2)) as total_price",
            PAYMENT,
            "case when o_orderpriority <> '5-LOW' then cast(o_orderkey % 20 * 1000 as decimal(18,2)) end as shipping_fee",
            "case o_orderkey % 3 when 1 then '' when 2 then o_orderpriority end as notes",
            STATUS,
            "timestampadd(second, o_orderkey * 7919 % 86400, o_orderdate) as created_at",
            "o_custkey",
        )
        return filter_period(rows, period, tz)

    def with_parents(self, rows: DataFrame, columns: tuple[str, ...], picked: bool = False, query: str = "") -> DataFrame:
        """Add what customer and line items hold. Where orders were picked by a period, a search or
        a limit, only their line items are aggregated."""
        if "customer_name" in columns or query:
            names = self.raw("customer").selectExpr("c_custkey as o_custkey", "c_name as customer_name")
            rows = rows.join(names, "o_custkey", "left")
            if query:
                rows = search(rows, "customer_name", query)
        if {"product_id", "quantity"} & set(columns):
            lines = self.raw("lineitem").withColumnRenamed("l_orderkey", "id")
            if picked or query:
                lines = lines.join(rows.select("id"), "id", "left_semi")
            parts = lines.groupBy("id").agg(
                F.min("l_partkey").alias("product_id"), F.sum("l_quantity").alias("_pieces")
            )
            rows = rows.join(parts, "id", "left").withColumn("quantity", F.expr("cast(coalesce(_pieces, 1) as int)"))
        return rows.select(*columns)

    def orders(self, *columns: str, period: Period | None = None, tz: str = "UTC", query: str = "") -> DataFrame:
        """Orders with the named columns, all by default; query searches the customer's name."""
        rows = self.order_rows(period, tz)
        return self.with_parents(rows, columns or tuple(ORDERS.names), period is not None, query)

    def _line_groups(self) -> DataFrame:
        """Line items of one order, line number and ship day as one purchase. The day is part of the
        key, so that a period filters line items before they are aggregated."""
        return (
            self.raw("lineitem")
            .groupBy("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("created_at"))
            .agg(
                F.min("l_partkey").alias("p_partkey"),
                F.expr("cast(sum(l_quantity) as int) as amount"),
                F.expr("cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as price"),
            )
        )

    def expenses(self, *columns: str, period: Period | None = None, tz: str = "UTC") -> DataFrame:
        """Purchases with the part as the item bought."""
        columns = columns or tuple(EXPENSES.names)
        rows = self._line_groups().selectExpr(
            f"{PURCHASE} as id",
            "p_partkey", "amount", "price", "created_at",
            "cast(null as string) as notes",
        )
        rows = filter_period(rows, period, tz)
        if {"name", "category"} & set(columns):
            items = self.raw("part").selectExpr("p_partkey", "p_name as name", "p_type as category")
            rows = rows.join(items, "p_partkey", "left")
        return rows.select(*columns)

    def products(self, *columns: str) -> DataFrame:
        rows = self.raw("part").selectExpr(
            "p_partkey as id",
            "p_name as name",
            "cast(p_retailprice as decimal(18,2)) as price",
            "p_type as description",
            "case when p_partkey % 10 <> 0 then timestampadd(day, p_partkey % 1000, timestamp_ntz'1995-01-01 00:00:00') end as created_at",
        )
        return rows.select(*(columns or PRODUCTS.names))

    def open_date_rows(self) -> DataFrame:
        """Dates as they were entered, before the unique rule: one row per urgent order."""
        return (
            self.raw("orders")
            .where("o_orderpriority = '1-URGENT'")
            .selectExpr("o_orderkey as id", f"{ORDER_DAY} as date", "o_orderdate as created_at")
        )

    def open_dates(self, period: Period | None = None) -> DataFrame:
        """Days with more urgent than low orders, under the lowest id and time of the day's orders.
        A period bounds the orders in the scan."""
        rows = self.raw("orders")
        if period is not None:
            rows = rows.where(F.col("o_orderdate").between(*bounds(period, "UTC")))
        lead = "count_if(o_orderpriority = '1-URGENT') - count_if(o_orderpriority = '5-LOW') as _lead"
        return (
            rows.groupBy(F.expr(f"{ORDER_DAY} as date"))
            .agg(F.expr(lead), F.min("o_orderkey").alias("id"), F.min("o_orderdate").alias("created_at"))
            .where("_lead > 0")
            .select("id", "date", "created_at")
        )

    def toggles(self) -> DataFrame:
        """Dates to toggle, repeats kept, under ids that no stored date has."""
        return self.raw("orders").where("o_orderpriority = '2-HIGH'").selectExpr("-o_orderkey - 1 as id", f"{ORDER_DAY} as date")

    def change_feed(self) -> DataFrame:
        """Changes to the orders, chosen by the priority of each order, and changes that must be refused.

        Every order yields the array of its changes, so the orders are read once.
        New and unknown ids are negative, hence never those of an order.
        """

        def change(when: str, offset: int, id_: str, op: str, patch: str) -> str:
            return f"""case when {when} then named_struct('seq', o_orderkey * 10 + {offset}, 'id', {id_},
                'op', '{op}', 'patch', cast({patch} as map<string,string>)) end"""

        def bad(kind: int, id_: str, op: str, patch: str) -> str:
            return change(f"o_orderstatus = 'O' and o_orderkey % 6 = {kind}", 5, id_, op, patch)

        changes = ", ".join([
            change("o_orderpriority = '1-URGENT'", 0, "o_orderkey", "update", "map('status', 'done', 'quantity', cast(o_orderkey % 50 as string))"),
            change("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'", 1, "o_orderkey", "update", "map('status', 'process', 'total_price', '12.50')"),
            change("o_orderpriority = '2-HIGH'", 0, "o_orderkey", "update", "map('notes', cast(null as string), 'shipping_fee', cast(null as string))"),
            change("o_orderpriority = '3-MEDIUM'", 0, "o_orderkey", "delete", "null"),
            change("o_orderpriority = '4-NOT SPECIFIED'", 0, "-o_orderkey - 1", "insert",
                   "map('customer_name', 'New', 'notes', 'new', 'quantity', ' 3 ', 'created_at', '1998-01-02 03:04:05')"),
            change("o_orderpriority = '5-LOW'", 0, "-o_orderkey - 1", "update", "map('status', 'done')"),
            bad(0, "o_orderkey", "update", "map('quantity', 'abc')"),
            bad(1, "o_orderkey", "update", "map('customer_name', cast(null as string))"),
            bad(2, "o_orderkey", "DELETE", "null"),
            bad(3, "o_orderkey", "update", "map('colour', 'red', 'status', 'done')"),
            bad(4, "cast(null as bigint)", "delete", "null"),
            bad(5, "-o_orderkey - 1", "insert", "map('notes', 'new')"),
        ])
        return self.raw("orders").selectExpr(f"inline(array_compact(array({changes})))")

    def product_changes(self) -> DataFrame:
        """Changes of products: every fifth is deleted, and every fiftieth place brings a new one under a negative id."""
        change = "named_struct('seq', p_partkey, 'id', {id}, 'op', '{op}', 'patch', cast({patch} as map<string,string>))"
        changes = ", ".join([
            f"if(p_partkey % 5 = 0, {change.format(id='p_partkey', op='delete', patch='null')}, null)",
            f"if(p_partkey % 50 = 1, {change.format(id='-p_partkey', op='insert', patch="map('name', 'New', 'price', '100')")}, null)",
        ])
        return self.raw("part").selectExpr(f"inline(array_compact(array({changes})))")

    def product_choices(self) -> DataFrame:
        """A change of the product of every order: one that may not exist or be deleted, a new one, none, or no number."""
        return self.raw("orders").selectExpr(
            "o_orderkey as seq",
            "o_orderkey as id",
            "'update' as op",
            """map('product_id', case o_orderkey % 4 when 0 then cast(o_custkey * 2 as string) when 1 then cast(-o_custkey as string)
                when 3 then 'abc' end) as patch""",
        )

    def clashing_edits(self) -> DataFrame:
        """Two order edits of every order: without a seq, both under one seq, or with the same content under one seq, by the key."""
        forms = self.order_forms()
        later = forms.withColumn("notes", F.expr("if(id % 5 = 3, notes, 'other')"))
        seq = F.expr("case when id % 5 = 1 then null when id % 5 in (2, 3) then 7 else seq end")
        return forms.withColumn("seq", seq).unionByName(later.withColumn("seq", F.coalesce(seq + F.expr("if(id % 5 in (2, 3), 0, 1)"), seq)))

    def order_payloads(self) -> DataFrame:
        """New orders as maps that leave some columns out and set others to null."""

        def entry(name: str, value: str, when: str = "true") -> str:
            return f"case when {when} then named_struct('key', '{name}', 'value', cast({value} as string)) end"

        entries = ", ".join([
            entry("customer_name", "if(o_orderkey % 13 = 0, null, concat('Customer ', o_custkey))"),
            entry("quantity", "if(o_orderkey % 11 = 0, 'many', concat(' ', day(o_orderdate)))", "o_orderpriority <> '5-LOW'"),
            entry("colour", "'red'", "o_orderkey % 17 = 0"),
            entry("total_price", "cast(o_totalprice as decimal(18,2))", "o_orderpriority <> '4-NOT SPECIFIED'"),
            entry("payment_method", "'tf'", "o_orderstatus = 'F'"),
            entry("shipping_fee", "null", "o_orderpriority = '1-URGENT'"),
            entry("notes", "o_orderpriority", "o_orderstatus <> 'O'"),
            entry("status", "null", "o_orderstatus = 'P'"),
            entry("created_at", "o_orderdate", "o_orderstatus <> 'P'"),
        ])
        return self.raw("orders").selectExpr(
            "o_orderkey as id", f"map_from_entries(array_compact(array({entries}))) as patch"
        )

    def order_forms(self) -> DataFrame:
        """An order form as typed for every order; some numbers and products are wrong."""
        return self.raw("orders").selectExpr(
            "o_orderkey * 10 as seq",
            "o_orderkey as id",
            "concat('Customer ', o_custkey) as customer_name",
            """case when o_orderpriority = '5-LOW' then null
                when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'P' then ''
                else cast(o_custkey * 2 as string) end as product_id""",
            """case when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'P' then 'many'
                when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'O' then ''
                else concat(' ', day(o_orderdate)) end as quantity""",
            """case when o_orderpriority = '1-URGENT' then null
                when o_orderpriority = '2-HIGH' and o_orderstatus = 'O' then 'free'
                when o_orderpriority = '2-HIGH' and o_orderkey % 5 = 0 then '9999999999999999.99'
                else cast(o_orderkey % 20 * 1000 as string) end as shipping_fee""",
            PAYMENT,
            "case when o_orderstatus = 'O' then o_orderpriority else '' end as notes",
            STATUS,
            f"case when o_orderstatus = 'F' then {ORDER_DAY} when o_orderkey % 23 = 0 then 'not a date' else '' end as order_date",
        )

    def expense_forms(self) -> DataFrame:
        """An expense form as typed for every purchase."""
        return self._line_groups().selectExpr(
            f"{PURCHASE} as id",
            f"{PURCHASE} * 10 as seq",
            "concat('Item ', l_linenumber) as name",
            "if(l_linenumber = 2, concat(amount, '.5'), cast(amount as string)) as amount",
            "if(l_linenumber = 3, '', concat(price, ' ')) as price",
            """case l_linenumber when 4 then cast(cast(created_at as date) as string)
                when 5 then date_format(created_at, 'dd/MM/yyyy') end as expense_date""",
            "'' as notes",
        )

    def product_forms(self) -> DataFrame:
        """Raw product input: some names and prices are empty or no number."""
        return self.raw("part").selectExpr(
            "p_partkey as id",
            "p_partkey as seq",
            "if(p_partkey % 7 = 0, '', p_name) as name",
            """case when p_partkey % 11 = 0 then '' when p_partkey % 13 = 0 then 'abc'
                else cast(p_size as string) end as price_text""",
        )
