"""SQL checks: for each registered query, the same result as DuckDB SQL over the raw tables."""

from __future__ import annotations

DOMAIN = """
with line_totals as (
  select l_orderkey, min(l_partkey) as product_id, sum(l_quantity) as pieces
  from lineitem group by l_orderkey
),
d_orders as (
  select o_orderkey as id, c_name as customer_name, product_id,
    cast(coalesce(pieces, 1) as integer) as quantity,
    cast(o_totalprice as decimal(18,2)) as total_price,
    case when o_custkey % 2 = 0 then 'cash' else 'tf' end as payment_method,
    case when o_orderpriority = '5-LOW' then null
         else cast(o_orderkey % 20 * 1000 as decimal(18,2)) end as shipping_fee,
    case o_orderkey % 3 when 0 then null when 1 then '' else o_orderpriority end as notes,
    case when o_orderstatus = 'F' then 'done' else 'process' end as status,
    o_orderdate + to_seconds((o_orderkey * 7919) % 86400) as created_at
  from orders left join customer on o_custkey = c_custkey
  left join line_totals on l_orderkey = o_orderkey
),
bought as (
  select l_orderkey, l_linenumber, min(l_partkey) as part_id, cast(sum(l_quantity) as integer) as amount,
    cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as price,
    l_shipdate as created_at, (l_orderkey * 10 + l_linenumber) * 100000
      + date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as purchase
  from lineitem group by l_orderkey, l_linenumber, l_shipdate
),
d_expenses as (
  select purchase as id, p_name as name, amount, price, p_type as category,
    cast(null as varchar) as notes, created_at
  from bought left join part on part_id = p_partkey
),
d_products as (
  select p_partkey as id, p_name as name, cast(p_retailprice as decimal(18,2)) as price,
    p_type as description,
    case when p_partkey % 10 <> 0 then timestamp '1995-01-01 00:00:00' + to_days(cast(p_partkey % 1000 as integer)) end as created_at
  from part
),
d_open_dates as (
  select strftime(o_orderdate, '%Y-%m-%d') as date, min(o_orderkey) as id, min(o_orderdate) as created_at
  from orders group by strftime(o_orderdate, '%Y-%m-%d')
  having count(*) filter (where o_orderpriority = '1-URGENT')
       > count(*) filter (where o_orderpriority = '5-LOW')
),
d_forms as (
  select p_partkey as id, case when p_partkey % 7 = 0 then '' else p_name end as name,
    case when p_partkey % 11 = 0 then '' when p_partkey % 13 = 0 then 'abc'
         else cast(p_size as varchar) end as price_text
  from part
),
d_order_forms as (
  select o_orderkey as id, 'Customer ' || cast(o_custkey as varchar) as customer_name,
    case when o_orderpriority = '5-LOW' then null else o_custkey * 2 end as product_id,
    case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'P' then 'product_id is no number'
         when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'P' then 'quantity is no whole number'
         when o_orderpriority = '2-HIGH' and o_orderstatus = 'O' then 'shipping_fee is no number'
         when o_orderstatus <> 'F' and o_orderkey % 23 = 0 then 'order_date is no date'
         when o_orderpriority <> '5-LOW' and p_partkey is null then 'product does not exist'
         when o_orderpriority = '2-HIGH' and o_orderkey % 5 = 0 then 'total is too large' end as reason,
    cast(case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'O' then 0 else day(o_orderdate) end as integer)
      as quantity,
    cast(case when o_orderpriority = '1-URGENT' then 0 else o_orderkey % 20 * 1000 end as decimal(18,2))
      as shipping_fee,
    cast(coalesce(p_retailprice, 0) as decimal(18,2)) as unit_price,
    case when o_custkey % 2 = 0 then 'cash' else 'tf' end as payment_method,
    case when o_orderstatus = 'O' then o_orderpriority else '' end as notes,
    case when o_orderstatus = 'F' then 'done' else 'process' end as status,
    case when o_orderstatus = 'F' then o_orderdate end as chosen
  from orders left join part on o_orderpriority <> '5-LOW' and p_partkey = o_custkey * 2
),
d_feed as (
  select o_orderkey * 10 as seq,
    case when o_orderpriority in ('4-NOT SPECIFIED', '5-LOW') then -o_orderkey - 1 else o_orderkey end as id,
    case o_orderpriority when '3-MEDIUM' then 'delete' when '4-NOT SPECIFIED' then 'insert' else 'update' end as op
  from orders
),
d_payloads as (
  select *, case when o_orderkey % 17 = 0 then 'unknown column colour'
      when o_orderkey % 13 = 0 then 'customer_name is null'
      when o_orderkey % 11 = 0 and o_orderpriority <> '5-LOW' then 'quantity cannot be read' end as reason
  from orders
)
"""

REV = "(total_price - coalesce(shipping_fee, 0))"


def money(expression: str, name: str) -> str:
    return f"cast({expression} as double) as {name}"


def total(expression: str, name: str) -> str:
    return money(f"coalesce(sum({expression}), 0)", name)


def between(first: str, last: str) -> str:
    return f"created_at >= timestamp '{first}' and created_at <= timestamp '{last}'"


TODAY = between("1998-08-15 00:00:00", "1998-08-15 23:59:59")
WEEK = between("1998-08-10 00:00:00", "1998-08-16 23:59:59.999")
MONTH = between("1998-08-01 00:00:00", "1998-08-31 23:59:59")
YEAR = between("1998-01-01 00:00:00", "1998-12-31 23:59:59")
CHOSEN = between("1997-03-01 00:00:00", "1997-03-31 23:59:59")
# The zone of the zone checks is seven hours ahead of UTC all year.
TODAY_ZONE = between("1998-08-14 17:00:00", "1998-08-15 16:59:59")
WEEK_ZONE = between("1998-08-09 17:00:00", "1998-08-16 16:59:59.999")
MONTH_ZONE = between("1998-07-31 17:00:00", "1998-08-31 16:59:59")

ORDER_SEARCH = "case when contains(lower(customer_name), 'customer#0000001') then true else false end"
ITEM_SEARCH = "case when contains(lower(name), 'ring') then true else false end"
LATEST = "order by created_at desc nulls first, id desc"


def rupiah(expression: str) -> str:
    whole = f"round(coalesce({expression}, 0), 0)"
    return (
        f"case when {whole} < 0 then '-' else '' end || 'Rp' || chr(160) || "
        f"replace(format('{{:,}}', cast(abs({whole}) as bigint)), ',', '.')"
    )


def short_date(expression: str = "created_at") -> str:
    return f"replace(strftime({expression}, '%d %b %Y'), ' Sep ', ' Sept ')"


def dash(expression: str) -> str:
    return f"coalesce(nullif({expression}, ''), '-')"


def picked(names: list[str], index: str) -> str:
    whens = " ".join(f"when {i} then '{name}'" for i, name in enumerate(names))
    return f"case {index} {whens} end"


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Indonesian month and weekday names.
MONTHS_ID = [
    "Januari", "Februari", "Maret", "April", "Mei", "Juni",
    "Juli", "Agustus", "September", "Oktober", "November", "Desember",
]
WEEKDAYS_ID = ["Min", "Sen", "Sel", "Rab", "Kam", "Jum", "Sab"]

STATUS = "case when status = 'done' then 'Done' else 'In Progress' end"
# Products after every fifth was deleted, but for those that orders name, and some were added.
PRODUCTS_LEFT = """select p_partkey from part where p_partkey % 5 <> 0 or p_partkey in (select product_id from d_orders)
          union all select -p_partkey from part where p_partkey % 50 = 1"""

PRODUCT_COLUMNS = f"id, name, {money('price', 'price')}, description, created_at"
ORDER_COLUMNS = (
    f"id, customer_name, product_id, quantity, {money('total_price', 'total_price')}, payment_method, "
    f"{money('shipping_fee', 'shipping_fee')}, notes, status, created_at"
)
EXPENSE_COLUMNS = f"id, name, amount, {money('price', 'price')}, category, notes, created_at"


def orders_in(where: str) -> str:
    return f"select id, {money('total_price', 'total_price')}, created_at from d_orders where {where}"


def expenses_in(where: str) -> str:
    return f"select id, {money('price', 'price')}, created_at from d_expenses where {where}"


def flows(where: str) -> str:
    return (
        f"(select created_at, {REV} as revenue, 0::decimal(18,2) as expenses from d_orders where {where} "
        f"union all select created_at, 0::decimal(19,2), price from d_expenses where {where})"
    )


def summary(where: str, label: str) -> str:
    return f"""select {total('revenue', 'revenue')}, {total('expenses', 'expenses')},
      cast(coalesce(sum(revenue), 0) - coalesce(sum(expenses), 0) as double) as profit,
      case when coalesce(sum(revenue), 0) - coalesce(sum(expenses), 0) >= 0 then 'profit' else 'loss' end as outcome,
      '{label}' as period
      from {flows(where)}"""


def spine(buckets: int, name: str, source: str, bucket: str, measures: dict[str, str]) -> str:
    sums = ", ".join(f"sum({e}) as {n}" for n, e in measures.items())
    out = ", ".join(money(f"coalesce({n}, 0)", n) for n in measures)
    return f"""select bucket, {name} as name, {out}
      from (select cast(range as integer) as bucket from range(1, {buckets + 1})) s
      left join (select cast({bucket} as integer) as bucket, {sums} from {source} group by 1) a using (bucket)"""


def overview(buckets: int, name: str, where: str, bucket: str) -> str:
    return f"""select bucket, {name} as name, cast(coalesce(pcs, 0) as bigint) as pcs,
      {money('coalesce(revenue, 0)', 'revenue')},
      cast(sum(coalesce(pcs, 0)) over () as bigint) as total_pcs,
      cast(sum(coalesce(revenue, 0)) over () as double) as total_revenue,
      'Saturday, 15 August 1998' as header
      from (select cast(range as integer) as bucket from range(1, {buckets + 1})) s
      left join (select cast({bucket} as integer) as bucket, sum(quantity) as pcs, sum({REV}) as revenue
                 from d_orders where {where} group by 1) a using (bucket)"""


MONTH_NAME = picked(["", *MONTHS], "bucket")
BY_REPORT = {"revenue": "revenue", "expenses": "expenses"}
NUMBER = f"row_number() over ({LATEST}) as \"#\""
RECENT = f"(select * from d_orders {LATEST} limit 5)"
LOCAL = "(created_at + to_hours(7))"
PRICE_INPUT = (
    "case when trim(coalesce(price_text, '')) = '' then 0::decimal(18,2) "
    "else try_cast(trim(price_text) as decimal(18,2)) end"
)

FORM_TOTAL = "unit_price * quantity + shipping_fee"

SQL = {
    "scan_products": f"select {PRODUCT_COLUMNS} from d_products",
    "scan_orders": f"select {ORDER_COLUMNS} from d_orders",
    "scan_expenses": f"select {EXPENSE_COLUMNS} from d_expenses",
    "scan_projected": f"""select {money('total_price', 'total_price')}, {money('shipping_fee', 'shipping_fee')},
        quantity, created_at from d_orders""",
    "sink_roundtrip": f"select {ORDER_COLUMNS}, strftime(created_at, '%Y-%m') as created_month from d_orders",
    "sink_one_month": f"""select {ORDER_COLUMNS}, strftime(created_at, '%Y-%m') as created_month
        from d_orders where {CHOSEN}""",
    "ingest_defaults": """select o_orderkey as id, 'Customer ' || cast(o_custkey as varchar) as customer_name,
        cast(null as bigint) as product_id,
        cast(case when o_orderpriority = '5-LOW' then 1 else day(o_orderdate) end as integer) as quantity,
        cast(case when o_orderpriority = '4-NOT SPECIFIED' then 0
             else cast(o_totalprice as decimal(18,2)) end as double) as total_price,
        case when o_orderstatus = 'F' then 'tf' else 'cash' end as payment_method,
        cast(case when o_orderpriority = '1-URGENT' then null else 0 end as double) as shipping_fee,
        case when o_orderstatus = 'O' then null else o_orderpriority end as notes,
        case when o_orderstatus = 'P' then null else 'process' end as status,
        case when o_orderstatus = 'P' then timestamp '1998-08-15 10:00:00' else o_orderdate end as created_at
        from d_payloads where reason is null""",
    "ingest_refused": "select o_orderkey as id, reason from d_payloads where reason is not null",
    "export_list_head": f"""select cast(unnest([1, 2]) as integer) as line,
        unnest(['Orders — This Month', 'Generated: 15/08/1998']) as text, rows
        from (select count(*) as rows from d_orders where {MONTH} and customer_name is not null)""",
    "report_head": f"""select cast(unnest([1, 2]) as integer) as line,
        unnest(['Financial Report — Aug 1998', 'Generated: 15/08/1998']) as text, rows
        from (select count(*) as rows from {flows(MONTH)})""",
    "append_twice": f"select {ORDER_COLUMNS}, strftime(created_at, '%Y-%m') as created_month from d_orders",
    "output_names": f"""select 'orders_this_month/Orders' as sheet, count(*) as rows from d_orders where {MONTH}
        union all select 'expenses_this_month/Expenses', count(*) from d_expenses where {MONTH}
        union all select 'report_Aug_1998/Orders', count(*) from d_orders where {MONTH}
        union all select 'report_Aug_1998/Expenses', count(*) from d_expenses where {MONTH}
        union all select 'report_Aug_1998/Summary', 6""",
    "search_orders_indexed": f"select id, customer_name from d_orders where {ORDER_SEARCH}",
    "order_ordinals_fractions": f"""select row_number() over ({LATEST}) as no, id, created_at from (
        select id, case when id % 97 <> 0 then cast(cast(created_at as date) as timestamp)
          + to_microseconds((id * 104729) % 1000000) end as created_at from d_orders)""",
    "changes_unknown_product": f"""select o_orderkey as seq, o_orderkey as id, 'update' as op,
        case when o_orderkey % 4 = 3 then 'product_id cannot be read' else 'product does not exist' end as reason
        from orders where o_orderkey % 4 = 3
          or (o_orderkey % 4 = 0 and o_custkey * 2 not in ({PRODUCTS_LEFT}))
          or (o_orderkey % 4 = 1 and -o_custkey not in ({PRODUCTS_LEFT}))""",
    "changes_known_product": f"""select id, case
          when o_orderkey % 4 = 0 and o_custkey * 2 in ({PRODUCTS_LEFT}) then o_custkey * 2
          when o_orderkey % 4 = 1 and -o_custkey in ({PRODUCTS_LEFT}) then -o_custkey
          when o_orderkey % 4 = 2 then null else product_id end as product_id
        from d_orders join orders on id = o_orderkey""",
    "products_after_changes": f"""select {PRODUCT_COLUMNS} from d_products where id in ({PRODUCTS_LEFT})
        union all select -p_partkey, 'New', 100, null, timestamp '1998-08-15 10:00:00' from part where p_partkey % 50 = 1""",
    "save_orders_taken_id": """select f.id, case when reason is not null then reason when year(o.created_at) >= 1998 then 'id is taken'
          else 'id is given twice' end as reason
        from d_order_forms f join d_orders o on f.id = o.id join (select unnest([1, 2]) as copy) on copy = 1 or f.id % 10 = 0
        where reason is not null or year(o.created_at) >= 1998 or f.id % 10 = 0""",
    "edit_null_seq": """select case when id % 5 = 1 then null when id % 5 in (2, 3) then 7 else id * 10 + copy - 1 end as seq, id,
          coalesce(reason, case when id % 5 = 1 then 'seq is null' else 'seq is given twice' end) as reason
        from d_order_forms join (select unnest([1, 2]) as copy) on true
        where reason is not null or id % 5 in (1, 2)""",
    "report_staged": f"""select 0 as bucket, period as name, revenue, expenses from ({summary(YEAR, "Year 1998")})
        union all select * from ({spine(12, MONTH_NAME, flows(YEAR), "month(created_at)", BY_REPORT)})""",
    "dashboard_staged": f"""select 0 as bucket, cast(cast(coalesce(sum(quantity), 0) as bigint) as varchar) as name, {total(REV, 'revenue')}
        from d_orders where {MONTH}
        union all select * from ({spine(31, "cast(bucket as varchar)", f"(select * from d_orders where {MONTH})", "day(created_at)", {"revenue": REV})})""",
    "export_orders_pdf": f"""select {NUMBER}, {short_date()} as "Date", customer_name as "Customer",
        cast(quantity as varchar) as "Qty", {rupiah('total_price')} as "Total",
        coalesce(upper(payment_method), '') as "Payment", {rupiah('shipping_fee')} as "Shipping",
        coalesce(status, '') as "Status" from d_orders""",
    "export_orders_xls": f"""select {NUMBER}, {short_date()} as "Date", customer_name as "Customer",
        quantity as "Qty", {money('total_price', '"Total"')}, coalesce(payment_method, '') as "Payment",
        {money('shipping_fee', '"Shipping"')}, coalesce(notes, '') as "Notes", coalesce(status, '') as "Status"
        from d_orders""",
    "export_expenses_pdf": f"""select {NUMBER}, {short_date()} as "Date", name as "Item",
        cast(amount as varchar) as "Qty", {rupiah('price')} as "Price", {dash('notes')} as "Notes" from d_expenses""",
    "export_expenses_xls": f"""select {NUMBER}, {short_date()} as "Date", name as "Item", amount as "Qty",
        {money('price', '"Price"')}, coalesce(notes, '') as "Notes" from d_expenses""",
    "filter_period": f"select id, created_at from d_orders where {CHOSEN}",
    "orders_all": orders_in("true"),
    "orders_today": orders_in(TODAY),
    "orders_this_week": orders_in(WEEK),
    "orders_this_month": orders_in(MONTH),
    "orders_this_year": orders_in(YEAR),
    "orders_today_in_zone": orders_in(TODAY_ZONE),
    "orders_this_week_in_zone": orders_in(WEEK_ZONE),
    "orders_this_month_half_open": orders_in(
        "created_at >= timestamp '1998-08-01 00:00:00' and created_at < timestamp '1998-09-01 00:00:00'"
    ),
    "expenses_all": expenses_in("true"),
    "expenses_today": expenses_in(TODAY),
    "expenses_this_month": expenses_in(MONTH),
    "expenses_this_year": expenses_in(YEAR),
    "search_orders": f"select id, customer_name from d_orders where {ORDER_SEARCH}",
    "search_expenses": f"select id, name from d_expenses where {ITEM_SEARCH}",
    "net_revenue": f"select id, {money(REV, 'net_revenue')} from d_orders",
    "orders_with_product": f"""select o.id, o.quantity, o.product_id, p.name as product_name,
        {money('p.price', 'product_price')} from d_orders o left join d_products p on o.product_id = p.id""",
    "price_orders": f"""select o.id, o.quantity, {money('p.price', 'unit_price')},
        {money('coalesce(p.price * o.quantity, 0)', 'subtotal')},
        {money('coalesce(p.price * o.quantity, 0) + coalesce(o.shipping_fee, 0)', 'computed_total')}
        from d_orders o left join d_products p on o.product_id = p.id""",
    "orders_on_open_date": """select id, created_at from d_orders
        where strftime(created_at, '%Y-%m-%d') in (select date from d_open_dates)""",
    "orphan_orders": """select id, product_id from d_orders o where product_id is not null
        and not exists (select 1 from d_products p where p.id = o.product_id)""",
    "orphan_orders_of_accepted_products": """select id, product_id from d_orders o where product_id is not null
        and not exists (select 1 from d_forms f where f.id = o.product_id and f.name <> '' and f.price_text <> '')""",
    "deletable_products": """select id, name from d_products p
        where not exists (select 1 from d_orders o where o.product_id = p.id)""",
    "dashboard_kpis_month": f"""select cast(coalesce(sum(quantity), 0) as bigint) as pcs, {total(REV, 'revenue')}
        from d_orders where {MONTH}""",
    "dashboard_kpis_year": f"""select cast(coalesce(sum(quantity), 0) as bigint) as pcs, {total(REV, 'revenue')}
        from d_orders where {YEAR}""",
    "order_list_kpis": f"""select cast(coalesce(sum(quantity), 0) as bigint) as quantity,
        {total('shipping_fee', 'shipping')}, {total('total_price', 'gross_revenue')}
        from d_orders where {ORDER_SEARCH}""",
    "expense_list_kpis": f"select count(*) as items, {total('price', 'total')} from d_expenses where {ITEM_SEARCH}",
    "revenue_by_day": spine(
        31, "cast(bucket as varchar)", f"(select * from d_orders where {MONTH}) o", "day(created_at)", {"revenue": REV}
    ),
    "revenue_by_day_in_zone": spine(
        31, "cast(bucket as varchar)", f"(select * from d_orders where {MONTH_ZONE}) o", f"day({LOCAL})",
        {"revenue": REV},
    ),
    "revenue_by_month": spine(
        12, MONTH_NAME, f"(select * from d_orders where {YEAR}) o", "month(created_at)", {"revenue": REV}
    ),
    "report_by_month": spine(12, MONTH_NAME, flows(YEAR), "month(created_at)", BY_REPORT),
    "report_by_week": spine(
        5, "'W' || cast(bucket as varchar)", flows(MONTH), "(day(created_at) - 1) // 7 + 1", BY_REPORT
    ),
    "order_ordinals": f"select row_number() over ({LATEST}) as no, id, created_at from d_orders",
    "expense_ordinals": f"""select row_number() over ({LATEST}) as no, id, name, created_at
        from d_expenses where {ITEM_SEARCH}""",
    "orders_sorted": f"select id, {money('total_price', 'total_price')}, created_at from d_orders {LATEST}",
    "products_sorted": f"select {PRODUCT_COLUMNS} from d_products order by created_at asc nulls last, id",
    "open_dates_sorted": "select date from d_open_dates order by date asc nulls last",
    "recent_orders": f"""select id, customer_name, quantity, {money('total_price', 'total_price')},
        created_at, status from {RECENT}""",
    "order_table": f"""select row_number() over ({LATEST}) as no, id, {short_date()} as date, customer_name, quantity,
        {rupiah('total_price')} as total,
        case payment_method when 'cash' then 'Cash' when 'tf' then 'Transfer' end as payment,
        {rupiah('shipping_fee')} as shipping, {dash('notes')} as notes,
        case status when 'process' then 'In Progress' when 'done' then 'Done' end as status
        from d_orders""",
    "expense_table": f"""select row_number() over ({LATEST}) as no, id, {short_date()} as date, name, amount,
        {rupiah('price')} as price, {dash('notes')} as notes from d_expenses""",
    "recent_orders_text": f"""select id, customer_name,
        {short_date()} || ' · ' || cast(quantity as varchar) || ' pcs' as detail,
        {rupiah('total_price')} as total, {STATUS} as status from {RECENT}""",
    "po_calendar": """select strftime(d, '%Y-%m-%d') as date, cast(day(d) as integer) as day,
        cast(dayofweek(d) as integer) as weekday,
        cast((dayofweek(date '1998-08-01') + day(d) - 1) // 7 as integer) as grid_row,
        o.date is not null as is_open, d = date '1998-08-15' as is_today,
        case when o.date is not null then 'open' when d = date '1998-08-15' then 'today' else 'plain' end as style
        from (select date '1998-08-01' + cast(range as integer) as d from range(31)) c
        left join d_open_dates o on o.date = strftime(d, '%Y-%m-%d')""",
    "toggle_open_dates": """select coalesce(min(id), min(new_id)) as id, date,
          coalesce(min(created_at), timestamp '1998-08-15 10:00:00') as created_at from (
          select id, cast(null as bigint) as new_id, date, created_at from d_open_dates
          union all select null, -o_orderkey - 1, strftime(o_orderdate, '%Y-%m-%d'), null
          from orders where o_orderpriority = '2-HIGH'
        ) u group by date having count(*) % 2 = 1""",
    "unique_open_dates": """select min(o_orderkey) as id, strftime(o_orderdate, '%Y-%m-%d') as date,
        arg_min(o_orderdate, o_orderkey) as created_at
        from orders where o_orderpriority = '1-URGENT' group by strftime(o_orderdate, '%Y-%m-%d')""",
    "duplicate_open_dates": """select strftime(o_orderdate, '%Y-%m-%d') as date, count(*) as copies
        from orders where o_orderpriority = '1-URGENT' group by 1 having count(*) > 1""",
    "fmt_currency": f"""select id, {rupiah('total_price')} as total_text, {rupiah('shipping_fee')} as fee_text,
        {rupiah('shipping_fee - total_price')} as difference_text from d_orders""",
    "fmt_date": f"""select id, {short_date()} as short_text, strftime(created_at, '%A, %-d %B %Y') as long_text,
        strftime(created_at, '%d/%m/%Y') as stamp, strftime(created_at, '%Y-%m-%d') as day_key from d_orders""",
    "fmt_date_id": f"""select date, weekday || ', ' || label as option_label, label as long_label from (
          select date, {picked(WEEKDAYS_ID, 'dayofweek(cast(date as date))')} as weekday,
            cast(day(cast(date as date)) as varchar) || ' ' ||
            {picked(['', *MONTHS_ID], 'month(cast(date as date))')} || ' ' ||
            cast(year(cast(date as date)) as varchar) as label
          from d_open_dates) t""",
    "date_parts": f"""select id, cast(day({LOCAL}) as integer) as day, cast(month({LOCAL}) as integer) as month,
        cast(dayofweek({LOCAL}) as integer) as weekday,
        cast(day(last_day({LOCAL})) as integer) as days_in_month,
        cast((day({LOCAL}) - 1) // 7 as integer) as week,
        {picked(['', *MONTHS], f'month({LOCAL})')} as month_name from d_orders""",
    "product_labels": """select id, name || ' — Rp ' || replace(format('{:,}', cast(floor(price) as bigint)), ',', '.')
        || case when price = floor(price) then ''
           else ',' || rtrim(split_part(cast(price as varchar), '.', 2), '0') end as label from d_products""",
    "payment_labels": f"""select id, case payment_method when 'cash' then 'Cash' when 'tf' then 'Transfer' end as pill,
        upper(payment_method) as printed, {dash('upper(payment_method)')} as code,
        {dash('upper(notes)')} as notes_code from d_orders""",
    "text_fallbacks": f"""select id, {STATUS} as status, {dash('notes')} as printed_notes,
        coalesce(notes, '') as sheet_notes, coalesce(cast(shipping_fee as varchar), '') as fee_cell,
        {money('coalesce(shipping_fee, 0)', 'fee')} from d_orders""",
    "coerce_numbers": f"select id, {money(PRICE_INPUT, 'price')} from d_forms",
    "order_date_to_ts": "select date, cast(date as timestamp) as created_at from d_open_dates",
    "expense_date_to_ts": "select date, cast(date as timestamp) + to_hours(12 - 7) as created_at from d_open_dates",
    "apply_changes": f"""select id, customer_name, product_id,
        case when o_orderpriority = '1-URGENT' then cast(o_orderkey % 50 as integer) else quantity end as quantity,
        cast(case when o_orderpriority = '1-URGENT' and o_orderstatus = 'P' then 12.50 else total_price end as double) as total_price,
        payment_method, cast(case when o_orderpriority = '2-HIGH' then null else shipping_fee end as double) as shipping_fee,
        case when o_orderpriority = '2-HIGH' then null else notes end as notes,
        case when o_orderpriority = '1-URGENT' then case when o_orderstatus = 'P' then 'process' else 'done' end
             else status end as status, created_at
        from d_orders join orders on id = o_orderkey where o_orderpriority <> '3-MEDIUM'
        union all
        select id, 'New', null, 3, 0, 'cash', 0, 'new', 'process', timestamp '1998-01-02 03:04:05'
        from d_feed where op = 'insert'""",
    "refused_changes": """select o_orderkey * 10 + 5 as seq,
        case o_orderkey % 6 when 4 then null when 5 then -o_orderkey - 1 else o_orderkey end as id,
        case o_orderkey % 6 when 2 then 'DELETE' when 4 then 'delete' when 5 then 'insert' else 'update' end as op,
        case o_orderkey % 6 when 0 then 'quantity cannot be read' when 2 then 'unknown op'
          when 3 then 'unknown column colour' when 4 then 'id is null' else 'customer_name is null' end as reason
        from orders where o_orderstatus = 'O'""",
    "delete_products_refused": """select id as seq, id, 'orders name this product' as reason from d_products p
        where exists (select 1 from d_orders o where o.product_id = p.id)""",
    "reprice_touched": f"""select o.id, {money('o.total_price', 'total_price')},
        {money('coalesce(p.price * o.quantity, 0) + coalesce(o.shipping_fee, 0)', 'computed_total')}
        from d_orders o left join d_products p on o.product_id = p.id
        where o.id in (select id from d_feed where op = 'update')""",
    "product_quarantine": """select id, name, price_text,
        case when name = '' then 'name is missing' else 'price is missing' end as reason
        from d_forms where name = '' or price_text = ''""",
    "save_orders": f"""select id, customer_name, product_id, quantity,
        {money(FORM_TOTAL, 'total_price')}, payment_method, {money('shipping_fee', 'shipping_fee')}, notes, status,
        coalesce(chosen, timestamp '1998-08-15 10:00:00') as created_at from d_order_forms where reason is null""",
    "save_orders_refused": "select id, reason from d_order_forms where reason is not null",
    "save_orders_closed_date": """select id, coalesce(reason, 'order_date is not open') as reason from d_order_forms
        where reason is not null or (chosen is not null
          and strftime(chosen, '%Y-%m-%d') not in (select date from d_open_dates))""",
    "save_expenses": f"""select purchase as id, 'Item ' || cast(l_linenumber as varchar) as name,
        amount, cast(case when l_linenumber = 3 then 0 else price end as double) as price,
        cast(null as varchar) as category, '' as notes,
        case when l_linenumber = 4 then date_trunc('day', created_at) + to_hours(12 - 7)
             else timestamp '1998-08-15 10:00:00' end as created_at
        from bought where l_linenumber not in (2, 5)""",
    "save_expenses_refused": """select purchase as id,
        case l_linenumber when 2 then 'amount is no whole number' else 'expense_date is no date' end as reason
        from bought where l_linenumber in (2, 5)""",
    "edit_expenses": """select id, case when l_linenumber in (2, 5) then name else 'Item ' || cast(l_linenumber as varchar) end as name,
        e.amount, cast(case when l_linenumber = 3 then 0 else e.price end as double) as price, category,
        case when l_linenumber in (2, 5) then null else '' end as notes,
        case when l_linenumber = 4 then date_trunc('day', e.created_at) + to_hours(12 - 7) else e.created_at end as created_at
        from d_expenses e join bought on purchase = id""",
    "edit_products": f"""select p.id, case when f.id is null then p.name else f.name end as name,
        cast(case when f.id is null then p.price else {PRICE_INPUT} end as double) as price, description, created_at
        from d_products p left join (select * from d_forms where name <> '' and price_text not in ('', 'abc')) f on f.id = p.id""",
    "save_products": f"""select id, name, {money(PRICE_INPUT, 'price')}, cast(null as varchar) as description,
        timestamp '1998-08-15 10:00:00' as created_at
        from d_forms where name <> '' and price_text <> '' and price_text <> 'abc'""",
    "edit_orders": f"""select o.id, coalesce(f.customer_name, o.customer_name) as customer_name,
        case when f.id is null then o.product_id else f.product_id end as product_id,
        coalesce(f.quantity, o.quantity) as quantity,
        cast(coalesce(f.unit_price * f.quantity + f.shipping_fee, o.total_price) as double) as total_price,
        coalesce(f.payment_method, o.payment_method) as payment_method,
        cast(case when f.id is null then o.shipping_fee else f.shipping_fee end as double) as shipping_fee,
        case when f.id is null then o.notes else f.notes end as notes,
        coalesce(f.status, o.status) as status, coalesce(f.chosen, o.created_at) as created_at
        from d_orders o left join (select * from d_order_forms where reason is null) f on o.id = f.id""",
    "report_summary_month": summary(MONTH, "Aug 1998"),
    "report_summary_year": summary(YEAR, "Year 1998"),
    "report_period_choice": summary(CHOSEN, "Mar 1997"),
    "report_overview": f"""select bucket, name, {money('revenue', 'revenue')}, {money('expenses', 'expenses')},
        cast(sum(revenue) over () as double) as total_revenue, cast(sum(expenses) over () as double) as total_expenses,
        cast(sum(revenue) over () - sum(expenses) over () as double) as profit
        from (select bucket, {MONTH_NAME} as name, coalesce(r, 0) as revenue, coalesce(e, 0) as expenses
          from (select cast(range as integer) as bucket from range(1, 13)) s
          left join (select cast(month(created_at) as integer) as bucket, sum(revenue) as r, sum(expenses) as e
                     from {flows(YEAR)} group by 1) a using (bucket)) x""",
    "report_counts": f"""select (select count(*) from d_orders where {YEAR}) as order_rows,
        (select count(*) from d_expenses where {YEAR}) as expense_rows""",
    "report_summary_rows": f"""select cast(line as integer) as line, metric, value from (
          select unnest([1, 2, 3, 4]) as line,
            unnest(['Period', 'Total Revenue (excl. shipping)', 'Total Expenses', 'Net Profit']) as metric,
            unnest(['Aug 1998', {rupiah('r')}, {rupiah('e')}, {rupiah('r - e')}]) as value
          from (select sum(revenue) as r, sum(expenses) as e from {flows(MONTH)}) t) u""",
    "report_summary_sheet": f"""select cast(line as integer) as line, metric, value from (
          select unnest([1, 2, 3, 4, 5, 6, 7]) as line,
            unnest(['Financial Report — Year 1998', '', 'Metric', 'Period', 'Total Revenue (excl. shipping)',
                    'Total Expenses', 'Net Profit']) as metric,
            unnest(['', '', 'Value', 'Year 1998', cast(cast(r as decimal(38,2)) as varchar),
                    cast(cast(e as decimal(38,2)) as varchar), cast(cast(r - e as decimal(38,2)) as varchar)]) as value
          from (select sum(revenue) as r, sum(expenses) as e from {flows(YEAR)}) t) u""",
    "report_order_rows": f"""select {NUMBER}, {short_date()} as "Date", customer_name as "Customer", quantity as "Qty",
        {rupiah(REV)} as "Revenue", {rupiah('shipping_fee')} as "Shipping",
        {dash('upper(payment_method)')} as "Payment", {STATUS} as "Status", {dash('notes')} as "Notes"
        from d_orders where {MONTH}""",
    "report_order_sheet": f"""select {NUMBER}, {short_date()} as "Date", customer_name as "Customer", quantity as "Qty",
        {money(REV, '"Revenue (excl. shipping)"')}, {money('coalesce(shipping_fee, 0)', '"Shipping"')},
        {money('total_price', '"Total"')}, {dash('upper(payment_method)')} as "Payment", {STATUS} as "Status",
        coalesce(notes, '') as "Notes" from d_orders where {YEAR}""",
    "report_expense_rows": f"""select {NUMBER}, {short_date()} as "Date", name as "Item", amount as "Qty",
        {rupiah('price')} as "Price", {dash('notes')} as "Notes" from d_expenses where {MONTH}""",
    "report_expense_sheet": f"""select {NUMBER}, {short_date()} as "Date", name as "Item", amount as "Qty",
        {money('price', '"Price"')}, coalesce(notes, '') as "Notes" from d_expenses where {YEAR}""",
    "dashboard_overview": overview(31, "cast(bucket as varchar)", MONTH, "day(created_at)"),
    "dashboard_overview_year": overview(12, MONTH_NAME, YEAR, "month(created_at)"),
}

SQL["merge_months"] = SQL["apply_changes"]
SQL["recent_orders_stored"] = SQL["recent_orders"]
SQL["kpis_after_changes"] = f"""select count(*) as orders, cast(sum(quantity) as bigint) as pcs,
    {total("cast(total_price as decimal(18,2)) - coalesce(cast(shipping_fee as decimal(18,2)), 0)", "revenue")},
    {total("coalesce(cast(shipping_fee as decimal(18,2)), 0)", "shipping")}, {total("cast(total_price as decimal(18,2))", "gross")}
    from ({SQL["apply_changes"]}) where {YEAR}"""

ORACLE_SQL = {name: DOMAIN + body for name, body in SQL.items()}
