"""History queries, reports and generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import paging, reports, search
from ledgerline.operators.numbering import number_rows
from ledgerline.sources import synthetic as syn
from suite.files import CUSTOMER
from suite.registry import query, table


# --- filters, projection, sort, pages --------------------------------------

@query("optional_filters", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def optional_filters(spark, folder):
    return search.optional_filters(
        table(spark, folder, "orders"), o_orderstatus="F", o_custkey=None, o_orderpriority="5-LOW"
    )


@query("search_ilike", """
SELECT 'customer' AS found_in, c_custkey AS id FROM customer WHERE c_name ILIKE '%BuIl%' OR c_mktsegment ILIKE '%BuIl%'
UNION ALL
SELECT 'part', p_partkey FROM part WHERE p_name ILIKE '%RED%' OR p_type ILIKE '%RED%'""")
def search_ilike(spark, folder):
    customers = search.search_ilike(table(spark, folder, "customer"), ["c_name", "c_mktsegment"], "BuIl")
    parts = search.search_ilike(table(spark, folder, "part"), ["p_name", "p_type"], "RED")
    return customers.select(F.lit("customer").alias("found_in"), F.col("c_custkey").alias("id")).unionByName(
        parts.select(F.lit("part").alias("found_in"), F.col("p_partkey").alias("id"))
    )


@query("search_like_ordinals", "SELECT * FROM customer WHERE c_name LIKE '%12%' OR c_mktsegment LIKE '%12%'")
def search_like_ordinals(spark, folder):
    return search.search_columns(table(spark, folder, "customer"), [1, 4], "12")


@query("project_columns", "SELECT c_name, c_custkey, c_mktsegment FROM customer")
def project_columns(spark, folder):
    return table(spark, folder, "customer").select("c_name", "c_custkey", "c_mktsegment")


@query("order_by_ordinals", """
SELECT *, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS place FROM customer""")
def order_by_ordinals(spark, folder):
    customers = table(spark, folder, "customer")
    return number_rows(customers, search.ordering(customers, [4, 0, 3, 1, 0, 0, 1]), "place")


@query("history_page", """
SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_name LIKE '%1%' OR c_mktsegment LIKE '%1%'
ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 33 OFFSET 33""")
def history_page(spark, folder):
    return search.history_page(
        table(spark, folder, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"], [1, 2], "1",
        order=[2, 0, 3, 1, 0, 0], number=2, size=33,
    )


@query("deep_history_page", """
SELECT l_orderkey, l_shipdate, l_extendedprice, l_linenumber FROM lineitem
ORDER BY l_shipdate DESC, l_orderkey, l_extendedprice, l_linenumber LIMIT 33 OFFSET 39567""")
def deep_history_page(spark, folder):
    """A page far into all line items."""
    return paging.deep_history_page(
        table(spark, folder, "lineitem"), ["l_orderkey", "l_shipdate", "l_extendedprice", "l_linenumber"],
        order=[1, 1, 0, 0], number=1200, size=33)


@query("history_all", """
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name LIKE '%1%'""")
def history_all(spark, folder):
    return search.history_page(table(spark, folder, "customer"), ["c_custkey", "c_name", "c_mktsegment"], [1], "1", size=0)


@query("users_page", """
SELECT * FROM (SELECT * FROM customer WHERE c_name ILIKE '%customer%' OR c_mktsegment ILIKE '%customer%'
ORDER BY c_custkey DESC LIMIT 33 OFFSET 66)""")
def users_page(spark, folder):
    return search.entity_page(table(spark, folder, "customer"), ["c_name", "c_mktsegment"], "customer",
                              order_by="c_custkey", direction="desc", number=3)


@query("products_page", """
SELECT * FROM part WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%' ORDER BY p_partkey LIMIT 12""")
def products_page(spark, folder):
    return search.entity_page(table(spark, folder, "part"), ["p_name", "p_type"], "ring", order_by="p_partkey", size=12)


@query("total_for_paging", "SELECT count(*) AS total FROM customer")
def total_for_paging(spark, folder):
    return search.total_for_paging(table(spark, folder, "customer"))


@query("last_runs", """
SELECT event_id, ts, user_id, event_type FROM events WHERE user_id = 8 ORDER BY event_id DESC LIMIT 10""")
def last_runs(spark, folder):
    runs = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    return search.last_runs(runs, "event_id", user_id=8)


# --- orders, batches, users ------------------------------------------------

def order_rows(spark, folder):
    return search.rename_to(table(spark, folder, "orders"), {
        "o_orderkey": "id", "o_custkey": "user_id", "o_orderdate": "start_time",
    }).withColumn("batch_id", F.datediff("start_time", F.lit("1970-01-01")).cast("bigint"))


def user_rows(spark, folder):
    return search.rename_to(table(spark, folder, "customer"), {
        "c_custkey": "id", "c_name": "name", "c_mktsegment": "email",
    })


def running_batch(spark, folder):
    """The batch of the newest orders: one row."""
    newest = table(spark, folder, "orders").agg(F.max("o_orderdate").alias("day"))
    return newest.select(F.datediff("day", F.lit("1970-01-01")).cast("bigint").alias("batch_id"),
                         F.to_date("day").alias("batch_date"))


_BATCH = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"


@query("orders_users_sql", f"""
SELECT o_orderkey AS order_id, {_BATCH} AS batch_id, c_name AS name, c_mktsegment AS email
FROM orders, customer WHERE o_custkey = c_custkey""")
def orders_users_sql(spark, folder):
    return search.orders_with_users(order_rows(spark, folder), user_rows(spark, folder))


_RECENT = """
SELECT o_orderkey AS id, o_orderdate AS start_time, CAST(o_orderdate AS DATE) AS batch_date, c_name AS name
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) AND contains(c_name, '0') ORDER BY o_orderkey DESC LIMIT 33"""


@query("recent_orders", _RECENT)
def recent_orders(spark, folder):
    users = user_rows(spark, folder).withColumnRenamed("id", "user_id")
    return search.recent_orders(order_rows(spark, folder), running_batch(spark, folder), users, query="0")


@query("recent_orders_by_end", """
SELECT o_orderkey AS id, o_orderdate AS start_time, o_orderdate + to_hours(o_custkey % 8) AS end_time,
  CAST(o_orderdate AS DATE) AS batch_date, c_name AS name
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) ORDER BY end_time DESC, o_orderkey DESC LIMIT 5""")
def recent_orders_by_end(spark, folder):
    """The five orders of the running batch that end last."""
    users = user_rows(spark, folder).withColumnRenamed("id", "user_id")
    ended = F.col("start_time") + F.make_dt_interval(hours=(F.col("user_id") % 8).cast("int"))
    orders = order_rows(spark, folder).withColumn("end_time", ended)
    return search.recent_orders(orders, running_batch(spark, folder), users, size=5,
                                sort_by="end_time")


@query("last_order", """
SELECT max(o_orderkey) AS last_order_id FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""")
def last_order(spark, folder):
    return search.last_order(order_rows(spark, folder), running_batch(spark, folder))


@query("order_total", """
SELECT l_orderkey AS order_id,
  CAST(sum(CAST(p_retailprice AS DECIMAL(15,2)) * CAST(l_quantity AS DECIMAL(10,0))) AS DOUBLE) AS total_price
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def order_total(spark, folder):
    items = search.rename_to(table(spark, folder, "lineitem"), {
        "l_orderkey": "order_id", "l_partkey": "product_id", "l_quantity": "quantity",
    })
    products = search.rename_to(table(spark, folder, "part"), {"p_partkey": "product_id", "p_retailprice": "price"})
    return reports.order_total(items, products).withColumn("total_price", F.col("total_price").cast("double"))


# --- shares and the print report -------------------------------------------

_COLOURS = {"view": "green", "error": "red", "click": "orange"}


@query("status_share", """
SELECT event_type AS status, count(*) AS rows, round(count(*) / sum(count(*)) OVER () * 2 * 3.14, 9) AS angle,
  CASE event_type WHEN 'view' THEN 'green' WHEN 'error' THEN 'red' WHEN 'click' THEN 'orange' END AS colour
FROM events GROUP BY event_type""")
def status_share(spark, folder):
    shares = reports.status_share(table(spark, folder, "events"), "event_type", _COLOURS)
    return shares.withColumn("angle", F.round("angle", 9))


@query("order_status_share", """
SELECT o_orderstatus AS status, count(*) AS rows, round(count(*) / sum(count(*)) OVER () * 2 * 3.14, 9) AS angle
FROM orders GROUP BY o_orderstatus""")
def order_status_share(spark, folder):
    shares = reports.status_share(table(spark, folder, "orders"), "o_orderstatus")
    return shares.select("status", "rows", F.round("angle", 9).alias("angle"))


@query("running_share", """
WITH shares AS (
  SELECT event_type AS status, count(*) / sum(count(*)) OVER () * 2 * 3.14 AS angle FROM events GROUP BY event_type)
SELECT status, round(coalesce(sum(angle) OVER (ORDER BY status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9)
  AS start_angle, round(sum(angle) OVER (ORDER BY status ROWS UNBOUNDED PRECEDING), 9) AS end_angle
FROM shares""")
def running_share(spark, folder):
    shares = reports.running_share(reports.status_share(table(spark, folder, "events"), "event_type"))
    return shares.select("status", F.round("start_angle", 9).alias("start_angle"), F.round("end_angle", 9).alias("end_angle"))


_REPORT_CELLS = " || ".join(
    f"rpad(substr({text}, 1, 20), 25, ' ')"
    for text in ("CAST(c_custkey AS VARCHAR)", "c_name", "CAST(c_nationkey AS VARCHAR)",
                 "CAST(c_acctbal AS VARCHAR)", "c_mktsegment")
)


@query("paged_report", f"""
WITH numbered AS (
  SELECT row_number() OVER (ORDER BY c_custkey) AS row_no, {_REPORT_CELLS} AS line FROM customer),
headed AS (SELECT * FROM numbered WHERE row_no = 1 OR row_no % 10 = 0)
SELECT row_no, 0 AS part, lpad('page_number=' || CAST(row_no // 10 + 1 AS VARCHAR), 100, '*') AS line FROM headed
UNION ALL SELECT row_no, 1, '{"".join(c.ljust(25) for c in CUSTOMER)}' FROM headed
UNION ALL SELECT row_no, 2, repeat('-', 100) FROM headed
UNION ALL SELECT row_no, CASE WHEN row_no = 1 OR row_no % 10 = 0 THEN 3 ELSE 0 END, line FROM numbered""")
def paged_report(spark, folder):
    return reports.paged_report(table(spark, folder, "customer"), CUSTOMER, ["c_custkey"])


# --- generated rows --------------------------------------------------------

def _draw(row, name, size):
    digest = f"md5(concat_ws('|', '0', '{name}', CAST({row} AS VARCHAR)))"
    return f"(CAST(('0x' || substr({digest}, 1, 12)) AS BIGINT) % {size})"


def _pick(row, name, words):
    items = ", ".join(f"'{w}'" for w in words)
    return f"list_extract([{items}], CAST({_draw(row, name, len(words))} + 1 AS BIGINT))"


_FIXED = [syn.FixedColumn("account", "int", 10), syn.FixedColumn("branch", "int", 4),
          syn.FixedColumn("amount", "float", 12), syn.FixedColumn("holder", "str", 16),
          syn.FixedColumn("opened", "date", 10), syn.FixedColumn("touched", "datetime", 19)]
_DAYS = "date_diff('day', DATE '1970-01-01', DATE '2024-01-01')"


@query("synthetic_fixed_records", f"""
WITH numbered AS (SELECT o_orderkey + 1 AS row_no FROM orders)
SELECT lpad(CAST(row_no AS VARCHAR), 10, '0') AS account,
  lpad(CAST({_draw('row_no', 'branch', 1000000)} + 1 AS VARCHAR), 4, '0') AS branch,
  right(lpad(CAST({_draw('row_no', 'amount/whole', 100000000000000)} AS VARCHAR) || '.' ||
    lpad(CAST({_draw('row_no', 'amount/cents', 100)} AS VARCHAR), 2, '0'), 20, '0'), 12) AS amount,
  rpad({_pick('row_no', 'holder/first', syn.FIRST_NAMES)} || ' ' || {_pick('row_no', 'holder/last', syn.LAST_NAMES)}, 16, ' ')
    AS holder,
  strftime(make_timestamp({_draw('row_no', 'opened', f'({_DAYS} * 86400)')} * 1000000), '%Y-%m-%d') AS opened,
  strftime(make_timestamp({_draw('row_no', 'touched', f'({_DAYS} * 86400)')} * 1000000), '%Y-%m-%d %H:%M:%S') AS touched
FROM numbered""")
def synthetic_fixed_records(spark, folder):
    numbered = table(spark, folder, "orders").select((F.col("o_orderkey") + 1).alias("row_no"))
    return syn.fixed_records(numbered, _FIXED, "2024-01-01")


_GENERATED_ORDERS = f"""bounds AS (
  SELECT CAST(min(o_orderdate) AS DATE) AS first_day,
    date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 AS days FROM orders),
generated AS (
  SELECT id, {_draw('id', 'order/user', '(SELECT count(*) FROM customer)')} + 1 AS user_id,
    first_day + CAST({_draw('id', 'order/day', 'days')} AS INTEGER) AS day,
    {_draw('id', 'order/hour', 6)} + 8 AS hour, {_draw('id', 'order/seconds', 201)} + 50 AS seconds
  FROM (SELECT o_orderkey + 1 AS id FROM orders), bounds)"""


def _generated_orders(spark, folder):
    orders = table(spark, folder, "orders")
    bounds = orders.agg(
        F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"),
    ).first()
    users = table(spark, folder, "customer").count()
    days = (bounds["last_day"] - bounds["first_day"]).days + 1
    numbered = orders.select((F.col("o_orderkey") + 1).alias("row_no"))
    return syn.orders(numbered, users, str(bounds["first_day"]), days)


@query("synthetic_orders", f"""WITH {_GENERATED_ORDERS}
SELECT id, user_id, date_diff('day', DATE '1970-01-01', CAST(day AS DATE)) AS batch_id,
  CAST(day AS TIMESTAMP) + to_hours(CAST(hour AS INTEGER)) AS start_time,
  CAST(day AS TIMESTAMP) + to_hours(CAST(hour AS INTEGER)) + to_seconds(CAST(seconds AS INTEGER)) AS end_time
FROM generated""")
def synthetic_orders(spark, folder):
    return _generated_orders(spark, folder)


@query("synthetic_order_items", f"""
WITH generated AS (
  SELECT id AS order_id, {_draw('id', 'order/items', 6)} + 1 AS items FROM (SELECT o_orderkey + 1 AS id FROM orders)),
each AS (
  SELECT order_id, order_id * 6 + unnest(generate_series(1, items)) - 6 AS id FROM generated)
SELECT id, order_id, {_draw('id', 'item/product', '(SELECT count(*) FROM part)')} + 1 AS product_id,
  {_draw('id', 'item/quantity', 6)} + 1 AS quantity FROM each""")
def synthetic_order_items(spark, folder):
    return syn.order_items(_generated_orders(spark, folder), table(spark, folder, "part").count())


@query("synthetic_batches", f"""
WITH days AS (
  SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS batch_date FROM orders),
numbered AS (SELECT batch_date, date_diff('day', DATE '1970-01-01', batch_date) AS id FROM days)
SELECT id, batch_date, 'completed' AS status, CAST(batch_date AS TIMESTAMP) + INTERVAL 7 HOUR AS start_time,
  CAST(batch_date AS TIMESTAMP) + INTERVAL 17 HOUR + to_seconds(CAST({_draw('id', 'batch/late', 3600)} AS INTEGER)) AS end_time
FROM numbered""")
def synthetic_batches(spark, folder):
    bounds = table(spark, folder, "orders").agg(
        F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day")
    )
    return syn.batches(bounds)


@query("synthetic_users", f"""
SELECT id, {_pick('id', 'user/first', syn.FIRST_NAMES)} || ' ' || {_pick('id', 'user/last', syn.LAST_NAMES)} AS name,
  lower({_pick('id', 'user/first', syn.FIRST_NAMES)}) || '.' || CAST(id AS VARCHAR) || '@example.com' AS email,
  '555-' || lpad(CAST({_draw('id', 'user/phone', 10000)} AS VARCHAR), 4, '0') AS phone_number
FROM (SELECT c_custkey + 1 AS id FROM customer)""")
def synthetic_users(spark, folder):
    return syn.users(table(spark, folder, "customer").select((F.col("c_custkey") + 1).alias("row_no")))


@query("synthetic_products", f"""
SELECT id, 'Product ' || CAST(id AS VARCHAR) AS name, {_draw('id', 'product/cents', 100000)} / 100 AS price
FROM (SELECT p_partkey + 1 AS id FROM part)""")
def synthetic_products(spark, folder):
    made = syn.products(table(spark, folder, "part").select((F.col("p_partkey") + 1).alias("row_no")))
    return made.withColumn("price", F.col("price").cast("double"))


@query("synthetic_category_links", f"""
SELECT id, {_draw('id', 'link/product', '(SELECT count(*) FROM part)')} + 1 AS product_id,
  {_draw('id', 'link/category', len(syn.CATEGORY_NAMES))} + 1 AS category_id,
  {_pick('id', 'link/category', syn.CATEGORY_NAMES)} AS category_name
FROM (SELECT p_partkey + 1 AS id FROM part)""")
def synthetic_category_links(spark, folder):
    numbered = table(spark, folder, "part").select((F.col("p_partkey") + 1).alias("row_no"))
    return syn.category_links(numbered, table(spark, folder, "part").count())
