"""Whole jobs: conversions, combinations, extracts, loads, comparisons, streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import search
from ledgerline.operators.skew import lookup_join
from ledgerline.plans import jobs
from ledgerline.plans.layouts import FIXED_WIDTH, CompareSpec, FileLayout, Side, Slice
from ledgerline.session import scratch_path
from ledgerline.sinks import runs
from ledgerline.sinks.tables import DuplicateKeyError
from ledgerline.sources.framed import frame_lines
from ledgerline.streaming import arrivals, kept_pages
from suite import pair
from suite.comparing import report_rows, report_sql
from suite.files import (
    ALIGNMENTS, CUSTOMER, CUSTOMER_CELLS, FIXED_CUSTOMER, WIDTHS, _quoted, _sql_pad,
)
from suite.loading import LINE_KEYS, PART, new_parts, posts_json, small_parts
from suite.registry import query, table
from suite.searching import _RECENT, order_rows, running_batch, user_rows

DAY = {"BDATE": dt.date(2024, 3, 9)}

FIXED = FileLayout(CUSTOMER, FIXED_WIDTH, widths=WIDTHS, alignments=ALIGNMENTS, headers=["yyyyyyyyyyyyyyyyy"], validate=True)
QUOTED = FileLayout(
    CUSTOMER, quote='"', validate=True, header_quote='"', ignore="🧹",
    headers=["FILENAME=customers BATCH_DATE=¶BDATE•date•YYYY-MM-DD¶", "xxxxxxxxxxxxxxxxxxx", "AUTOPOPULATECOLNAMES"],
)
FIXED_COUNTED = FileLayout(
    CUSTOMER, FIXED_WIDTH, widths=WIDTHS, alignments=ALIGNMENTS, headers=["yyyyyyyyyyyyyyyyy"],
    trailers=["RECORDCOUNT=¶DATALINECOUNT•int•08d¶"], validate=True,
)


def written(spark, path, layout):
    n_head, n_tail = layout.frame
    return frame_lines(spark, path, n_head, n_tail, "folder")


# --- user step -------------------------------------------------------------

@query("custom_transform", """
SELECT c_custkey, upper(c_name) AS c_name, c_mktsegment = 'BUILDING' AS in_segment FROM customer""")
def custom_transform(spark, folder):
    return jobs.custom_step(table(spark, folder, "customer"), "suite.steps.tag_segment", segment="BUILDING")


# --- file to file ----------------------------------------------------------

_LINE_NO = "CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT)"


@query("job_fixed_to_delimited", f"""
SELECT CAST(1 AS BIGINT) AS line_no, 'header' AS section, 'FILENAME=customers BATCH_DATE=2024-03-09' AS value
UNION ALL SELECT 2, 'header', 'xxxxxxxxxxxxxxxxxxx'
UNION ALL SELECT 3, 'header', '{",".join(f'"{c}"' for c in CUSTOMER)}'
UNION ALL SELECT {_LINE_NO} + 3, 'data', {_quoted(CUSTOMER_CELLS, ",")} FROM customer""")
def job_fixed_to_delimited(spark, folder):
    source, target = scratch_path(spark, "fixed"), scratch_path(spark, "quoted")
    jobs.write_file(table(spark, folder, "customer"), source, FIXED, DAY, order=["c_custkey"])
    jobs.convert_file(spark, source, FIXED, target, QUOTED, DAY)
    return written(spark, target, QUOTED).select("line_no", "section", "value")


@query("job_delimited_to_fixed", f"""
SELECT CAST(1 AS BIGINT) AS line_no, 'header' AS section, 'yyyyyyyyyyyyyyyyy' AS value
UNION ALL SELECT {_LINE_NO} + 1, 'data', {FIXED_CUSTOMER} FROM customer
UNION ALL SELECT count(*) + 2, 'trailer', printf('RECORDCOUNT=%08d', count(*)) FROM customer""")
def job_delimited_to_fixed(spark, folder):
    source, target = scratch_path(spark, "quoted"), scratch_path(spark, "fixed")
    quoted = FileLayout(CUSTOMER, quote='"', ignore="🧹", validate=True, headers=[
        "FILENAME=customers BATCH_DATE=¶BDATE•date•YYYY-MM-DD¶", "AT=🧹🧹🧹🧹"])
    jobs.write_file(table(spark, folder, "customer"), source, quoted, DAY, order=["c_custkey"])
    jobs.convert_file(spark, source, quoted, target, FIXED_COUNTED, DAY)
    return written(spark, target, FIXED_COUNTED).select("line_no", "section", "value")


ORDER_FILE = FileLayout(["id", "user_id", "batch_id", "start_time"], validate=True,
                        headers=["ORDERS ¶BDATE•date•YYYYMMDD¶", "AUTOPOPULATECOLNAMES", "yyyyyyyyyyyy"],
                        trailers=["RECORDCOUNT=¶DATALINECOUNT•int•08d¶", "LINECOUNT=¶EXPECTEDFILELINECOUNT•int•08d¶"])
ORDER_INPUT = FileLayout(ORDER_FILE.columns, validate=True,
                         headers=["ORDERS ¶BDATE•date•YYYYMMDD¶", "id,user_id,batch_id,start_time", "yyyyyyyyyyyy"],
                         trailers=["RECORDCOUNT=¶EXPECTEDDATALINECOUNT•int•08d¶", "LINECOUNT=¶FILELINECOUNT•int•08d¶"])
USER_FILE = FileLayout(["id", "name", "email"], trailers=["RECORDCOUNT=¶DATALINECOUNT•int•08d¶"], validate=True)
USER_INPUT = FileLayout(USER_FILE.columns, trailers=["RECORDCOUNT=¶EXPECTEDDATALINECOUNT•int•08d¶"], validate=True)
COMBINED = FileLayout(
    ["order_id", "user_name", "email", "batch_id", "start_time"], FIXED_WIDTH, widths=[6, 20, 30, 5, 30],
    alignments=["<"] * 5, headers=["COMBINED", "AUTOPOPULATECOLNAMES", "yyyyyyyyyyyy"],
    trailers=["RECORDCOUNT=¶DATALINECOUNT•int•08d¶"], validate=True,
)


def join_order_and_user_files(orders, users):
    """The join of the two files: one row per user, so a frequent user is no problem. The
    sides are read from lines, which is done once."""
    named = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"), "email")
    return lookup_join(orders, named, ["user_id"], costly=True).select(
        F.col("id").alias("order_id"), "user_name", "email", "batch_id", "start_time"
    )


@query("file_join", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, c_name AS user_name, c_mktsegment AS email,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS VARCHAR) AS batch_id,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS start_time
FROM orders JOIN customer ON o_custkey = c_custkey""")
def file_join(spark, folder):
    orders, users = _order_and_user_files(spark, folder)
    return join_order_and_user_files(
        jobs.read_file(spark, orders, ORDER_INPUT, DAY), jobs.read_file(spark, users, USER_INPUT, DAY)
    )


def _order_and_user_files(spark, folder):
    orders, users = scratch_path(spark, "orders"), scratch_path(spark, "users")
    jobs.write_file(order_rows(spark, folder), orders, ORDER_FILE, DAY)
    jobs.write_file(user_rows(spark, folder), users, USER_FILE, DAY)
    return orders, users


_COMBINED_CELLS = ["CAST(o_orderkey AS VARCHAR)", "c_name", "c_mktsegment",
                   "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS VARCHAR)",
                   "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"]


@query("job_combine_files", f"""
SELECT 'header' AS section, 'COMBINED' AS value
UNION ALL SELECT 'header', '{",".join(COMBINED.columns)}' UNION ALL SELECT 'header', 'yyyyyyyyyyyy'
UNION ALL SELECT 'data', {" || ".join(_sql_pad(c, w, "<") for c, w in zip(_COMBINED_CELLS, COMBINED.widths))}
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'trailer', printf('RECORDCOUNT=%08d', count(*)) FROM orders JOIN customer ON o_custkey = c_custkey""")
def job_combine_files(spark, folder):
    orders, users = _order_and_user_files(spark, folder)
    target = scratch_path(spark, "combined")
    jobs.combine_files(spark, orders, ORDER_INPUT, users, USER_INPUT, join_order_and_user_files, target, COMBINED, DAY)
    return written(spark, target, COMBINED).select("section", "value")


POSTS = FileLayout(
    ["userId", "id", "title", "body"], quote='"', validate=True,
    headers=["POSTS BATCH_DATE=¶BDATE•date•YYYY-MM-DD¶", "AUTOPOPULATECOLNAMES", "yyyyyyyyyyyy"],
    trailers=["RECORDCOUNT=¶DATALINECOUNT•int•08d¶", "LINECOUNT=¶EXPECTEDFILELINECOUNT•int•08d¶"],
)
_POST_CELLS = ["CAST(n_chars AS VARCHAR)", "CAST(doc_id AS VARCHAR)", "source || '-' || lang",
               "replace(\"text\", chr(10), ' ')"]


@query("job_posts_to_file", f"""
SELECT 'header' AS section, 'POSTS BATCH_DATE=2024-03-09' AS value
UNION ALL SELECT 'header', 'userId,id,title,body' UNION ALL SELECT 'header', 'yyyyyyyyyyyy'
UNION ALL SELECT 'data', {_quoted(_POST_CELLS, ",")} FROM documents
UNION ALL SELECT 'trailer', printf('RECORDCOUNT=%08d', count(*)) FROM documents
UNION ALL SELECT 'trailer', printf('LINECOUNT=%08d', count(*) + 5) FROM documents""")
def job_posts_to_file(spark, folder):
    target = scratch_path(spark, "posts")
    jobs.posts_to_file(posts_json(spark, folder), target, POSTS, DAY)
    return written(spark, target, POSTS).select("section", "value")


POSTS_FIXED = FileLayout(POSTS.columns, FIXED_WIDTH, widths=[10, 10, 50, 100], alignments=["<"] * 4,
                         headers=POSTS.headers, trailers=POSTS.trailers, validate=True)


@query("job_posts_to_fixed_file", f"""
SELECT 'header' AS section, 'POSTS BATCH_DATE=2024-03-09' AS value
UNION ALL SELECT 'header', 'userId,id,title,body' UNION ALL SELECT 'header', 'yyyyyyyyyyyy'
UNION ALL SELECT 'data', {" || ".join(_sql_pad(c, w, "<") for c, w in zip(_POST_CELLS, POSTS_FIXED.widths))} FROM documents
UNION ALL SELECT 'trailer', printf('RECORDCOUNT=%08d', count(*)) FROM documents
UNION ALL SELECT 'trailer', printf('LINECOUNT=%08d', count(*) + 5) FROM documents""")
def job_posts_to_fixed_file(spark, folder):
    target = scratch_path(spark, "posts")
    jobs.posts_to_file(posts_json(spark, folder), target, POSTS_FIXED, DAY)
    return written(spark, target, POSTS_FIXED).select("section", "value")


EXTRACT = FileLayout(
    ["order_id", "batch_id", "name", "email"], quote="🤣", validate=True,
    headers=["FILENAME=extract BATCH_DATE=¶BDATE•date•YYYY-MM-DD¶", "AUTOPOPULATECOLNAMES", "xxxxxxxxxxxx"],
    trailers=["RECORDCOUNT=¶DATALINECOUNT•int•08d¶", "LINECOUNT=¶EXPECTEDFILELINECOUNT•int•08d¶"],
)
_EXTRACT_CELLS = [_COMBINED_CELLS[0], _COMBINED_CELLS[3], "c_name", "c_mktsegment"]


@query("job_extract", f"""
SELECT 'header' AS section, 'FILENAME=extract BATCH_DATE=2024-03-09' AS value
UNION ALL SELECT 'header', 'order_id,batch_id,name,email' UNION ALL SELECT 'header', 'xxxxxxxxxxxx'
UNION ALL SELECT 'data', {_quoted(_EXTRACT_CELLS, ",", "🤣")} FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'trailer', printf('RECORDCOUNT=%08d', count(*)) FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'trailer', printf('LINECOUNT=%08d', count(*) + 5) FROM orders JOIN customer ON o_custkey = c_custkey""")
def job_extract(spark, folder):
    target = scratch_path(spark, "extract")
    rows = search.orders_with_users(order_rows(spark, folder), user_rows(spark, folder))
    jobs.extract_to_file(rows, target, EXTRACT, DAY, costly=True)
    return written(spark, target, EXTRACT).select("section", "value")


# --- file to table ---------------------------------------------------------

PART_FILE = FileLayout(PART, delimiter="|", quote="🤩", validate=True, ignore="🧹",
                       headers=["FILENAME=parts BATCH_DATE=¶BDATE•date•YYYY-MM-DD¶", "AUTOPOPULATECOLNAMES", "CREATED=now"],
                       header_delimiter=",", header_quote='"',
                       trailers=["RECORDCOUNT=¶DATALINECOUNT•int•08d¶", "LINECOUNT=¶EXPECTEDFILELINECOUNT•int•08d¶"])
PART_INPUT = FileLayout(PART, delimiter="|", quote="🤩", validate=True, ignore="🧹",
                        headers=["FILENAME=parts BATCH_DATE=¶BDATE•date•YYYY-MM-DD¶",
                                 ",".join(f'"{c}"' for c in PART), "CREATED=🧹🧹🧹"],
                        trailers=["RECORDCOUNT=¶EXPECTEDDATALINECOUNT•int•08d¶", "LINECOUNT=¶FILELINECOUNT•int•08d¶"])


def _loaded(spark, folder, load_type, keys=()):
    source, target = scratch_path(spark, "parts-file"), scratch_path(spark, "part")
    jobs.write_file(new_parts(spark, folder), source, PART_FILE, DAY)
    small_parts(spark, folder).write.parquet(target)
    jobs.load_file(spark, source, PART_INPUT, target, load_type, keys, DAY)
    return spark.read.parquet(target)


@query("job_load", """
SELECT * REPLACE (p_retailprice + CASE WHEN p_size >= 20 THEN 10 ELSE 0 END AS p_retailprice) FROM part""")
def job_load(spark, folder):
    return _loaded(spark, folder, "merge_and_load", ["p_partkey"])


@query("job_load_append", """
SELECT * FROM part WHERE p_size <= 30
UNION ALL SELECT * REPLACE (p_retailprice + 10 AS p_retailprice) FROM part WHERE p_size >= 20""")
def job_load_append(spark, folder):
    return _loaded(spark, folder, "append_load")


# --- comparisons -----------------------------------------------------------

SIDE_FILE = FileLayout(pair.COLUMNS, quote='"', headers=["ORDERS"], trailers=["RECORDS=¶DATALINECOUNT•int•d¶"])


@query("job_compare_files", report_sql("CAST(o_orderkey AS VARCHAR)"))
def job_compare_files(spark, folder):
    paths = []
    for name, side in zip(("left", "right"), pair.both_sides(spark, folder)):
        paths.append(jobs.write_file(side, scratch_path(spark, name), SIDE_FILE))
    label = Side(trailer_label="RECORDS")
    spec = CompareSpec("orders files", pair.KEYS, left=label, right=label, strict=True)
    report = jobs.compare_files(spark, paths[0], SIDE_FILE, paths[1], SIDE_FILE, spec, scratch_path(spark, "report"))
    return report_rows(spark, report)


@query("job_compare_tables", report_sql())
def job_compare_tables(spark, folder):
    spec = CompareSpec("orders tables", pair.KEYS, strict=True,
                       left=Side(where="o_orderkey >= 0"), right=Side(where="o_orderkey IS NOT NULL"))
    report = jobs.compare_tables(*pair.both_sides(spark, folder), spec, scratch_path(spark, "report"))
    return report_rows(spark, report)


@query("run_history", f"""WITH {pair.SAME}
SELECT 'orders tables' AS name, 'finished' AS status, (SELECT count(*) FROM l) AS left_rows,
  (SELECT count(*) FROM r) AS right_rows, (SELECT count(*) FROM same) AS same_keys,
  (SELECT count(*) FROM l JOIN r USING (o_orderkey)) - (SELECT count(*) FROM same) AS changed_keys, true AS has_report
UNION ALL
SELECT 'lines', CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 'finished' ELSE 'failed' END,
  CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN count(*) END,
  CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN count(*) END,
  CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN count(*) END,
  CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 0 END,
  count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def run_history(spark, folder):
    """Two comparisons leave their runs; the strict one of lines fails where their keys repeat."""
    log = scratch_path(spark, "runs")
    orders = CompareSpec("orders tables", pair.KEYS, strict=True)
    jobs.compare_tables(*pair.both_sides(spark, folder), orders, scratch_path(spark, "report"), log)
    lines = table(spark, folder, "lineitem")
    try:
        jobs.compare_tables(lines, lines, CompareSpec("lines", LINE_KEYS, strict=True), scratch_path(spark, "report"), log)
    except DuplicateKeyError:
        pass
    newest = search.last_runs(runs.run_states(runs.read_events(spark, log)), "started_at")
    figures = {"left_rows": "LeftRows", "right_rows": "RightRows", "same_keys": "OverallCommonCount",
               "changed_keys": "OverallCombinedMismatchCount"}
    return newest.select("name", "status", *[F.col("figures")[name].alias(c) for c, name in figures.items()],
                         F.col("report").isNotNull().alias("has_report"))


@query("job_compare_slices", """
SELECT count(*) AS mismatches FROM (
  SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'
    AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-04')
  UNION ALL
  SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-04'
    AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'))""")
def job_compare_slices(spark, folder):
    """Two days of the same table, which share no order."""
    orders = table(spark, folder, "orders")
    spec = CompareSpec(
        "two days", pair.KEYS, exclude=["o_orderpriority"], batch_date=dt.date(1998, 10, 3),
        left=Side(slice=Slice("o_orderdate")),
        right=Side(slice=Slice("o_orderdate", choice="Custom", custom=dt.date(1998, 10, 4))),
    )
    report = jobs.compare_tables(orders, orders, spec, scratch_path(spark, "report"))
    rows = report_rows(spark, report).filter((F.col("section") == "mismatches") & (F.col("column_name") == "o_orderkey"))
    return rows.agg(F.count(F.lit(1)).alias("mismatches"))


# --- streams ---------------------------------------------------------------

@query("file_arrival_ingest", "SELECT * FROM events")
def file_arrival_ingest(spark, folder):
    schema = table(spark, folder, "events").schema
    target = scratch_path(spark, "arrived")
    stream = arrivals.arriving_rows(spark, f"{folder}/events.parquet*", schema)
    arrivals.ingest(stream, target, scratch_path(spark, "stream")).awaitTermination()
    return spark.read.schema(schema).parquet(f"{target}/batch=*")


@query("recent_orders_refresh", _RECENT)
def recent_orders_refresh(spark, folder):
    schema = table(spark, folder, "orders").schema
    batch = running_batch(spark, folder)
    users = user_rows(spark, folder).withColumnRenamed("id", "user_id")
    stream = arrivals.arriving_rows(spark, f"{folder}/orders.parquet*", schema)

    def newest(rows):
        """The 33 newest orders of the running batch; keeps the columns of an order."""
        orders = search.rename_to(rows, {"o_orderkey": "id", "o_custkey": "user_id", "o_orderdate": "start_time"})
        orders = orders.withColumn("batch_id", F.datediff("start_time", F.lit("1970-01-01")).cast("bigint"))
        shown = search.recent_orders(orders, batch, users, query="0").select(F.col("id").alias("o_orderkey"))
        return rows.join(F.broadcast(shown), "o_orderkey", "left_semi")  # at most one page of keys

    target = scratch_path(spark, "pages")
    arrivals.refresh_page(stream, newest, target, scratch_path(spark, "stream")).awaitTermination()
    page = arrivals.latest_page(spark, target, schema)
    orders = search.rename_to(page, {"o_orderkey": "id", "o_custkey": "user_id", "o_orderdate": "start_time"})
    orders = orders.withColumn("batch_id", F.datediff("start_time", F.lit("1970-01-01")).cast("bigint"))
    return search.recent_orders(orders, batch, users, query="0")


@query("recent_orders_from_state", _RECENT)
def recent_orders_from_state(spark, folder):
    """The page of the running batch from the state of a stream of orders with their users."""
    schema = table(spark, folder, "orders").schema
    stream = arrivals.arriving_rows(spark, f"{folder}/orders.parquet*", schema)
    orders = search.rename_to(stream, {"o_orderkey": "id", "o_custkey": "user_id", "o_orderdate": "start_time"})
    named = orders.join(user_rows(spark, folder).select(F.col("id").alias("user_id"), "name"), "user_id")
    named = named.filter(F.col("name").contains("0")).select(
        F.datediff("start_time", F.lit("1970-01-01")).cast("bigint").alias("batch_id"), "id", "start_time",
        F.to_date("start_time").alias("batch_date"), "name", F.date_add("start_time", 1).cast("timestamp").alias("closes"))
    target = scratch_path(spark, "pages")
    pages = kept_pages.newest_rows(named, "batch_id", "closes", ["id"], 33, delay="2 days")
    kept_pages.write_pages(pages, target, scratch_path(spark, "stream")).awaitTermination()
    running = running_batch(spark, folder).first()["batch_id"]
    page = kept_pages.kept_page(spark, target, pages.schema, "batch_id", running)
    return page.select("id", "start_time", "batch_date", "name")
