"""File queries: frames, records, padding, tokens, masks, checks and file jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.functions import lines as ln
from ledgerline.functions.tokens import render
from ledgerline.operators import quality, search
from ledgerline.session import scratch_path
from ledgerline.sinks.framed import fill_column_names, frame_output, write_lines
from ledgerline.sinks.records import delimited_lines, fixed_width_lines
from ledgerline.sources.framed import open_framed, sorted_data_lines
from ledgerline.sources.multiline import read_delimited_multiline
from ledgerline.sources.records import (
    malformed_lines, normalise_delimiters, read_delimited, read_fixed_width, split_normalised,
)
from ledgerline.sources.tables import row_count
from suite.registry import query, table

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
WIDTHS, ALIGNMENTS = [10, 22, 5, 12, 15], ["<", "^", ">", ">", "<"]
ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

BATCH_DATE = dt.date(2024, 3, 9)
ORDER_HEADERS = ["FILENAME=orders BATCH_DATE=¶BDATE•date•YYYY-MM-DD¶", "AUTOPOPULATECOLNAMES"]
ORDER_TRAILERS = ["RECORDCOUNT=¶DATALINECOUNT•int•08d¶", "LINECOUNT=¶EXPECTEDFILELINECOUNT•int•08d¶"]

# SQL: lines of orders and customers.
ORDER_LINE = """concat_ws(',', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
  CAST(o_totalprice AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority)"""
ORDER_FRAME = f"""framed AS (
  SELECT 'header' AS section, 1 AS ordinal, 'FILENAME=orders BATCH_DATE=2024-03-09' AS value
  UNION ALL SELECT 'header', 2, '{",".join(ORDER)}'
  UNION ALL SELECT 'data', row_number() OVER (ORDER BY o_orderkey), {ORDER_LINE} FROM orders
  UNION ALL SELECT 'trailer', 1, printf('RECORDCOUNT=%08d', count(*)) FROM orders
  UNION ALL SELECT 'trailer', 2, printf('LINECOUNT=%08d', count(*) + 4) FROM orders),
placed AS (
  SELECT section, CAST(ordinal AS BIGINT) AS ordinal, value,
    CAST(ordinal + CASE section WHEN 'header' THEN 0 WHEN 'data' THEN 2 ELSE 2 + (SELECT count(*) FROM orders) END
      AS BIGINT) AS line_no,
    (SELECT count(*) FROM orders) + 4 AS total_lines
  FROM framed)"""


def _quoted(cells, sep="|", quote='"'):
    parts = [f"'{quote}' || replace(replace({c}, '\\', '\\\\'), '{quote}', '{quote}{quote}') || '{quote}'" for c in cells]
    return f" || '{sep}' || ".join(parts)


CUSTOMER_CELLS = ["CAST(c_custkey AS VARCHAR)", "c_name", "CAST(c_nationkey AS VARCHAR)",
                  "CAST(c_acctbal AS VARCHAR)", "c_mktsegment"]


def _sql_pad(text, width, align):
    missing = f"greatest({width} - length({text}), 0)"
    if align == "<":
        return f"{text} || repeat(' ', {missing})"
    if align == ">":
        return f"repeat(' ', {missing}) || {text}"
    return f"repeat(' ', {missing} // 2) || {text} || repeat(' ', {missing} - {missing} // 2)"


FIXED_CUSTOMER = " || ".join(_sql_pad(c, w, a) for c, w, a in zip(CUSTOMER_CELLS, WIDTHS, ALIGNMENTS))
CUSTOMER_TEXT = ", ".join(f"{cell} AS {name}" for cell, name in zip(CUSTOMER_CELLS, CUSTOMER))


def order_file(spark, folder):
    """Orders as a framed file in key order; returns its path."""
    orders = table(spark, folder, "orders").orderBy("o_orderkey")
    headers = [fill_column_names(h, ORDER) for h in ORDER_HEADERS]
    framed = frame_output(delimited_lines(orders, ORDER), headers, ORDER_TRAILERS, {"BDATE": BATCH_DATE})
    return write_lines(framed, scratch_path(spark, "orders-file"))


def framed_orders(spark, folder):
    return open_framed(spark, order_file(spark, folder), 2, 2, unit="folder")


# --- frames ----------------------------------------------------------------

@query("framed_split", f"WITH {ORDER_FRAME} SELECT section, ordinal, line_no, total_lines, value FROM placed")
def framed_split(spark, folder):
    return framed_orders(spark, folder).lines().drop("unit")


@query("framed_output", f"WITH {ORDER_FRAME} SELECT value FROM framed")
def framed_output(spark, folder):
    orders = table(spark, folder, "orders")
    headers = [fill_column_names(h, ORDER) for h in ORDER_HEADERS]
    return frame_output(delimited_lines(orders, ORDER), headers, ORDER_TRAILERS, {"BDATE": BATCH_DATE})


@query("header_from_schema", f"""
SELECT '"{'"|"'.join(ORDER)}"' AS header, count(*) AS row_count FROM orders""")
def header_from_schema(spark, folder):
    orders = table(spark, folder, "orders")
    header = fill_column_names("AUTOPOPULATECOLNAMES", orders.columns, delimiter="|", header_quote='"')
    return row_count(orders).select(F.lit(header).alias("header"), "row_count")


@query("file_to_file_key_sort", f"""
SELECT row_number() OVER (ORDER BY value) AS place, value FROM (SELECT {ORDER_LINE} AS value FROM orders)""")
def file_to_file_key_sort(spark, folder):
    return sorted_data_lines(framed_orders(spark, folder).lines())


# --- records ---------------------------------------------------------------

@query("write_delimited_lines", f"SELECT {_quoted(CUSTOMER_CELLS)} AS value FROM customer")
def write_delimited_lines(spark, folder):
    return delimited_lines(table(spark, folder, "customer"), CUSTOMER, sep="|", quote='"')


@query("read_delimited", f"SELECT {CUSTOMER_TEXT} FROM customer")
def read_delimited_query(spark, folder):
    lines = delimited_lines(table(spark, folder, "customer"), CUSTOMER, sep="|", quote="🤩")
    return read_delimited(lines, CUSTOMER, sep="|", quote="🤩")


_TEXT_RECORD = ("SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(\"text\", '') AS \"text\", lang, source FROM documents")


@query("read_delimited_quoted_text", _TEXT_RECORD)
def read_delimited_quoted_text(spark, folder):
    columns = ["doc_id", "text", "lang", "source"]
    lines = delimited_lines(table(spark, folder, "documents"), columns, quote='"')
    return read_delimited(lines, columns, quote='"')


@query("read_delimited_multiline", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif("text", '') AS "text", '"' || lang || chr(10) || source || '"' AS origin,
  1 + length("text") - length(replace("text", chr(10), '')) + 1 AS lines FROM documents""")
def read_delimited_multiline_query(spark, folder):
    """Whole texts with their newlines, and a field of quotes and a newline, through a framed file."""
    documents = table(spark, folder, "documents").select("doc_id", "text", F.concat(
        F.lit('"'), "lang", F.lit("\n"), "source", F.lit('"')).alias("origin"))
    columns = documents.columns
    framed = frame_output(delimited_lines(documents, columns, quote='"'), ['DOCUMENTS "', "AUTOPOPULATECOLNAMES"],
                          ["RECORDCOUNT=¶DATALINECOUNT•int•08d¶"])
    path = write_lines(framed, scratch_path(spark, "document-file"))
    return read_delimited_multiline(spark, path, columns, n_head=2, n_tail=1, unit="folder", keep=["lines"])


@query("read_delimited_plain_text", _TEXT_RECORD)
def read_delimited_plain_text(spark, folder):
    columns = ["doc_id", "text", "lang", "source"]
    lines = delimited_lines(table(spark, folder, "documents"), columns)
    return read_delimited(lines, columns)


@query("write_fixed_width_lines", f"SELECT {FIXED_CUSTOMER} AS value FROM customer")
def write_fixed_width_lines(spark, folder):
    return fixed_width_lines(table(spark, folder, "customer"), CUSTOMER, WIDTHS, ALIGNMENTS)


@query("read_fixed_width", f"SELECT {CUSTOMER_TEXT} FROM customer")
def read_fixed_width_query(spark, folder):
    lines = fixed_width_lines(table(spark, folder, "customer"), CUSTOMER, WIDTHS, ALIGNMENTS)
    return read_fixed_width(lines, CUSTOMER, WIDTHS)


def _unescaped(text, mark, by):
    """SQL: replace ``mark`` except after a backslash, which DuckDB's patterns cannot say."""
    return f"replace(replace(replace({text}, '\\{mark}', chr(1)), '{mark}', '{by}'), chr(1), '\\{mark}')"


_ROUGH = "CAST(doc_id AS VARCHAR) || ',\"' || replace(\"text\", '\"', '\\\"') || '\",' || lang || '\\,' || source"


@query("normalise_delimiters", f"""
SELECT split_part(value, '␟', 1) AS doc_id, value
FROM (SELECT {_unescaped(_unescaped('rough', ',', '␟'), '"', '')} AS value FROM (SELECT {_ROUGH} AS rough FROM documents))""")
def normalise_delimiters_query(spark, folder):
    rough = table(spark, folder, "documents").select(F.concat(
        F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('\\"')),
        F.lit('",'), "lang", F.lit("\\,"), "source",
    ).alias("value"))
    clean = normalise_delimiters(rough, ",", '"')
    return clean.select(F.split("value", "␟", -1)[0].alias("doc_id"), "value")


@query("split_normalised", f"SELECT {CUSTOMER_TEXT} FROM customer")
def split_normalised_query(spark, folder):
    lines = delimited_lines(table(spark, folder, "customer"), CUSTOMER, sep="|", quote="🤩")
    return split_normalised(normalise_delimiters(lines, "|", "🤩"), CUSTOMER)


@query("history_export", f"SELECT {', '.join(CUSTOMER[1:])} FROM customer")
def history_export(spark, folder):
    return search.history_export(table(spark, folder, "customer"))


# --- expressions on lines --------------------------------------------------

@query("format_token", """
SELECT o_orderkey, printf('N=%08d', o_orderkey) || ' D=' || strftime(o_orderdate, '%Y%m%d') ||
  printf(' P=%.2f', o_totalprice) || ' S=' || o_orderpriority || repeat(' ', greatest(20 - length(o_orderpriority), 0)) ||
  '|' AS line FROM orders""")
def format_token(spark, folder):
    template = "N=¶KEY•int•08d¶ D=¶DAY•date•YYYYMMDD¶ P=¶PRICE•float•.2f¶ S=¶STATUS•str• <20¶|"
    values = {"KEY": F.col("o_orderkey"), "DAY": F.col("o_orderdate"), "PRICE": F.col("o_totalprice"),
              "STATUS": F.col("o_orderpriority")}
    return table(spark, folder, "orders").select("o_orderkey", render(template, values).alias("line"))


@query("mask_compare", """
SELECT o_orderkey, 'ORDER=' || CAST(o_orderkey AS VARCHAR) || ' AT=' || repeat('🧹', 10) || ' 00:00' AS masked,
  true AS passed FROM orders""")
def mask_compare(spark, folder):
    orders = table(spark, folder, "orders")
    start = F.concat(F.lit("ORDER="), F.col("o_orderkey").cast("string"), F.lit(" AT="))
    expected = F.concat(start, F.lit("🧹" * 10 + " 00:00"))
    actual = F.concat(start, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    masked = ln.mask_line(expected, actual, "🧹")
    return orders.select("o_orderkey", masked.alias("masked"), (masked == expected).alias("passed"))


@query("cut_positions", """
SELECT c_custkey, substr(c_name, 5, 5) || substr(c_name, 14) AS cut, c_name AS whole FROM customer""")
def cut_positions(spark, folder):
    name = F.col("c_name")
    return table(spark, folder, "customer").select(
        "c_custkey", ln.cut_spans(name, ln.spans_of("0,3,9,12")).alias("cut"),
        ln.cut_spans(name, ln.spans_of("ALL")).alias("whole"),
    )


@query("list_json", """
SELECT c_custkey, '["' || c_name || '","' || c_mktsegment || '"]' AS json_text,
  c_name || ',' || c_mktsegment AS list_text, CAST(2 AS BIGINT) AS json_items, CAST(2 AS BIGINT) AS list_items
FROM customer""")
def list_json(spark, folder):
    items = F.array("c_name", "c_mktsegment")
    made = table(spark, folder, "customer").select(
        "c_custkey", ln.list_to_json(items).alias("json_text"), ln.list_to_text(items).alias("list_text")
    )
    return made.select(
        "*", F.size(ln.json_to_list(F.col("json_text"))).cast("bigint").alias("json_items"),
        F.size(ln.text_to_list(F.col("list_text"))).cast("bigint").alias("list_items"),
    )


@query("clean_table_name", "SELECT doc_id, source AS table_name FROM documents")
def clean_table_name(spark, folder):
    full = F.concat(F.lit("[warehouse].[dbo].["), "source", F.lit("]"))
    return table(spark, folder, "documents").select("doc_id", ln.clean_table_name(full).alias("table_name"))


@query("zero_blank_pad", """
SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS zeros, lpad(CAST(c_custkey AS VARCHAR), 2, '0') AS cut_left,
  right(repeat('0', 2) || CAST(c_custkey AS VARCHAR), 2) AS cut_right, rpad(c_mktsegment, 9, ' ') AS blanks
FROM customer""")
def zero_blank_pad(spark, folder):
    number = F.col("c_custkey").cast("string")
    return table(spark, folder, "customer").select(
        "c_custkey", ln.zero_pad(number, 8).alias("zeros"), ln.zero_pad(number, 2).alias("cut_left"),
        ln.zero_pad(number, 2, keep="right").alias("cut_right"), ln.blank_pad(F.col("c_mktsegment"), 9).alias("blanks"),
    )


@query("strip_quotes_commas", """
SELECT doc_id, replace(replace("text", '"', ''), ',', '') AS packed FROM documents""")
def strip_quotes_commas(spark, folder):
    return table(spark, folder, "documents").select("doc_id", ln.strip_quotes_commas(F.col("text")).alias("packed"))


# --- checks of files -------------------------------------------------------

_EXPECTED_HEADERS = ["FILENAME=orders BATCH_DATE=🧹🧹🧹🧹🧹🧹🧹🧹🧹🧹", "wrong,names"]
_EXPECTED_TRAILERS = ["RECORDCOUNT=¶EXPECTEDDATALINECOUNT•int•08d¶", "LINECOUNT=¶FILELINECOUNT•int•08d¶"]


@query("validate_frame", f"""WITH {ORDER_FRAME},
wanted AS (
  SELECT 'header' AS section, 1 AS ordinal, '{_EXPECTED_HEADERS[0]}' AS expected, true AS passed
  UNION ALL SELECT 'header', 2, 'wrong,names', false
  UNION ALL SELECT 'trailer', 1, printf('RECORDCOUNT=%08d', count(*)), true FROM orders
  UNION ALL SELECT 'trailer', 2, printf('LINECOUNT=%08d', count(*) + 4), true FROM orders)
SELECT section, placed.ordinal, expected, value AS actual, passed FROM wanted JOIN placed USING (section, ordinal)""")
def validate_frame(spark, folder):
    files = framed_orders(spark, folder)
    checks = quality.validate_frame(files.frame(), files.counts(), _EXPECTED_HEADERS, _EXPECTED_TRAILERS, "🧹")
    return checks.drop("unit")


@query("reconcile_output", """
SELECT count(*) + 4 AS file_lines, count(*) AS data_lines, count(*) AS processed_rows,
  count(*) + 4 AS expected_file_lines, true AS passed FROM orders""")
def reconcile_output(spark, folder):
    processed = row_count(table(spark, folder, "orders"))
    return quality.reconcile_output(framed_orders(spark, folder).counts(), processed, 2, 2)


@query("reconcile_input", "SELECT count(*) + 4 AS file_lines, count(*) AS expected_data_lines FROM orders")
def reconcile_input(spark, folder):
    return quality.reconcile_input(framed_orders(spark, folder).counts(), 2, 2).drop("unit")


@query("trailer_count_check", """
SELECT 'total' AS label, printf('LINECOUNT=%08d', count(*) + 4) AS last_line, count(*) + 4 AS stated_rows,
  count(*) AS expected_rows, 'N' AS matching FROM orders
UNION ALL
SELECT 'count', printf('RECORDS=%d', count(*)), count(*), count(*), 'Y' FROM customer
UNION ALL
SELECT 'other', printf('RECORDS=%d', count(*)), NULL, count(*), '' FROM customer""")
def trailer_count_check(spark, folder):
    customers = delimited_lines(table(spark, folder, "customer"), CUSTOMER)
    path = write_lines(frame_output(customers, ["customers"], ["RECORDS=¶DATALINECOUNT•int•d¶"]),
                       scratch_path(spark, "customer-file"))
    frame = open_framed(spark, path, 1, 1, unit="folder").frame()
    checks = [("total", quality.trailer_count_check(framed_orders(spark, folder).frame(), "LINECOUNT", 2, 2)),
              ("count", quality.trailer_count_check(frame, "RECORDS", 1, 1)),
              ("other", quality.trailer_count_check(frame, "ROWS", 1, 1))]
    rows = None
    for label, check in checks:
        check = check.select(F.lit(label).alias("label"), "last_line", "stated_rows", "expected_rows", "matching")
        rows = check if rows is None else rows.unionByName(check)
    return rows


@query("malformed_lines", """
SELECT value FROM (SELECT doc_id, '"' || doc_id || '","' || lang || CASE doc_id % 5
  WHEN 0 THEN '"' WHEN 1 THEN '","' || source || '","more"' WHEN 2 THEN '","' || source WHEN 3 THEN '","' || source || '" x"'
  ELSE '","' || source || '"' END AS value FROM documents) WHERE doc_id % 5 < 4""")
def broken_document_lines(spark, folder):
    """Lines of all documents; four in five lack a field, have one more, or have a quote
    that does not close or is followed by more."""
    way = F.col("doc_id") % 5
    more = F.concat(F.lit('","'), F.col("source"))
    lines = table(spark, folder, "documents").select(F.concat(
        F.lit('"'), F.col("doc_id").cast("string"), F.lit('","'), F.col("lang"),
        F.when(way == 0, '"').when(way == 1, F.concat(more, F.lit('","more"'))).when(way == 2, more)
        .when(way == 3, F.concat(more, F.lit('" x"'))).otherwise(F.concat(more, F.lit('"')))).alias("value"))
    return malformed_lines(lines, 3, ",", '"')
