"""Comparison queries: keys, sketches, extras, cells, summary, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.rowtext import key_text, row_md5, row_sha256, sketch, typed_hash, typed_key
from ledgerline.operators import compare as cmp
from ledgerline.operators.digest_tree import compare_by_digest_tree as digest_tree_diff, write_snapshot
from ledgerline.operators.search import pivot_date, pivot_date_filter
from ledgerline.operators.skew import salted_join, salted_presence
from ledgerline.operators.quality import predicate_is_valid
from ledgerline.session import scratch_path
from ledgerline.sinks.report import (
    META, MISMATCHES, PASSED, SUMMARY, compare_report, read_report, write_report,
)
from ledgerline.sources.tables import row_count, scan_sketch
from suite import pair
from suite.pair import COLUMNS, KEYS, both_sides, left_side
from suite.registry import query, table

LINE_KEYS = ["l_orderkey", "l_linenumber"]


def _aligned(spark, folder):
    return cmp.align(*both_sides(spark, folder), KEYS)


def _sketches(spark, folder):
    return [sketch(side, KEYS, COLUMNS) for side in both_sides(spark, folder)]


# --- summary ---------------------------------------------------------------

@query("compare_summary", f"WITH {pair.SUMMARY} SELECT * FROM summary")
def compare_summary(spark, folder):
    return cmp.summarise(_aligned(spark, folder), KEYS)


@query("compare_summary_unique_keys", f"WITH {pair.SUMMARY} SELECT * FROM summary")
def compare_summary_unique_keys(spark, folder):
    aligned = cmp.align(*both_sides(spark, folder), KEYS, unique_keys=True)
    return cmp.summarise(aligned, KEYS)


@query("compare_summary_differing_rows", f"WITH {pair.SUMMARY} SELECT * FROM summary")
def compare_summary_differing_rows(spark, folder):
    """The same from row hashes first and the rows of differing keys after."""
    left, right = both_sides(spark, folder)
    return cmp.summarise_differences(cmp.align_differing(left, right, KEYS, wide=True), left, right, KEYS)


@query("key_status", f"""WITH {pair.SKETCHES}
SELECT CAST(concatenated_keys AS BIGINT) AS o_orderkey,
  CASE WHEN rk.hash_value IS NULL THEN 'left_only' WHEN lk.hash_value IS NULL THEN 'right_only'
    WHEN lk.hash_value = rk.hash_value THEN 'same' ELSE 'changed' END AS status
FROM lk FULL JOIN rk USING (concatenated_keys)""")
def key_status(spark, folder):
    return cmp.key_status(*both_sides(spark, folder), KEYS).select(*KEYS, "status")


@query("column_mismatch_counts", f"WITH {pair.SUMMARY} SELECT column_name, mismatched FROM summary")
def column_mismatch_counts(spark, folder):
    return cmp.column_mismatch_counts(_aligned(spark, folder), KEYS)


@query("row_counts", f"""WITH {pair.SKETCHES}
SELECT (SELECT count(*) FROM lk) AS left_rows, (SELECT count(*) FROM rk) AS right_rows,
  (SELECT count(*) FROM lk WHERE concatenated_keys NOT IN (SELECT concatenated_keys FROM rk)) AS extra_in_left,
  (SELECT count(*) FROM rk WHERE concatenated_keys NOT IN (SELECT concatenated_keys FROM lk)) AS extra_in_right,
  (SELECT count(*) FROM lk JOIN rk USING (concatenated_keys) WHERE lk.hash_value <> rk.hash_value) AS mismatched_keys,
  (SELECT count(*) FROM lk JOIN rk USING (concatenated_keys, hash_value)) AS common_keys""")
def row_counts(spark, folder):
    return cmp.row_counts(cmp.pair_sketches(*_sketches(spark, folder)))


# --- rows by sketch --------------------------------------------------------

@query("mismatch_rows", f"""WITH {pair.SKETCHES}
SELECT concatenated_keys, lk.hash_value AS left_hash, rk.hash_value AS right_hash
FROM lk JOIN rk USING (concatenated_keys) WHERE lk.hash_value <> rk.hash_value""")
def mismatch_rows(spark, folder):
    return cmp.mismatch_rows(cmp.pair_sketches(*_sketches(spark, folder)))


@query("matching_rows", f"WITH {pair.SKETCHES} SELECT * FROM lk JOIN rk USING (concatenated_keys, hash_value)")
def matching_rows(spark, folder):
    return cmp.matching_pairs(*_sketches(spark, folder))


@query("outer_diff", f"""WITH {pair.SKETCHES}
SELECT concatenated_keys, lk.hash_value AS left_hash, rk.hash_value AS right_hash
FROM lk FULL JOIN rk USING (concatenated_keys) WHERE lk.hash_value IS DISTINCT FROM rk.hash_value""")
def outer_diff(spark, folder):
    return cmp.outer_diff(cmp.pair_sketches(*_sketches(spark, folder)))


@query("compare_by_digest_tree", f"""WITH {pair.SKETCHES}
SELECT concatenated_keys, lk.hash_value AS left_hash, rk.hash_value AS right_hash
FROM lk FULL JOIN rk USING (concatenated_keys) WHERE lk.hash_value IS DISTINCT FROM rk.hash_value""")
def compare_by_digest_tree(spark, folder):
    """From stored digests, down into the ranges that differ."""
    paths = [scratch_path(spark, "snapshot") for _ in range(2)]
    for side, path in zip(both_sides(spark, folder), paths):
        write_snapshot(side, KEYS, path, COLUMNS, form="compatible")
    return digest_tree_diff(spark, *paths)


@query("extra_left", f"WITH {pair.SKETCHES} SELECT * FROM lk WHERE concatenated_keys NOT IN "
                     "(SELECT concatenated_keys FROM rk)")
def extra_left(spark, folder):
    left, right = _sketches(spark, folder)
    return cmp.extra_rows(left, right, ["concatenated_keys"])


@query("extra_right", f"WITH {pair.SKETCHES} SELECT * FROM rk WHERE concatenated_keys NOT IN "
                      "(SELECT concatenated_keys FROM lk)")
def extra_right(spark, folder):
    left, right = _sketches(spark, folder)
    return cmp.extra_rows(right, left, ["concatenated_keys"])


@query("extra_by_columns", """
SELECT * FROM lineitem a WHERE a.l_returnflag = 'R' AND NOT EXISTS (
  SELECT 1 FROM lineitem b WHERE b.l_returnflag <> 'R'
  AND a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)""")
def extra_by_columns(spark, folder):
    lines = table(spark, folder, "lineitem")
    returned, others = lines.filter(F.col("l_returnflag") == "R"), lines.filter(F.col("l_returnflag") != "R")
    return cmp.extra_rows(returned, others, LINE_KEYS)


# A third of the lines name one part; with every part of an even number left out of the
# lookup, lines of frequent and of rare keys are found and missed.
_SKEWED = "CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_partkey END"


def _lines_of_a_hot_part(spark, folder):
    """Lines summed by order, part and supplier: more than a scan."""
    lines = table(spark, folder, "lineitem").withColumn("p_partkey", F.expr(_SKEWED))
    return lines.groupBy("l_orderkey", "p_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))


_HOT_PARTS = f"""
WITH lines AS (
  SELECT l_orderkey, {_SKEWED} AS p_partkey, l_suppkey, sum(l_quantity) AS quantity
  FROM lineitem GROUP BY l_orderkey, 2, l_suppkey)"""


@query("salted_lookup_join", f"""{_HOT_PARTS}
SELECT p_partkey, l_orderkey, l_suppkey, quantity, p_name, p_brand
FROM lines LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 1) USING (p_partkey)""")
def salted_lookup_join(spark, folder):
    named = table(spark, folder, "part").filter("p_partkey % 2 = 1").select("p_partkey", "p_name", "p_brand")
    return salted_join(_lines_of_a_hot_part(spark, folder), named, ["p_partkey"], "left", costly=True)


@query("salted_extra_rows", f"""{_HOT_PARTS}
SELECT * FROM lines WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)""")
def salted_extra_rows(spark, folder):
    even = table(spark, folder, "part").filter("p_partkey % 2 = 0").select("p_partkey")
    return salted_presence(_lines_of_a_hot_part(spark, folder), even, ["p_partkey"], "left_anti", costly=True)


# --- sets of keys ----------------------------------------------------------

@query("except_keys_left", f"WITH {pair.SIDES} SELECT o_orderkey FROM l EXCEPT SELECT o_orderkey FROM r")
def except_keys_left(spark, folder):
    left, right = both_sides(spark, folder)
    return cmp.except_keys(left, right, KEYS)


@query("except_keys_right", f"WITH {pair.SIDES} SELECT o_orderkey FROM r EXCEPT SELECT o_orderkey FROM l")
def except_keys_right(spark, folder):
    left, right = both_sides(spark, folder)
    return cmp.except_keys(right, left, KEYS)


@query("intersect_rows", f"WITH {pair.SKETCHES} SELECT * FROM lk INTERSECT SELECT * FROM rk")
def intersect_rows(spark, folder):
    return cmp.intersect_rows(*_sketches(spark, folder), ["concatenated_keys", "hash_value"])


@query("intersect_count", f"""WITH {pair.SKETCHES}
SELECT count(*) AS row_count FROM (SELECT * FROM lk INTERSECT SELECT * FROM rk)""")
def intersect_count(spark, folder):
    return row_count(cmp.intersect_rows(*_sketches(spark, folder), ["concatenated_keys", "hash_value"]))


@query("union_distinct_keys", f"WITH {pair.SIDES} SELECT o_orderkey FROM l UNION SELECT o_orderkey FROM r")
def union_distinct_keys(spark, folder):
    return cmp.union_distinct_keys(*both_sides(spark, folder), KEYS)


# --- cells -----------------------------------------------------------------

@query("cell_diff", f"WITH {pair.CELLS} SELECT * FROM changed_cells")
def cell_diff(spark, folder):
    return cmp.cell_diff(_aligned(spark, folder), KEYS)


@query("mismatched_fields", f"""WITH {pair.CELLS}
SELECT concatenated_keys, string_agg(column_name, ',' ORDER BY list_position({COLUMNS}, column_name)) AS fields
FROM changed_cells GROUP BY concatenated_keys""")
def mismatched_fields(spark, folder):
    fields = cmp.mismatched_fields(_aligned(spark, folder), KEYS)
    return fields.withColumn("fields", F.array_join("fields", ","))


@query("absent_marker", f"WITH {pair.CELLS} SELECT * FROM extra_cells")
def absent_marker(spark, folder):
    return cmp.absent_cells(_aligned(spark, folder), KEYS)


@query("difference_union", f"WITH {pair.CELLS} SELECT * FROM all_cells")
def difference_union(spark, folder):
    return cmp.difference_union(_aligned(spark, folder), KEYS)


@query("limit_differences", f"""WITH {pair.CELLS}
SELECT * FROM all_cells ORDER BY concatenated_keys, column_name LIMIT 1000""")
def limit_differences(spark, folder):
    return cmp.limit_differences(cmp.difference_union(_aligned(spark, folder), KEYS), 1000)


@query("passed_cells", f"WITH {pair.SAME} {pair.passed_cells_sql('o_orderkey')}")
def passed_cells(spark, folder):
    return cmp.passed_cells(_aligned(spark, folder), KEYS)


@query("flagged_report", f"""WITH {pair.SUMMARY}
SELECT 'summary' AS section, column_name, CAST(NULL AS VARCHAR) AS concatenated_keys,
  mismatched > 0 AS mismatched_flag, extra_in_left > 0 AS extra_in_left_flag,
  extra_in_right > 0 AS extra_in_right_flag, CAST(NULL AS BOOLEAN) AS absent_flag
FROM summary
UNION ALL
SELECT 'cells', column_name, concatenated_keys, NULL, NULL, NULL,
  left_value = 'Does_Not_Exists' OR right_value = 'Does_Not_Exists'
FROM all_cells""")
def flagged_report(spark, folder):
    aligned = _aligned(spark, folder)
    nothing = F.lit(None).cast("boolean")
    summary = cmp.flagged_summary(cmp.summarise(aligned, KEYS)).select(
        F.lit("summary").alias("section"), "column_name", F.lit(None).cast("string").alias("concatenated_keys"),
        "mismatched_flag", "extra_in_left_flag", "extra_in_right_flag", nothing.alias("absent_flag"),
    )
    cells = cmp.flagged_cells(cmp.difference_union(aligned, KEYS)).select(
        F.lit("cells").alias("section"), "column_name", "concatenated_keys", nothing.alias("mismatched_flag"),
        nothing.alias("extra_in_left_flag"), nothing.alias("extra_in_right_flag"), "absent_flag",
    )
    return summary.unionByName(cells)


# --- rows side by side -----------------------------------------------------

@query("side_suffix", "SELECT " + ", ".join(f"{c} AS {c}_x" for c in COLUMNS) + " FROM orders")
def side_suffix(spark, folder):
    return cmp.side_suffix(left_side(spark, folder), COLUMNS, "_x")


@query("merge_on_keys", f"""WITH {pair.SIDES}
SELECT o_orderkey, {", ".join(f"l.{c} AS {c}_x, r.{c} AS {c}_y" for c in COLUMNS if c not in KEYS)}
FROM l JOIN r USING (o_orderkey)""")
def merge_on_keys(spark, folder):
    return cmp.merge_on_keys(cmp.joined_rows(*both_sides(spark, folder), KEYS), KEYS)


@query("three_way_pairs", f"""WITH {pair.CELLS}, listed AS (SELECT DISTINCT concatenated_keys FROM changed_cells)
SELECT concatenated_keys, {", ".join(f"l.{c} AS {c}_x, r.{c} AS {c}_y" for c in COLUMNS)}
FROM l, r, listed
WHERE CAST(l.o_orderkey AS VARCHAR) = concatenated_keys AND l.o_orderkey = r.o_orderkey""")
def three_way_pairs(spark, folder):
    aligned = _aligned(spark, folder)
    listed = aligned.filter(F.col("status") == cmp.CHANGED).select(*KEYS)
    return cmp.three_way_pairs(cmp.joined_rows(*both_sides(spark, folder), KEYS), KEYS, listed)


@query("fetch_by_keys", f"""WITH {pair.CELLS}
SELECT * FROM l WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT concatenated_keys FROM all_cells)""")
def fetch_by_keys(spark, folder):
    left, right = both_sides(spark, folder)
    differing = cmp.align(left, right, KEYS).filter(F.col("status") != cmp.SAME).select(*KEYS)
    return cmp.fetch_by_keys(left, differing, KEYS)


@query("passed_rows", f"WITH {pair.SAME} SELECT * FROM same ORDER BY o_orderkey LIMIT 10")
def passed_rows(spark, folder):
    return cmp.first_rows(cmp.same_rows(*both_sides(spark, folder), KEYS), KEYS)


@query("passed_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def passed_sample(spark, folder):
    return cmp.first_rows(left_side(spark, folder), KEYS)


@query("extra_rows_full", f"WITH {pair.SIDES} SELECT l.* FROM l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r)")
def extra_rows_full(spark, folder):
    left, right = both_sides(spark, folder)
    return cmp.fetch_by_keys(left, cmp.except_keys(left, right, KEYS), KEYS)


# --- columns, predicates, slices -------------------------------------------

@query("common_columns", f"""WITH {pair.SIDES}
SELECT 'left' AS side, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM l
UNION ALL SELECT 'right', o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM r""")
def common_columns(spark, folder):
    left, right = both_sides(spark, folder)
    right = right.withColumnRenamed("o_orderdate", "order_date")
    shared = cmp.common_columns(left, right, exclude=["o_orderpriority"])
    return left.select(F.lit("left").alias("side"), *shared).unionByName(
        right.select(F.lit("right").alias("side"), *shared)
    )


@query("where_filter", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def where_filter(spark, folder):
    return left_side(spark, folder).filter(F.expr("o_orderstatus = 'F' AND o_totalprice > 100000"))


@query("pivot_date_filter", """
SELECT 'time' AS kind, o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'
UNION ALL
SELECT 'text', o_orderkey FROM orders WHERE strftime(o_orderdate, '%d/%m/%y') = '03/10/98'""")
def pivot_date_filter_query(spark, folder):
    orders = left_side(spark, folder)
    day = pivot_date("Custom", custom="1998-10-03")
    by_time = pivot_date_filter(orders, "o_orderdate", day, "YYYY-MM-DD")
    as_text = orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yy").alias("day"))
    by_text = pivot_date_filter(as_text, "day", day, "DD/MM/YY")
    return by_time.select(F.lit("time").alias("kind"), "o_orderkey").unionByName(
        by_text.select(F.lit("text").alias("kind"), "o_orderkey")
    )


@query("validate_where", """
SELECT 'o_totalprice > 1000' AS predicate, true AS is_valid,
  (SELECT count(*) FROM orders WHERE o_totalprice > 1000) AS row_count
UNION ALL SELECT 'no_such_column = 1', false, NULL
UNION ALL SELECT 'o_orderstatus LIKE ''O%''', true, (SELECT count(*) FROM orders WHERE o_orderstatus LIKE 'O%')""")
def validate_where(spark, folder):
    orders = left_side(spark, folder)
    rows = None
    for predicate in ("o_totalprice > 1000", "no_such_column = 1", "o_orderstatus LIKE 'O%'"):
        valid = predicate_is_valid(orders, predicate)
        counted = row_count(orders.filter(F.expr(predicate)) if valid else orders.limit(0))
        row = counted.select(
            F.lit(predicate).alias("predicate"), F.lit(valid).alias("is_valid"),
            (F.col("row_count") if valid else F.lit(None).cast("bigint")).alias("row_count"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


# --- row text and hashes ---------------------------------------------------

_LINE_TEXT = ("concat_ws('', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
              "CAST(l_linenumber AS VARCHAR), CAST(l_quantity AS VARCHAR), "
              "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), l_returnflag)")
_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag"]


@query("concat_key", """
SELECT concat_ws('▼', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS concatenated_keys FROM lineitem""")
def concat_key(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(key_text(lines, LINE_KEYS).alias("concatenated_keys"))


@query("row_md5", f"SELECT md5({_LINE_TEXT}) AS hash_value FROM lineitem")
def row_md5_query(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(row_md5(lines, _LINE_COLUMNS).alias("hash_value"))


@query("row_md5_documents", """
SELECT doc_id, md5(concat_ws('', CAST(doc_id AS VARCHAR), "text", lang, source)) AS hash_value FROM documents""")
def row_md5_documents(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", row_md5(documents, ["doc_id", "text", "lang", "source"]).alias("hash_value"))


@query("row_sha256", f"SELECT sha256({_LINE_TEXT}) AS hash_value FROM lineitem")
def row_sha256_query(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(row_sha256(lines, _LINE_COLUMNS).alias("hash_value"))


_SPARSE = """sparse AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority || 'char(0)' END AS o_orderpriority,
         CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderdate END AS o_orderdate,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS o_day
  FROM orders)"""
_TYPED = """concat_ws('', CAST(o_orderkey AS VARCHAR), coalesce(CAST(o_custkey AS VARCHAR), '0'),
  coalesce(replace(o_orderpriority, 'char(0)', ''), ''),
  coalesce(CAST(o_totalprice AS VARCHAR), '0'),
  coalesce(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '1970-01-01 09:00'),
  coalesce(strftime(o_day, '%Y-%m-%d'), '1970-01-01'))"""


def _sparse_orders(spark, folder):
    """Orders with missing values of every type."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return left_side(spark, folder).select(
        "o_orderkey",
        F.when(status != "P", F.col("o_custkey")).alias("o_custkey"),
        F.when(status != "F", F.concat(priority, F.lit("char(0)"))).alias("o_orderpriority"),
        F.when(status != "O", F.col("o_totalprice")).alias("o_totalprice"),
        F.when(priority != "1-URGENT", F.col("o_orderdate")).alias("o_orderdate"),
        F.when(priority != "5-LOW", F.to_date("o_orderdate")).alias("o_day"),
    )


@query("typed_hash", f"WITH {_SPARSE} SELECT o_orderkey, md5({_TYPED}) AS hash_value FROM sparse")
def typed_hash_query(spark, folder):
    sparse = _sparse_orders(spark, folder)
    return sparse.select("o_orderkey", typed_hash(sparse, sparse.columns).alias("hash_value"))


@query("typed_key", f"""WITH {_SPARSE} SELECT concat_ws('', CAST(o_orderkey AS VARCHAR),
  coalesce(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '1970-01-01 09:00')) AS concatenated_keys FROM sparse""")
def typed_key_query(spark, folder):
    sparse = _sparse_orders(spark, folder)
    return sparse.select(typed_key(sparse, ["o_orderkey", "o_orderdate"]).alias("concatenated_keys"))


@query("parquet_hash_scan", f"WITH {pair.SKETCHES} SELECT concatenated_keys, hash_value FROM lk")
def parquet_hash_scan(spark, folder):
    path = scratch_path(spark, "sketch")
    sketch(left_side(spark, folder), KEYS, COLUMNS).write.option("compression", "gzip").parquet(path)
    return scan_sketch(spark, path)


@query("parquet_row_count", "SELECT count(*) AS row_count FROM lineitem")
def parquet_row_count(spark, folder):
    return row_count(table(spark, folder, "lineitem"))


# --- report ----------------------------------------------------------------

def report_rows(spark, path):
    """A written report read back as one table of text."""
    summary = read_report(spark, path, SUMMARY).select(
        F.lit(SUMMARY).alias("section"), "column_name", F.col("mismatched").cast("string").alias("concatenated_keys"),
        F.col("matched_left").cast("string").alias("left_value"),
        F.col("matched_right").cast("string").alias("right_value"),
    )
    meta = read_report(spark, path, META).filter(F.col("config_name").startswith("Overall")).select(
        F.lit(META).alias("section"), F.col("config_name").alias("column_name"),
        F.lit(None).cast("string").alias("concatenated_keys"),
        F.col("config_value").alias("left_value"), F.lit(None).cast("string").alias("right_value"),
    )
    rows = summary.unionByName(meta)
    for section in (PASSED, MISMATCHES):
        rows = rows.unionByName(read_report(spark, path, section).select(
            F.lit(section).alias("section"), "column_name", "concatenated_keys", "left_value", "right_value"
        ))
    return rows


def report_sql(order: str = "o_orderkey") -> str:
    same = pair.SAME.removeprefix(pair.SIDES)
    return f"""WITH {pair.SUMMARY}{same}
SELECT 'summary' AS section, column_name, CAST(mismatched AS VARCHAR) AS concatenated_keys,
  CAST(matched_left AS VARCHAR) AS left_value, CAST(matched_right AS VARCHAR) AS right_value FROM summary
UNION ALL SELECT 'meta_info', 'OverallCommonCount', NULL, CAST(count(*) AS VARCHAR), NULL FROM same
UNION ALL SELECT 'meta_info', 'OverallCombinedMismatchCount', NULL,
  CAST(count(DISTINCT concatenated_keys) AS VARCHAR), NULL FROM changed_cells
UNION ALL SELECT 'mismatches', column_name, concatenated_keys, left_value, right_value FROM all_cells
UNION ALL SELECT 'pass_record_summary', * FROM ({pair.passed_cells_sql(order)})"""


@query("compare_report", report_sql())
def compare_report_query(spark, folder):
    path = scratch_path(spark, "report")
    write_report(compare_report(*both_sides(spark, folder), KEYS), path)
    return report_rows(spark, path)
