"""Comparison queries on line items, whose keys repeat: each copy counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import compare as cmp
from ledgerline.operators import copies
from ledgerline.sinks.report import MISMATCHES, SUMMARY, compare_report
from suite.registry import query, table

KEYS = ["l_orderkey", "l_linenumber"]
VALUES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
          "l_shipdate"]
COLUMNS = [*KEYS, *VALUES]


def both_sides(spark, folder):
    """All line items, and all of them with some copies altered, left out or doubled."""
    lines = table(spark, folder, "lineitem").select(*COLUMNS)
    altered = lines.withColumn("l_quantity", F.when(F.col("l_partkey") % 13 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))) \
        .withColumn("l_returnflag", F.when(F.col("l_suppkey") % 29 == 0, "X").otherwise(F.col("l_returnflag")))
    right = altered.where("l_suppkey % 17 <> 0").unionByName(altered.where("l_partkey % 19 = 0"))
    return lines, right


_ROW = ", ".join(COLUMNS)
_KEY_TEXT = "concat_ws('▼', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in KEYS) + ")"


def _text(column, side=""):
    name = f"{side}{column}"
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S')" if column == "l_shipdate" else f"CAST({name} AS VARCHAR)"


def _rest(name, one, other):
    values = ", ".join(f"{v} AS {name}_{v}" for v in VALUES)
    order = ", ".join(f"{v} NULLS FIRST" for v in VALUES)
    return (f"{name}x AS (SELECT {', '.join(KEYS)}, {values}, true AS {name}_there, row_number() OVER "
            f"(PARTITION BY {', '.join(KEYS)} ORDER BY {order}) AS no FROM (SELECT {_ROW} FROM {one} EXCEPT ALL SELECT {_ROW} FROM {other}))")


_SIDES = f"""l AS (SELECT {_ROW} FROM lineitem),
altered AS (SELECT * REPLACE (CASE WHEN l_partkey % 13 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
  CASE WHEN l_suppkey % 29 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag) FROM l),
r AS (SELECT * FROM altered WHERE l_suppkey % 17 <> 0 UNION ALL SELECT * FROM altered WHERE l_partkey % 19 = 0)"""

_PAIRS = f"""{_SIDES}, {_rest('l', 'l', 'r')}, {_rest('r', 'r', 'l')},
pairs AS (SELECT * FROM lx FULL JOIN rx USING ({', '.join(KEYS)}, no))"""


def _cells():
    parts = []
    for c in COLUMNS:
        left, right = ("", "") if c in KEYS else ("l_", "r_")
        parts.append(f"SELECT '{c}' AS column_name, {_KEY_TEXT} AS concatenated_keys, {_text(c, left)} AS left_value, "
                     f"'Does_Not_Exists' AS right_value FROM pairs WHERE r_there IS NULL")
        parts.append(f"SELECT '{c}', {_KEY_TEXT}, 'Does_Not_Exists', {_text(c, right)} FROM pairs WHERE l_there IS NULL")
        if c in VALUES:
            parts.append(f"SELECT '{c}', {_KEY_TEXT}, {_text(c, 'l_')}, {_text(c, 'r_')} FROM pairs "
                         f"WHERE l_there AND r_there AND l_{c} IS DISTINCT FROM r_{c}")
    return "\nUNION ALL ".join(parts)


def _counts():
    changed = "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, (SELECT count(*) FROM pairs WHERE l_there AND r_there AND l_{c} IS DISTINCT FROM r_{c}) AS n"
        if c in VALUES else f"SELECT '{c}' AS column_name, 0 AS n" for c in COLUMNS)
    return f"""{_PAIRS}, changes AS ({changed}),
totals AS (SELECT (SELECT count(*) FROM l) AS total_left, (SELECT count(*) FROM r) AS total_right,
  (SELECT count(*) FROM pairs WHERE r_there IS NULL) AS extra_in_left, (SELECT count(*) FROM pairs WHERE l_there IS NULL) AS extra_in_right),
summary AS (SELECT column_name, total_left - extra_in_left - n AS matched_left, total_right - extra_in_right - n AS matched_right,
  n + extra_in_left + extra_in_right AS mismatched, extra_in_left, extra_in_right, total_left, total_right FROM changes, totals)"""


@query("compare_summary_copies", f"WITH {_counts()} SELECT * FROM summary")
def compare_summary_copies(spark, folder):
    return copies.summarise_copies(*both_sides(spark, folder), KEYS)


@query("difference_union_copies", f"WITH {_PAIRS} {_cells()}")
def difference_union_copies(spark, folder):
    return cmp.difference_union(copies.differing_copies(*both_sides(spark, folder), KEYS), KEYS)


@query("mismatched_fields_copies", f"""WITH {_PAIRS}
SELECT {_KEY_TEXT} AS concatenated_keys, concat_ws(',', {', '.join(f"CASE WHEN l_{v} IS DISTINCT FROM r_{v} THEN '{v}' END" for v in VALUES)})
  AS fields FROM pairs WHERE l_there AND r_there""")
def mismatched_fields_copies(spark, folder):
    differing = copies.differing_copies(*both_sides(spark, folder), KEYS)
    return cmp.mismatched_fields(differing, KEYS).withColumn("fields", F.array_join("fields", ","))


@query("align_copies", f"""WITH {_PAIRS}, folded AS (
  SELECT 'same' AS status, count(*) AS n, sum(l_partkey) AS parts, sum(l_quantity) AS quantity
  FROM (SELECT {_ROW} FROM l INTERSECT ALL SELECT {_ROW} FROM r)
  UNION ALL SELECT CASE WHEN r_there IS NULL THEN 'left_only' WHEN l_there IS NULL THEN 'right_only' ELSE 'changed' END, count(*),
    sum(coalesce(l_l_partkey, 0) + coalesce(r_l_partkey, 0)), sum(coalesce(l_l_quantity, 0) + coalesce(r_l_quantity, 0)) FROM pairs GROUP BY 1)
SELECT status, n, CAST(CASE WHEN status = 'same' THEN 2 ELSE 1 END * parts AS BIGINT) AS parts,
  CASE WHEN status = 'same' THEN 2 ELSE 1 END * quantity AS quantity FROM folded""")
def align_copies(spark, folder):
    aligned = copies.align_copies(*both_sides(spark, folder), KEYS)

    def both(name):
        return F.sum(F.coalesce(F.col(f"l.{name}"), F.lit(0)) + F.coalesce(F.col(f"r.{name}"), F.lit(0)))

    return aligned.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), both("l_partkey").alias("parts"), both("l_quantity").alias("quantity"))


@query("compare_report_copies", f"""WITH {_counts()}, all_cells AS ({_cells()})
SELECT column_name, mismatched, extra_in_left, extra_in_right,
  (SELECT count(*) FROM all_cells c WHERE c.column_name = summary.column_name) AS cells FROM summary""")
def compare_report_copies(spark, folder):
    sections = compare_report(*both_sides(spark, folder), KEYS, COLUMNS)
    cells = sections[MISMATCHES].groupBy("column_name").agg(F.count(F.lit(1)).alias("cells"))
    return sections[SUMMARY].join(cells, "column_name", "left").select(
        "column_name", "mismatched", "extra_in_left", "extra_in_right", F.coalesce("cells", F.lit(0)).alias("cells"))


# --- all pairs of a key's rows ---------------------------------------------

_SUFFIXED = ", ".join([*[f"l.{k}" for k in KEYS], *[f"l.{v} AS {v}_x" for v in VALUES], *[f"r.{v} AS {v}_y" for v in VALUES]])
_SAME_KEY = " AND ".join(f"l.{k} = r.{k}" for k in KEYS)


@query("merge_on_keys_copies", f"WITH {_SIDES} SELECT {_SUFFIXED} FROM l JOIN r ON {_SAME_KEY}")
def merge_on_keys_copies(spark, folder):
    return cmp.merge_on_keys(cmp.joined_rows(*both_sides(spark, folder), KEYS), KEYS)


@query("three_way_pairs_copies", f"""WITH {_SIDES}
SELECT concat_ws('▼', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR)) AS concatenated_keys,
  {', '.join([f'l.{c} AS {c}_x' for c in COLUMNS] + [f'r.{c} AS {c}_y' for c in COLUMNS])}
FROM l JOIN r ON {_SAME_KEY} WHERE l.l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def three_way_pairs_copies(spark, folder):
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    listed = table(spark, folder, "lineitem").select(*KEYS).join(urgent, "l_orderkey", "left_semi").distinct()
    return cmp.three_way_pairs(cmp.joined_rows(*both_sides(spark, folder), KEYS), KEYS, listed)


@query("passed_rows_copies", f"""WITH {_PAIRS}
SELECT {_ROW} FROM l WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE {' AND '.join(f'p.{k} = l.{k}' for k in KEYS)})""")
def passed_rows_copies(spark, folder):
    """Every copy of the keys whose rows are the same on both sides."""
    return cmp.same_rows(*both_sides(spark, folder), KEYS)
