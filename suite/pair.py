"""The two sides used by the comparison queries.

The left side is the whole of ``orders``; the right side is made from the whole of
it too. The divisors below only say which rows are changed, left out or re-keyed,
so that every kind of difference occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from suite.registry import table

KEYS = ["o_orderkey"]
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def left_side(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders")


def right_side(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    changed = table(spark, folder, "orders").select(
        key,
        "o_custkey",
        F.when(key % 29 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )
    rekeyed = changed.filter(key % 19 == 0).withColumn("o_orderkey", key + 10_000_000)
    return changed.filter(key % 17 != 0).unionByName(rekeyed)


def both_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return left_side(spark, folder), right_side(spark, folder)


# SQL: the two sides, the text of their cells, and their sketches.
SIDES = """
l AS (SELECT * FROM orders),
altered AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 29 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders),
r AS (
  SELECT * FROM altered WHERE o_orderkey % 17 <> 0
  UNION ALL
  SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM altered WHERE o_orderkey % 19 = 0)
"""


def text_of(column: str, alias: str = "") -> str:
    """SQL text of one cell of ``orders``."""
    name = f"{alias}.{column}" if alias else column
    if column == "o_totalprice":
        return f"CAST({name} AS VARCHAR)"
    if column == "o_orderdate":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({name} AS VARCHAR)"


KEY_TEXT = "concat_ws('▼', CAST(o_orderkey AS VARCHAR))"
ROW_TEXT = "concat_ws('', " + ", ".join(text_of(c) for c in COLUMNS) + ")"
SKETCHES = f"""{SIDES},
lk AS (SELECT {KEY_TEXT} AS concatenated_keys, md5({ROW_TEXT}) AS hash_value FROM l),
rk AS (SELECT {KEY_TEXT} AS concatenated_keys, md5({ROW_TEXT}) AS hash_value FROM r)
"""

# SQL: every differing cell, long form.
_CHANGED = "\n  UNION ALL\n".join(
    f"  SELECT '{c}' AS column_name, CAST(l.o_orderkey AS VARCHAR) AS concatenated_keys, "
    f"{text_of(c, 'l')} AS left_value, {text_of(c, 'r')} AS right_value "
    f"FROM l JOIN r USING (o_orderkey) WHERE l.{c} IS DISTINCT FROM r.{c}"
    for c in COLUMNS if c not in KEYS
)
_EXTRA = "\n  UNION ALL\n".join(
    f"  SELECT '{c}' AS column_name, CAST(o_orderkey AS VARCHAR) AS concatenated_keys, "
    f"{text_of(c)} AS left_value, 'Does_Not_Exists' AS right_value "
    f"FROM l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r)\n  UNION ALL\n"
    f"  SELECT '{c}', CAST(o_orderkey AS VARCHAR), 'Does_Not_Exists', {text_of(c)} "
    f"FROM r WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l)"
    for c in COLUMNS
)
CELLS = f"""{SIDES},
changed_cells AS (
{_CHANGED}),
extra_cells AS (
{_EXTRA}),
all_cells AS (SELECT * FROM changed_cells UNION ALL SELECT * FROM extra_cells)
"""

# SQL: the summary of all columns.
SUMMARY = f"""{CELLS},
totals AS (
  SELECT (SELECT count(*) FROM l) AS total_left, (SELECT count(*) FROM r) AS total_right,
         (SELECT count(*) FROM l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r)) AS extra_in_left,
         (SELECT count(*) FROM r WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l)) AS extra_in_right),
names AS (SELECT unnest({COLUMNS}) AS column_name),
changes AS (SELECT column_name, count(*) AS n FROM changed_cells GROUP BY column_name),
summary AS (
  SELECT names.column_name,
         total_left - extra_in_left - coalesce(n, 0) AS matched_left,
         total_right - extra_in_right - coalesce(n, 0) AS matched_right,
         coalesce(n, 0) + extra_in_left + extra_in_right AS mismatched,
         extra_in_left, extra_in_right, total_left, total_right
  FROM names LEFT JOIN changes USING (column_name), totals)
"""

# SQL: rows of both sides whose cells are all equal.
SAME = f"""{SIDES},
same AS (
  SELECT l.* FROM l JOIN r USING (o_orderkey)
  WHERE {" AND ".join(f"l.{c} IS NOT DISTINCT FROM r.{c}" for c in COLUMNS)})
"""


def passed_cells_sql(order: str) -> str:
    """Cells of the first ten equal rows in the given key order."""
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST(o_orderkey AS VARCHAR) AS concatenated_keys, "
        f"{text_of(c)} AS left_value, {text_of(c)} AS right_value "
        f"FROM (SELECT * FROM same ORDER BY {order} LIMIT 10)"
        for c in COLUMNS
    )
