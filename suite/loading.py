"""Table queries: sources, loads, checks, duplicates, catalog."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ledgerline.operators import dedupe, profile, quality
from ledgerline.session import scratch_path
from ledgerline.sinks import tables as load, versions
from ledgerline.sources.tables import date_series, extract_query, extract_table, posts, row_count
from suite.registry import query, table

PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def small_parts(spark, folder):
    return table(spark, folder, "part").filter(F.col("p_size") <= 30)


def new_parts(spark, folder):
    """Parts from size 20 on at a higher price: some replace small parts, some are new."""
    return table(spark, folder, "part").filter(F.col("p_size") >= 20).withColumn(
        "p_retailprice", F.col("p_retailprice") + 10
    )


# --- sources ---------------------------------------------------------------

@query("stored_table_extract", "SELECT * FROM orders")
def stored_table_extract(spark, folder):
    """The same call that takes a JDBC table, here on a stored one."""
    return extract_table(spark, f"{folder}/orders.parquet")


_JOINED = """SELECT o.o_orderkey AS order_id, o.o_orderdate AS batch_date, c.c_name AS name, c.c_mktsegment AS email
FROM {orders} o, {customer} c WHERE o.o_custkey = c.c_custkey"""


@query("stored_query_extract", _JOINED.format(orders="orders", customer="customer"))
def stored_query_extract(spark, folder):
    views = {"orders": table(spark, folder, "orders"), "customer": table(spark, folder, "customer")}
    return extract_query(spark, _JOINED, views)


@query("json_posts_scan", """
SELECT n_chars AS "userId", doc_id AS id, source || '-' || lang AS title, replace("text", chr(10), ' ') AS body
FROM documents""")
def json_posts_scan(spark, folder):
    return posts(posts_json(spark, folder))


def posts_json(spark, folder):
    """Documents as JSON objects, one per row."""
    return table(spark, folder, "documents").select(F.to_json(F.struct(
        F.col("n_chars").alias("userId"), F.col("doc_id").alias("id"),
        F.concat_ws("-", "source", "lang").alias("title"), F.col("text").alias("body"),
    )).alias("value"))


@query("json_props_scan", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props_scan(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("date_series", """
SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS day FROM orders""")
def date_series_query(spark, folder):
    bounds = table(spark, folder, "orders").agg(
        F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day")
    )
    return date_series(bounds)


# --- loads -----------------------------------------------------------------

@query("truncate_and_load", "SELECT * REPLACE (p_retailprice + 10 AS p_retailprice) FROM part WHERE p_size >= 20")
def truncate_and_load(spark, folder):
    path = scratch_path(spark, "part")
    small_parts(spark, folder).write.parquet(path)
    return load.load_table(spark, path, new_parts(spark, folder), "truncate_and_load")


@query("append_load", """
SELECT * FROM part WHERE p_size <= 30
UNION ALL SELECT * REPLACE (p_retailprice + 10 AS p_retailprice) FROM part WHERE p_size >= 20""")
def append_load(spark, folder):
    path = scratch_path(spark, "part")
    small_parts(spark, folder).write.parquet(path)
    return load.load_table(spark, path, new_parts(spark, folder), "append_load")


_MERGED = """
SELECT * REPLACE (p_retailprice + CASE WHEN p_size >= 20 THEN 10 ELSE 0 END AS p_retailprice) FROM part"""


@query("merge_and_load", _MERGED)
def merge_and_load(spark, folder):
    return load.merge_and_load(small_parts(spark, folder), new_parts(spark, folder), ["p_partkey"])


@query("merge_into_stored_table", _MERGED)
def merge_into_stored_table(spark, folder):
    path = scratch_path(spark, "part")
    small_parts(spark, folder).write.parquet(path)
    return load.load_table(spark, path, new_parts(spark, folder), "merge_and_load", ["p_partkey"])


@query("merge_touched_files", _MERGED)
def merge_touched_files(spark, folder):
    path = scratch_path(spark, "part-versions")
    versions.create_table(small_parts(spark, folder).repartitionByRange(4, "p_partkey"), path, ["p_partkey"])
    return versions.merge_touched_files(spark, path, new_parts(spark, folder), ["p_partkey"])


@query("merge_repeated_target_keys", """
SELECT l.l_orderkey, coalesce(o.o_totalprice, l.l_extendedprice) AS l_extendedprice
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def merge_repeated_target_keys(spark, folder):
    """Every line of a finished order takes the order's price: the target repeats its keys."""
    target = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice")
    finished = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("l_extendedprice")
    )
    return load.merge_and_load(target, finished, ["l_orderkey"])


@query("clone_structure", "SELECT * REPLACE (p_retailprice + 10 AS p_retailprice) FROM part WHERE p_size >= 20")
def clone_structure(spark, folder):
    """An empty copy of a table's structure, stored, takes the rows of a load."""
    path = scratch_path(spark, "clone")
    load.clone_structure(table(spark, folder, "part")).write.parquet(path)
    return load.load_table(spark, path, new_parts(spark, folder), "append_load")


@query("status_update", """
SELECT * REPLACE (CASE WHEN o_orderdate = TIMESTAMP '1998-10-03 00:00:00' THEN 'inprogress' ELSE o_orderstatus END
  AS o_orderstatus) FROM orders""")
def status_update(spark, folder):
    orders = table(spark, folder, "orders")
    day = F.lit("1998-10-03 00:00:00").cast("timestamp_ntz")
    return load.status_update(orders, "o_orderstatus", "inprogress", o_orderdate=day)


@query("reconcile_load", """
SELECT count(*) AS added_rows, count(*) AS processed_rows, count(*) AS expected_rows, true AS passed
FROM part WHERE p_size >= 20""")
def reconcile_load(spark, folder):
    old, new = small_parts(spark, folder), new_parts(spark, folder)
    loaded = load.append_load(old, new)
    return quality.reconcile_load(row_count(old), row_count(loaded), row_count(new), row_count(new))


# --- checks and duplicates -------------------------------------------------

@query("candidate_key_check", """
SELECT 'orders' AS table_name, count(*) AS total_rows, count(DISTINCT o_orderkey) AS distinct_keys,
  (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS duplicate_keys,
  CAST(0 AS BIGINT) AS null_key_rows,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)) AS most_rows_per_key,
  true AS is_key FROM orders
UNION ALL
SELECT 'lineitem', count(*), count(DISTINCT (l_orderkey, l_linenumber)),
  (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), 0,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)), false FROM lineitem""")
def candidate_key_check(spark, folder):
    checks = [("orders", ["o_orderkey"]), ("lineitem", LINE_KEYS)]
    rows = None
    for name, keys in checks:
        check = quality.key_check(table(spark, folder, name), keys).select(F.lit(name).alias("table_name"), "*")
        rows = check if rows is None else rows.unionByName(check)
    return rows


@query("duplicate_groups", """
SELECT l_orderkey, l_linenumber, min(l_partkey) AS first_id FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_groups(spark, folder):
    return dedupe.duplicate_groups(table(spark, folder, "lineitem"), LINE_KEYS, "l_partkey")


@query("duplicate_groups_distinct", """
SELECT DISTINCT l_orderkey, l_linenumber, count(*) AS rows, min(l_partkey) AS first_id FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_groups_distinct(spark, folder):
    return dedupe.duplicate_groups(table(spark, folder, "lineitem"), LINE_KEYS, "l_partkey", with_count=True)


_LINE_ORDER = [c for c in LINE if c not in LINE_KEYS]


@query("dedupe_keep_first", f"""
SELECT {", ".join(LINE)} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(_LINE_ORDER)}) AS rn
  FROM lineitem) WHERE rn = 1""")
def dedupe_keep_first(spark, folder):
    return dedupe.keep_first(table(spark, folder, "lineitem"), LINE_KEYS, _LINE_ORDER)


@query("dedupe_keep_last_renumber", """
WITH kept AS (
  SELECT p_name, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM part GROUP BY p_name)
SELECT row_number() OVER (ORDER BY first_key) AS id, part.* FROM kept JOIN part ON p_partkey = last_key""")
def dedupe_keep_last_renumber(spark, folder):
    return dedupe.keep_last_renumber(table(spark, folder, "part"), "p_name", "p_partkey")


# --- catalog ---------------------------------------------------------------

def _profile_sql(name, columns):
    counts = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) AS total_rows, count(*) - count({c}) AS null_rows, "
        f"count(DISTINCT {c}) AS distinct_values, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM {name} "
        f"WHERE {c} IS NOT NULL GROUP BY {c})), 0) AS most_rows_per_value FROM {name}" for c in columns
    )
    return f"""
SELECT CAST(ordinal_position AS BIGINT) AS position, column_name,
  CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string'
    WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS data_type,
  total_rows, null_rows, distinct_values, most_rows_per_value
FROM information_schema.columns JOIN ({counts}) USING (column_name) WHERE table_name = '{name}'"""


ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("schema_profile", _profile_sql("orders", ORDER))
def schema_profile(spark, folder):
    return profile.profile_columns(table(spark, folder, "orders"))


@query("schema_profile_lines", _profile_sql("lineitem", LINE))
def schema_profile_lines(spark, folder):
    return profile.profile_columns(table(spark, folder, "lineitem"))


@query("schema_profile_documents", _profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def schema_profile_documents(spark, folder):
    """Long texts are counted by their digests."""
    return profile.profile_columns(table(spark, folder, "documents"))


def _keys_sql(name, columns, width=3):
    """Every set of columns counted, then the keys without those that hold another."""
    sets = [s for w in range(1, width + 1) for s in itertools.combinations(columns, w)]
    counts = "\nUNION ALL\n".join(
        f"SELECT {len(s)} AS width, {list(s)} AS cols, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM {name} "
        f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in s)})) AS n" for s in sets
    )
    return f"""
WITH counted AS MATERIALIZED ({counts}),
found AS MATERIALIZED (SELECT * FROM counted WHERE n = (SELECT count(*) FROM {name}))
SELECT '{name}' AS table_name, CAST(width AS BIGINT) AS width, array_to_string(cols, ',') AS key_columns
FROM found k
WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.width < k.width AND list_has_all(k.cols, o.cols))"""


def _keys(spark, folder, name):
    found = profile.minimal_keys(table(spark, folder, name))
    return found.select(F.lit(name).alias("table_name"), "width", F.array_join("key_columns", ",").alias("key_columns"))


@query("minimal_keys", _keys_sql("orders", ORDER))
def minimal_keys(spark, folder):
    return _keys(spark, folder, "orders")


@query("minimal_keys_lines", _keys_sql("lineitem", LINE))
def minimal_keys_lines(spark, folder):
    return _keys(spark, folder, "lineitem")


@query("list_tables", "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS total_rows FROM {t}" for t in TABLES))
def list_tables(spark, folder):
    for name in TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)
    listed = {row["table_name"] for row in quality.list_tables(spark).collect()}
    return profile.table_sizes(spark, [t for t in TABLES if t in listed])
