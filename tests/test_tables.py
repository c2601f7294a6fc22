"""Loads, checks, duplicates, skewed joins, search, reports, streams, generators."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerline.operators import dedupe, quality, reports, search, skew
from ledgerline.plans import jobs
from ledgerline.plans.layouts import FileLayout
from ledgerline.session import scratch_root, sized_for, stage
from ledgerline.sinks import tables as load
from ledgerline.sources import synthetic as syn
from ledgerline.sources.tables import extract_query, extract_table
from ledgerline.streaming import arrivals


def pairs(spark, data, schema="k long, v string"):
    return spark.createDataFrame(data, schema)


# --- merge -----------------------------------------------------------------

@pytest.mark.parametrize("small", [True, False])
def test_merge(spark, monkeypatch, small):
    monkeypatch.setattr(load, "fits_broadcast", lambda df, n: small)
    target = pairs(spark, [(1, "a"), (1, "aa"), (2, "b"), (None, "n")])
    source = pairs(spark, [(1, "A"), (2, None), (3, "C"), (None, "N")])
    merged = load.merge_and_load(target, source, ["k"])
    assert rows(merged) == rows(pairs(spark, [(1, "A"), (1, "A"), (2, None), (3, "C"), (None, "n"), (None, "N")]))


def test_merge_refuses_repeated_source_keys(spark):
    with pytest.raises(load.DuplicateKeyError):
        load.merge_and_load(pairs(spark, [(1, "a")]), pairs(spark, [(1, "x"), (1, "y")]), ["k"])


def test_merge_of_key_columns_only_inserts(spark):
    merged = load.merge_and_load(pairs(spark, [(1,)], "k long"), pairs(spark, [(1,), (2,)], "k long"), ["k"])
    assert rows(merged) == [(1,), (2,)]


@pytest.mark.parametrize("kind, expected", [
    ("append_load", [(1, "a"), (1, "x"), (2, "b"), (3, "y")]), ("truncate_and_load", [(1, "x"), (3, "y")]),
    ("merge_and_load", [(1, "x"), (2, "b"), (3, "y")]),
])
def test_load_table(spark, folder, kind, expected):
    pairs(spark, [(1, "a"), (2, "b")]).write.parquet(f"{folder}/t")
    source = pairs(spark, [("x", "1"), ("y", "3")], "v string, k string")  # other order and type
    loaded = load.load_table(spark, f"{folder}/t", source, kind, ["k"])
    assert rows(loaded) == expected
    assert loaded.schema["k"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        load.load_table(spark, f"{folder}/t", source, "other")


@pytest.mark.parametrize("kind, added", [("append_load", 2), ("truncate_and_load", 2), ("merge_and_load", 2)])
def test_load_job(spark, folder, kind, added):
    pairs(spark, [(1, "a"), (2, "b")]).write.parquet(f"{folder}/t")
    layout = FileLayout(["k", "v"], headers=["H"], trailers=["N=¶DATALINECOUNT•int•d¶"])
    jobs.write_file(pairs(spark, [(1, "x"), (3, "y")]), f"{folder}/f", layout)
    check = jobs.load_file(spark, f"{folder}/f", FileLayout(
        ["k", "v"], headers=["H"], trailers=["N=¶EXPECTEDDATALINECOUNT•int•d¶"], validate=True), f"{folder}/t", kind, ["k"])
    assert check.first()["added_rows"] == added and check.first()["passed"]


def test_load_job_with_wrong_trailer_changes_nothing(spark, folder):
    pairs(spark, [(1, "a")]).write.parquet(f"{folder}/t")
    jobs.write_file(pairs(spark, [(3, "y")]), f"{folder}/f", FileLayout(["k", "v"], trailers=["N=9"]))
    layout = FileLayout(["k", "v"], trailers=["N=¶EXPECTEDDATALINECOUNT•int•d¶"], validate=True)
    with pytest.raises(quality.CheckFailed):
        jobs.load_file(spark, f"{folder}/f", layout, f"{folder}/t", "append_load")
    assert rows(spark.read.parquet(f"{folder}/t")) == [(1, "a")]


def test_status_update_and_clone(spark):
    df = pairs(spark, [(1, "a"), (2, "b"), (None, "c")])
    assert rows(load.status_update(df, "v", "new", k=2)) == [(None, "c"), (1, "a"), (2, "new")]
    assert load.clone_structure(df).schema == df.schema and load.clone_structure(df).count() == 0


# --- checks ----------------------------------------------------------------

def test_key_check(spark):
    df = pairs(spark, [(1, "a"), (1, "b"), (None, "a"), (2, "a")])
    assert quality.key_check(df, ["k"]).first().asDict() == {
        "total_rows": 4, "distinct_keys": 3, "duplicate_keys": 1, "null_key_rows": 1, "most_rows_per_key": 2, "is_key": False}
    assert not quality.key_check(df, ["k", "v"]).first()["is_key"]
    assert quality.key_check(df.filter("k = 2"), ["k"]).first()["is_key"]
    empty = quality.key_check(df.limit(0), ["k"]).first()
    assert empty["total_rows"] == 0 and empty["is_key"]


def test_require(spark):
    quality.require(spark.range(1).select(F.lit(True).alias("passed")), "x")
    with pytest.raises(quality.CheckFailed, match="counts"):
        quality.require(spark.range(1).select(F.lit(False).alias("passed")), "counts")


def test_predicates_and_catalog(spark):
    df = pairs(spark, [(1, "a")])
    assert quality.predicate_is_valid(df, "k > 1 AND v LIKE 'a%'")
    assert not quality.predicate_is_valid(df, "missing = 1")
    assert not quality.predicate_is_valid(df, "k >")
    assert rows(quality.schema_profile(df)) == [(1, "k", "bigint"), (2, "v", "string")]
    df.createOrReplaceTempView("a_view")
    assert ("a_view",) in rows(quality.list_tables(spark))
    assert rows(extract_table(spark, "a_view")) == [(1, "a")]
    assert rows(extract_query(spark, "SELECT v FROM {t} WHERE k = 1", {"t": df})) == [("a",)]


# --- duplicates ------------------------------------------------------------

def test_duplicates(spark):
    df = pairs(spark, [(3, "a"), (1, "a"), (2, "b"), (4, "c"), (5, "a")])
    assert rows(dedupe.duplicate_groups(df, ["v"], "k")) == [("a", 1)]
    assert rows(dedupe.duplicate_groups(df, ["v"], "k", with_count=True)) == [("a", 3, 1)]
    assert rows(dedupe.keep_first(df, ["v"], ["k"])) == [(1, "a"), (2, "b"), (4, "c")]


def test_keep_first_reduces_groups_before_the_shuffle(spark):
    df = dedupe.keep_first(pairs(spark, [(1, "a"), (2, "a")]).repartition(3), ["v"], ["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_keep_last_renumber(spark):
    df = spark.createDataFrame([(10, "b", "1"), (20, "a", "2"), (30, "b", "3"), (40, "c", "4")], "pos int, name string, x string")
    assert rows(dedupe.keep_last_renumber(df, "name", "pos")) == [(1, "b", 30, "3"), (2, "a", 20, "2"), (3, "c", 40, "4")]


# --- skew ------------------------------------------------------------------

def test_hot_keys_are_found_and_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1000)  # the lookup does not fit
    hot = [(7, f"r{i}") for i in range(3000)]
    df = pairs(spark, hot + [(i, "c") for i in range(1000, 7000)]).repartition(6)
    found = skew.hot_hashes(df, ["k"])
    assert spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint"))).first()[0] in found
    lookup = pairs(spark, [(7, "hot")] + [(i, "name") for i in range(1000, 6000)], "k int, name string")
    joined = skew.lookup_join(df, lookup, ["k"])
    assert joined.count() == 3000 + 5000
    assert joined.filter("name = 'hot'").count() == 3000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1_000_000)
    whole = skew.lookup_join(df, lookup, ["k"])
    assert "Union" not in whole._jdf.queryExecution().executedPlan().toString()
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, joined.collect()))
    anti = skew.key_presence_join(df, lookup.filter("k <> 7"), ["k"], "left_anti")
    assert anti.count() == 3000 + 1000


def test_split_left_join_keeps_unmatched_rows(spark):
    df = pairs(spark, [(7, f"r{i}") for i in range(2000)] + [(8, "x")] * 1500 + [(i, "c") for i in range(100, 600)])
    lookup = pairs(spark, [(7, "seven")] + [(i, "name") for i in range(100, 300)], "k long, name string")
    joined = skew.split_join(df.repartition(5), lookup, ["k"], "left")
    assert Counter(r["name"] for r in joined.collect()) == {"seven": 2000, "name": 200, None: 1800}


def test_jdbc_target_options():
    target = load.JdbcTarget("jdbc:x:y", "dbo.part", properties={"user": "u"})
    assert target.options("append_load") == {
        "url": "jdbc:x:y", "dbtable": "dbo.part", "numPartitions": "8", "batchsize": "20000", "user": "u"}
    assert target.options("truncate_and_load")["truncate"] == "true"
    with pytest.raises(ValueError):
        target.load(None, "other")


def test_shuffle_sizes():
    assert sized_for(1)["spark__sql__adaptive__coalescePartitions__initialPartitionNum"] == "200"
    assert sized_for(10 * 2**40)["spark__sql__adaptive__coalescePartitions__initialPartitionNum"] == "40960"


def test_broadcast_needs_a_size(spark):
    df = pairs(spark, [(1, "a")])
    assert skew.row_width(df) == 72
    assert skew.fits_broadcast(df, 1000) and not skew.fits_broadcast(df, 10_000_000)


def test_long_texts_are_measured_before_a_broadcast(spark, monkeypatch):
    texts = spark.range(100).select("id", F.repeat(F.lit("ä"), 5_000).alias("text"), F.array(F.lit("x")).alias("list"))
    assert skew.fits_broadcast(texts, 100)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 900_000)  # declared: 13,600 bytes
    assert not skew.fits_broadcast(texts, 100) and skew.fits_broadcast(texts.drop("text"), 100)
    assert skew.fits_broadcast(texts.where("false"), 0)


# --- search ----------------------------------------------------------------

def test_pages(spark):
    df = spark.range(1, 101).select(F.col("id"), (F.col("id") % 3).alias("g"), F.concat(F.lit("n"), "id").alias("name"))
    page = search.history_page(df, ["name", "g", "id"], [0], "n1", order=[1, 1, 2, 0, 9], number=2, size=4)
    expected = sorted((i for i in range(1, 101) if str(i).startswith("1")), key=lambda i: (-(i % 3), i))[4:8]
    assert [r["id"] for r in page.collect()] == expected
    assert search.history_page(df, ["id"], size=0).count() == 100
    assert [r["id"] for r in search.entity_page(df, ["name"], "N10", direction="desc").collect()] == [100, 10]
    assert search.entity_page(df, ["name"], size=-1).count() == 100
    assert search.order_pairs([]) == [(0, 0)] and search.order_pairs(["1", "0", "2"]) == [(1, 0)]
    assert search.optional_filters(df, g=None).count() == 100 and search.optional_filters(df, g=0, id=3).count() == 1
    assert search.total_for_paging(df).first()[0] == 100
    assert search.history_export(df).columns == ["g", "name"]
    assert [r["id"] for r in search.last_runs(df, "id", 2, g=0).collect()] == [99, 96]


def test_slices(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 9), dt.datetime(2024, 3, 9, 23), "03/09/2024")], "d date, t timestamp_ntz, s string")
    day = search.pivot_date("Batch", batch="2024-03-09")
    for column in df.columns:
        assert search.pivot_date_filter(df, column, day, "MM/DD/YYYY").count() == 1
        assert search.pivot_date_filter(df, column, search.pivot_date("Current"), "MM/DD/YYYY").count() == 0
    with pytest.raises(ValueError):
        search.pivot_date_filter(df, "d", day, "other")
    with pytest.raises(ValueError):
        search.pivot_date("Other")


def test_every_date_format(spark):
    day = search.pivot_date("Custom", custom=dt.date(2024, 3, 9))
    texts = ["2024-03-09", "20240309", "03/09/2024", "09/03/2024", "2024/03/09", "03-09-2024", "09-03-2024",
             "2024-09-03", "03/09/24", "09/03/24", "24/03/09"]
    for form, text in zip(search.DATE_FORMATS, texts, strict=True):
        df = spark.createDataFrame([(text,)], "s string")
        assert search.pivot_date_filter(df, "s", day, form).count() == 1, form


def test_recent_orders(spark):
    orders = spark.createDataFrame([(i, i % 3, 5 if i > 4 else 4, dt.datetime(2024, 1, i)) for i in range(1, 9)],
                                   "id long, user_id long, batch_id long, start_time timestamp_ntz")
    batch = spark.createDataFrame([(5, dt.date(2024, 1, 5))], "batch_id long, batch_date date")
    users = spark.createDataFrame([(0, "zed"), (1, "amy"), (2, "max")], "user_id long, name string")
    recent = search.recent_orders(orders, batch, users, query="m")
    assert [(r["id"], r["name"]) for r in recent.collect()] == [(8, "max"), (7, "amy"), (5, "max")]
    assert search.last_order(orders, batch).first()[0] == 8


# --- reports ---------------------------------------------------------------

def test_print_report(spark):
    df = spark.range(1, 26).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    lines = [r["line"] for r in reports.paged_report(df, ["id", "text"], ["id"]).orderBy("row_no", "part").collect()]
    expected, number = [], 1
    def heading():
        expected.extend([f"{'page_number=' + str(number):*>100}", f"{'id':<25}{'text':<25}", "-" * 100])
    heading()
    for i in range(1, 26):
        if i % 10 == 0:
            number = i // 10 + 1
            heading()
        expected.append(f"{i:<25}{('x' * i)[:20]:<25}")
    assert lines == expected


def test_shares(spark):
    df = pairs(spark, [(1, "Completed"), (2, "Failed"), (3, "Completed"), (4, "In Progress")])
    shares = reports.status_share(df, "v", {"Completed": "green", "Failed": "red", "In Progress": "orange"})
    assert {r["status"]: (r["rows"], round(r["angle"], 4), r["colour"]) for r in shares.collect()} == {
        "Completed": (2, 3.14, "green"), "Failed": (1, 1.57, "red"), "In Progress": (1, 1.57, "orange")}
    running = {r["status"]: (round(r["start_angle"], 4), round(r["end_angle"], 4)) for r in reports.running_share(shares).collect()}
    assert running == {"Completed": (0.0, 3.14), "Failed": (3.14, 4.71), "In Progress": (4.71, 6.28)}


def test_order_total(spark):
    items = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 1, 1)], "order_id long, product_id long, quantity int")
    products = spark.createDataFrame([(1, 1.5), (2, 10.25)], "product_id long, price double")
    assert [(r[0], float(r[1])) for r in rows(reports.order_total(items, products))] == [(1, 13.25), (2, 1.5)]


# --- streams ---------------------------------------------------------------

def test_files_are_processed_once(spark, folder):
    schema = "k long, v string"

    def arrive(n):
        pairs(spark, [(n, f"file {n}")]).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        stream = arrivals.arriving_rows(spark, f"{folder}/in", pairs(spark, [(1, "a")]).schema, files_per_batch=1)
        upper = lambda df: df.withColumn("v", F.upper("v"))
        arrivals.ingest(stream, f"{folder}/out", f"{folder}/check", upper).awaitTermination()
        return rows(spark.read.schema(schema).parquet(f"{folder}/out/batch=*"))

    arrive(1), arrive(2)
    assert run() == [(1, "FILE 1"), (2, "FILE 2")]
    assert run() == [(1, "FILE 1"), (2, "FILE 2")]
    arrive(3)
    assert run() == [(1, "FILE 1"), (2, "FILE 2"), (3, "FILE 3")]


def test_page_follows_the_files(spark, folder):
    schema = pairs(spark, [(1, "a")]).schema
    newest = lambda df: df.orderBy(F.col("k").desc()).limit(3)

    def refresh():
        stream = arrivals.arriving_rows(spark, f"{folder}/in", schema, files_per_batch=1)
        arrivals.refresh_page(stream, newest, f"{folder}/pages", f"{folder}/check").awaitTermination()
        return rows(arrivals.latest_page(spark, f"{folder}/pages", schema))

    for keys in ([1, 9, 2], [3], [8, 4]):
        pairs(spark, [(k, "x") for k in keys]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    assert [r[0] for r in refresh()] == [4, 8, 9]
    pairs(spark, [(7, "x")]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    assert [r[0] for r in refresh()] == [7, 8, 9]


def test_arriving_lines(spark, folder):
    spark.range(3).select(F.col("id").cast("string")).coalesce(1).write.text(f"{folder}/in")
    stream = arrivals.arriving_lines(spark, f"{folder}/in", "part-*")
    arrivals.ingest(stream, f"{folder}/out", f"{folder}/check", lambda df: df.select("value")).awaitTermination()
    assert rows(spark.read.parquet(f"{folder}/out/batch=*").select("value")) == [("0",), ("1",), ("2",)]


# --- steps, staging, generators --------------------------------------------

def test_custom_step(spark):
    df = pairs(spark, [(1, "a")])
    assert jobs.custom_step(df, lambda d, n: d.withColumn("n", F.lit(n)), n=5).first()["n"] == 5
    assert jobs.custom_step(df, "ledgerline.sources.tables.row_count").first()[0] == 1


def test_scratch_folder_is_the_named_one(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    assert scratch_root(spark) == (named or spark.sparkContext.getCheckpointDir())
    staged = stage(pairs(spark, [(1, "a")]))
    assert f"{scratch_root(spark).removeprefix('file:')}/ledgerline/stage-" in staged.inputFiles()[0]


def test_generated_rows_repeat(spark):
    columns = [syn.FixedColumn("id", "int", 6), syn.FixedColumn("n", "int", 4), syn.FixedColumn("x", "float", 9),
               syn.FixedColumn("s", "str", 12), syn.FixedColumn("d", "date", 10), syn.FixedColumn("t", "datetime", 19)]
    make = lambda parts: syn.fixed_records(syn.numbered_range(spark, 200).repartition(parts), columns, "2020-01-01")
    assert Counter(map(tuple, make(2).collect())) == Counter(map(tuple, make(7).collect()))
    for row in make(3).collect():
        assert [len(v) for v in row] == [6, 4, 9, 12, 10, 19]
        assert "1970-01-01" <= row["d"] < "2020-01-01"
    assert {r["id"] for r in make(1).collect()} == {f"{i:06d}" for i in range(1, 201)}


def test_generated_orders(spark):
    orders = syn.orders(syn.numbered_range(spark, 300), 20, "2024-01-01", 10)
    found = orders.collect()
    assert {r["user_id"] for r in found} <= set(range(1, 21))
    for r in found:
        assert 8 <= r["start_time"].hour <= 13 and 50 <= (r["end_time"] - r["start_time"]).seconds <= 250
    items = syn.order_items(orders, 30).collect()
    per_order = Counter(r["order_id"] for r in items)
    assert set(per_order) == set(range(1, 301)) and set(per_order.values()) <= set(range(1, 7))
    assert len({r["id"] for r in items}) == len(items) and {r["quantity"] for r in items} == set(range(1, 7))
    bounds = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 10))], "first_day date, last_day date")
    days = syn.batches(bounds).collect()
    assert len(days) == 10 and all(r["end_time"].hour in (17, 18) and r["start_time"].hour == 7 for r in days)


def test_keys_of_different_types_meet(spark, monkeypatch):
    """Whatever the size: broadcast, split by hot keys, or shuffled."""
    df = spark.range(3000).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").alias("n"))
    lookup = spark.createDataFrame([(0, "a"), (1, "b"), (3_000_000_000, "c")], "k bigint, name string")
    words = spark.createDataFrame([("0",), ("x7",)], "k string")
    for limit in (skew.BROADCAST_BYTES, 0):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
        joined = skew.lookup_join(df, lookup, ["k"])
        assert joined.columns == ["k", "n", "name"] and joined.schema["k"].dataType.simpleString() == "int"
        assert joined.count() == 2000 and joined.filter("name = 'c'").count() == 0
        assert skew.lookup_join(df, lookup, ["k"], "left").count() == 3000
        assert skew.key_presence_join(df, lookup, ["k"], "left_anti").count() == 1000
        assert skew.key_presence_join(df, words, ["k"], "left_anti").count() == 2000
        assert skew.key_presence_join(df, words, ["k"], "left_semi", small=True).count() == 1000
