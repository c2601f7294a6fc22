"""Pages kept in streaming state: any order of files, restarts, eviction, odd values."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from ledgerline.streaming import arrivals, kept_pages

SCHEMA = "day long, id long, name string, closes timestamp"
START = dt.datetime(2024, 1, 1)


def orders(spark, found):
    return spark.createDataFrame([(day, i, name, START + dt.timedelta(days=(day or 0) + 1)) for day, i, name in found], SCHEMA)


def arrive(spark, folder, found):
    orders(spark, found).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def refresh(spark, folder, target="pages", size=3, **arguments):
    stream = arrivals.arriving_rows(spark, f"{folder}/in", orders(spark, []).schema, files_per_batch=1)
    pages = kept_pages.newest_rows(stream, "day", "closes", ["id"], size, **arguments)
    kept_pages.write_pages(pages, f"{folder}/{target}", f"{folder}/check").awaitTermination()
    return lambda day: rows(kept_pages.kept_page(spark, f"{folder}/{target}", pages.schema, "day", day).select("id", "name"))


def top(found, day, size=3):
    own = sorted(((i, name) for d, i, name in found if d == day), reverse=True)[:size]
    return sorted(own, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_page_is_that_of_all_rows_in_any_order_and_after_a_restart(spark, folder, seed):
    rng = random.Random(seed)
    found = [(rng.choice([1, 2, 2, 2, 3, None]), 2**53 + n, f"n{n}") for n in rng.sample(range(500), 60)]
    for n in range(0, 40, 10):
        arrive(spark, folder, found[n:n + 10])
    page = refresh(spark, folder, delay="30 days")
    assert all(sorted(page(day), key=str) == top(found[:40], day) for day in (1, 2, 3, None))
    # Started again with another target: the pages come from the state, no old one is there.
    for n in range(40, 60, 10):
        arrive(spark, folder, found[n:n + 10])
    page = refresh(spark, folder, "later", delay="30 days")
    changed = {day for day, _, _ in found[40:]}
    assert all(sorted(page(day), key=str) == top(found, day) for day in changed)


def test_closed_groups_are_dropped_and_take_no_late_rows(spark, folder):
    arrive(spark, folder, [(1, 1, "a"), (1, 2, "b")])
    arrive(spark, folder, [(20, 3, "c")])
    page = refresh(spark, folder, delay="2 days")
    assert page(1) == [(1, "a"), (2, "b")] and page(20) == [(3, "c")]
    arrive(spark, folder, [(1, 9, "late"), (20, 4, "d"), (19, 5, "e")])
    page = refresh(spark, folder, "later", delay="2 days")
    assert page(1) == [] and page(20) == [(3, "c"), (4, "d")] and page(19) == [(5, "e")]


def test_ascending_pages_and_nulls(spark, folder):
    arrive(spark, folder, [(1, 5, None), (1, None, "n"), (1, 4, "d"), (1, 3, "c")])
    page = refresh(spark, folder, size=2, descending=False)
    assert page(1) == [(None, "n"), (3, "c")]


def test_a_hot_group_sends_a_page_per_task(spark, folder):
    (spark.range(400_000).select(F.lit(1).cast("long").alias("day"), "id", F.lit("x").alias("name"),
                                 F.lit(START).alias("closes")).repartition(4).write.parquet(f"{folder}/in"))
    stream = arrivals.arriving_rows(spark, f"{folder}/in", orders(spark, []).schema)
    pages = kept_pages.newest_rows(stream, "day", "closes", ["id"], 5)
    query = kept_pages.write_pages(pages, f"{folder}/pages", f"{folder}/check")
    query.awaitTermination()
    page = kept_pages.kept_page(spark, f"{folder}/pages", pages.schema, "day", 1)
    assert [r["id"] for r in page.orderBy("id").collect()] == list(range(399_995, 400_000))
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in map(dict, [query.recentProgress[0]])) == 1


def test_empty_streams_and_unknown_ends(spark, folder):
    arrive(spark, folder, [])
    assert refresh(spark, folder)(1) == []
    spark.createDataFrame([(1, 1, "a", None)], SCHEMA).write.mode("append").parquet(f"{folder}/in")
    with pytest.raises(PySparkException):
        refresh(spark, folder)


def test_a_half_written_page_is_not_read(spark, folder):
    schema = orders(spark, []).schema
    assert arrivals.latest_page(spark, f"{folder}/pages", schema).count() == 0
    orders(spark, [(1, 1, "a")]).write.parquet(f"{folder}/pages/page=9")
    orders(spark, [(1, 2, "b")]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false") \
        .parquet(f"{folder}/pages/page=10")
    assert [r["id"] for r in arrivals.latest_page(spark, f"{folder}/pages", schema).collect()] == [1]
