"""Merges that rewrite only the files they touch, and tokens of the current time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerline.functions.tokens import file_name, render
from ledgerline.plans import jobs
from ledgerline.plans.layouts import FileLayout
from ledgerline.sinks import versions
from ledgerline.sinks.tables import DuplicateKeyError, merge_and_load

SCHEMA = "k long, part string, v string"


def table_of(spark):
    data = [(n, "ab"[n % 2], f"v{n}") for n in range(100)] + [(5, "b", "again"), (None, "a", "no key")]
    return spark.createDataFrame(data, SCHEMA).repartitionByRange(6, "k").sortWithinPartitions("k")


def names(spark, path, version=None):
    return {r["file"] for r in versions.files_of(spark, path, version).collect()}


@pytest.mark.parametrize("keys, batch", [
    (["k"], [(3, "a", "new"), (5, "b", "both"), (200, "a", "added"), (None, "b", "unmatched")]),
    (["k", "part"], [(3, "b", "new"), (3, "a", "other part"), (70, "a", "x")]),
    (["k"], [(-5, "a", "below")]), (["k"], []), (["k"], [(None, "a", "only nulls")]),
])
def test_result_is_that_of_a_whole_merge(spark, folder, keys, batch):
    before = table_of(spark)
    batch = spark.createDataFrame(batch, SCHEMA).select("v", "k", "part")
    versions.create_table(before, f"{folder}/t", keys)
    merged = versions.merge_touched_files(spark, f"{folder}/t", batch, keys)
    assert rows(merged) == rows(merge_and_load(before, batch.select("k", "part", "v"), keys))
    assert merged.schema == before.schema and versions.files_of(spark, f"{folder}/t").agg(F.sum("rows")).first()[0] == merged.count()


def test_untouched_files_stay_and_old_versions_are_read(spark, folder):
    path = f"{folder}/t"
    first = versions.create_table(table_of(spark), path, ["k"])
    old, seen = rows(first), names(spark, path)
    batch = spark.createDataFrame([(50, "a", "new")], SCHEMA)
    versions.merge_touched_files(spark, path, batch, ["k"])
    assert len(seen - names(spark, path)) == 1 and len(seen) >= 5
    assert rows(first) == old == rows(versions.read_version(spark, path, 1))
    assert (50, "a", "new") in rows(versions.read_version(spark, path))


def test_a_merge_that_fails_leaves_the_version_before(spark, folder, monkeypatch):
    path = f"{folder}/t"
    versions.create_table(table_of(spark), path, ["k"])
    before = rows(versions.read_version(spark, path))
    batch = spark.createDataFrame([(50, "a", "new")], SCHEMA)
    with monkeypatch.context() as broken:
        broken.setattr(versions, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            versions.merge_touched_files(spark, path, batch, ["k"])
    assert rows(versions.read_version(spark, path)) == before and versions.latest_version(spark, path) == 1
    with pytest.raises(DuplicateKeyError):
        versions.merge_touched_files(spark, path, batch.union(batch), ["k"])
    versions.merge_touched_files(spark, path, batch, ["k"])
    with pytest.raises(Exception, match="exist"):  # a second writer from version 1
        versions._publish(versions.files_of(spark, path, 1), path, 2)
    with pytest.raises(ValueError):
        versions.latest_version(spark, f"{folder}/none")


def test_tokens_of_the_current_time_and_of_the_file(spark, folder):
    today = spark.range(1).select(render("¶CDATE•date•YYYY-MM-DD¶ ¶CTIME•date•HH¶", {}).alias("t"), F.current_date().alias("d")).first()
    assert today["t"][:10] == today["d"].isoformat() and len(today["t"]) == 13
    given = spark.range(1).select(render("¶CDATE•date•YYYY¶", {"CDATE": dt.date(1999, 1, 1)}).alias("t")).first()
    assert given["t"] == "1999"
    now = dt.datetime(2024, 3, 9, 14, 5, 6)
    assert file_name("out_¶BDATE•date•YYYYMMDD¶_¶CDATETIME•date•YYYYMMDDHHmmss¶", dt.date(2024, 3, 8), ".txt", now) == "out_20240308_20240309140506.txt"
    layout = FileLayout(["k"], headers=["FILE=¶FILENAME•str•s¶"])
    path = jobs.write_file(spark.createDataFrame([(1,)], "k long"), f"{folder}/users.txt", layout)
    assert [r[0] for r in spark.read.text(path).collect()][0] == "FILE=users.txt"
