"""Comparison copy by copy against plain Python."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from conftest import rows
from ledgerline.operators import compare as cmp
from ledgerline.operators import copies, skew
from ledgerline.operators.numbering import repeated, spread_places
from pyspark.sql import functions as F

SCHEMA = "k long, a string, b double"


def order(row):
    return [(v is not None, v) for v in row]


def brute(left, right):
    """``(key, left values, right values)`` of all pairs and extra copies that differ."""
    l, r = Counter(left), Counter(right)
    found = []
    for key in {row[0] for row in left + right}:
        one = sorted([row[1:] for row in set(left) if row[0] == key for _ in range((l - r)[row])], key=order)
        other = sorted([row[1:] for row in set(right) if row[0] == key for _ in range((r - l)[row])], key=order)
        for n in range(max(len(one), len(other))):
            found.append((key, one[n] if n < len(one) else None, other[n] if n < len(other) else None))
    return sorted(found, key=str)


def as_pairs(df):
    return sorted(((r["k"], r["l"] and tuple(r["l"]), r["r"] and tuple(r["r"])) for r in df.collect()), key=str)


def sides(spark, left, right):
    return spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)


many = st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from(["p", "q"]), st.sampled_from([1.0, 2.0])), max_size=14)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(many, many)
def test_pairs_summary_and_status_of_any_tables(spark, left, right):
    l, r = sides(spark, left, right)
    expected = brute(left, right)
    differing = copies.differing_copies(l, r, ["k"])
    assert as_pairs(differing) == expected
    summary = {row["column_name"]: row for row in copies.summarise_copies(l, r, ["k"]).collect()}
    extra = [sum(row[3 - side] is None for row in expected) for side in (1, 2)]
    for n, name in enumerate(["a", "b"]):
        changed = sum(one is not None and other is not None and one[n] != other[n] for _, one, other in expected)
        row = summary[name]
        assert (row["extra_in_left"], row["extra_in_right"], row["mismatched"]) == (*extra, changed + sum(extra))
        assert (row["total_left"], row["total_right"]) == (len(left), len(right))
        assert row["matched_left"] + row["mismatched"] - extra[1] == len(left)
    same = {row["k"] for row in cmp.key_status(l, r, ["k"]).where("status = 'same'").collect()}
    assert {row["k"] for row in differing.collect()} == {row[0] for row in left + right} - same


def test_changed_copy_behind_the_smallest_row(spark):
    l, r = sides(spark, [(1, "a", 0.0), (1, "b", 0.0)], [(1, "a", 0.0), (1, "c", 0.0)])
    differing = copies.differing_copies(l, r, ["k"])
    assert rows(cmp.cell_diff(differing, ["k"])) == [("a", "1", "b", "c")]
    assert rows(cmp.mismatched_fields(differing, ["k"])) == [("1", ["a"])]
    summary = {row["column_name"]: row["mismatched"] for row in copies.summarise_copies(l, r, ["k"]).collect()}
    assert summary == {"k": 0, "a": 1, "b": 0}


@pytest.mark.parametrize("wide", [False, True])
def test_one_hot_key(spark, wide, monkeypatch):
    """A key with a third of the rows, half of them different on each side."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    left = [(7, f"v{n}", float(n)) for n in range(300)] + [(100 + n, "cold", 0.0) for n in range(600)]
    right = [(7, f"v{n}" if n % 2 else f"w{n}", float(n)) for n in range(290)] + [(100 + n, "cold", 0.0) for n in range(600)]
    assert as_pairs(copies.differing_copies(*sides(spark, left, right), ["k"], wide=wide)) == brute(left, right)


def test_all_copies(spark):
    left = [(1, "x", 1.0)] * 3 + [(1, "y", 1.0), (2, "z", None), (None, "n", 1.0)]
    right = [(1, "x", 1.0)] * 2 + [(1, "w", 1.0), (2, "z", None), (3, "r", 0.0)]
    aligned = copies.align_copies(*sides(spark, left, right), ["k"])
    assert Counter(row["status"] for row in aligned.collect()) == {"same": 3, "changed": 1, "left_only": 2, "right_only": 1}
    assert aligned.agg(F.sum("left_rows"), F.sum("right_rows")).first()[:] == (6, 5)
    assert cmp.passed_cells(aligned, ["k"], 10).count() == 9
    empty = sides(spark, [], [])
    assert copies.align_copies(*empty, ["k"]).count() == 0 and copies.differing_copies(*empty, ["k"]).count() == 0


def test_rows_are_repeated_without_long_arrays(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 4096), ("d", 4097), ("e", 10_000)], "v string, n long")
    got = repeated(df, F.col("n")).groupBy("v").agg(F.count("*").alias("n"), F.min("copy"), F.max("copy"), F.count_distinct("copy"))
    assert rows(got) == [("b", 1, 0, 0, 1), ("c", 4096, 0, 4095, 4096), ("d", 4097, 0, 4096, 4097), ("e", 10_000, 0, 9_999, 10_000)]


def test_places_of_a_line_on_a_third_of_the_rows(spark, request):
    """Places are those of a sort, and no task holds all copies of one line."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    lines = [(f"line {n % 400}",) for n in range(20_000)] + [("hot",)] * 10_000 + [(None,)] * 3
    df = spark.createDataFrame(lines, "value string").repartition(5)
    placed = spread_places(df, ["value"])
    got = sorted((r["place"], r["value"]) for r in placed.collect())
    values = sorted((v for v, in lines), key=lambda v: (v is not None, v or ""))
    assert got == list(enumerate(values, 1))
    hot = placed.where("value = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in hot) <= 2 * 4096 and len(hot) > 1
    assert spread_places(df.where("false"), ["value"]).count() == 0
