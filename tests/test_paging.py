"""Deep pages against sorting all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import paging, search

SCHEMA = "a string, b double, t timestamp_ntz, n long"


def table_of(spark, size=600):
    rng = random.Random(1)
    day = dt.datetime(2024, 1, 1)
    data = [(rng.choice(["x", "y", None, "é"]), rng.choice([None, 0.1, 2.5, float("nan"), -1.0]),
             rng.choice([None, day, day + dt.timedelta(microseconds=1)]), rng.randrange(4)) for _ in range(size)]
    data += [("hot", 1.0, day, 1)] * (size // 2)  # a third of the rows are one row
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("order", [[("a", False), ("b", True)], [("t", True), ("n", False)], [("b", False)]])
def test_pages_are_those_of_a_whole_sort(spark, monkeypatch, order):
    monkeypatch.setattr(paging, "SORTED_ROWS", 60)
    monkeypatch.setattr(paging, "SAMPLED_ROWS", 50)
    df = table_of(spark)
    whole = [*order, *[(c, False) for c in df.columns if c not in dict(order)]]
    want = [str(tuple(r)) for r in paging._sorted(df, whole).collect()]
    for offset, size in ((0, 5), (437, 20), (880, 40), (900, 10)):
        assert [str(tuple(r)) for r in paging.deep_page(df, order, offset, size).collect()] == want[offset:offset + size]


def test_only_a_small_part_is_sorted(spark, monkeypatch):
    """Of 200,000 rows the last step sorts a few hundred."""
    monkeypatch.setattr(paging, "SORTED_ROWS", 1_000)
    sorted_rows, plain = [], paging._sorted

    def noted(df, order):
        sorted_rows.append(df.count())
        return plain(df, order)

    monkeypatch.setattr(paging, "_sorted", noted)
    df = spark.range(200_000).select(F.xxhash64("id").alias("h"), "id")
    got = paging.deep_page(df, [("h", False)], 150_000, 30)
    want = [r["id"] for r in df.orderBy("h").offset(150_000).limit(30).collect()]
    assert [r["id"] for r in got.collect()] == want
    assert max(sorted_rows) < 3_000  # samples, the last part and the page


def test_history_pages(spark):
    df = table_of(spark)
    for number in (1, 9, 40):
        arguments = dict(columns=["n", "a", "b"], search_positions=[1], query="h", order=[1, 1, 2, 0], number=number, size=10)
        assert [str(r) for r in paging.deep_history_page(df, **arguments).collect()] == [str(r) for r in search.history_page(df, **arguments).collect()]
    assert paging.deep_page(df.where("false"), [("a", False)], 0, 5).count() == 0
    with pytest.raises(ValueError):
        paging.deep_page(df, [("a", False)], 0, 0)
