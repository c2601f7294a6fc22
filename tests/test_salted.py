"""Joins with salted frequent keys against plain joins."""

from collections import Counter

import pytest

from conftest import rows
from ledgerline.operators import compare as cmp
from ledgerline.operators import skew
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hot_rows(spark, parts=12):
    data = [(7, i) for i in range(3000)] + [(None, i) for i in range(1500)] + [(i, i) for i in range(100, 3100)]
    return spark.createDataFrame(data, "k long, v long").repartition(parts)


def lookup_rows(spark):
    return spark.createDataFrame([(7, "seven"), (None, "none")] + [(i, f"n{i}") for i in range(100, 1600)], "k long, name string")


def counted(spark, df):
    """``df`` after a function that counts the rows it sees in an accumulator."""
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    # Non-deterministic, so that the plan may not copy the call.
    return df.withColumn("v", F.udf(count, T.LongType()).asNondeterministic()("v")), seen


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_the_plain_join(spark, how):
    df, lookup = hot_rows(spark), lookup_rows(spark)
    joined = skew.salted_join(df, lookup, ["k"], how)
    assert joined.columns == ["k", "v", "name"]
    assert rows(joined) == rows(df.join(lookup, "k", how).select("k", "v", "name"))


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_salted_presence_equals_the_null_safe_join(spark, how):
    df, keys = hot_rows(spark), lookup_rows(spark).select("k")
    for listed in (keys, keys.filter("k <> 7"), keys.filter("k IS NOT NULL"), keys.limit(0)):
        other = listed.select(F.col("k").alias("o"))
        assert rows(skew.salted_presence(df, listed, ["k"], how)) == rows(df.join(other, F.col("k").eqNullSafe(F.col("o")), how))


def test_a_costly_side_is_evaluated_once(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1000)  # the lookup does not fit
    for work in (
        lambda df, lookup: skew.lookup_join(df, lookup.withColumnRenamed("v", "name"), ["k"], costly=True),
        lambda df, lookup: cmp.extra_rows(df, lookup, ["k"], costly=True),
        lambda df, lookup: cmp.fetch_by_keys(df, lookup.select("k"), ["k"], costly=True),
    ):
        df, seen = counted(spark, hot_rows(spark))
        lookup, asked = counted(spark, lookup_rows(spark).withColumn("v", F.col("k")))
        joined = work(df, lookup.select("k", "v"))
        joined.write.format("noop").mode("overwrite").save()
        assert seen.value == 7500
        assert asked.value in (0, 1502)  # where only keys are asked for, the column is pruned


def test_a_hot_key_is_spread_over_the_joins_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "shuffle_partitions", lambda df: 8)
    df, lookup = hot_rows(spark, 16), lookup_rows(spark)
    shares = skew.hot_shares(df, ["k"])
    assert sum(shares.values()) <= 1.01 and len(shares) == 2
    left, right = skew._salted(df, [F.col("k")], lookup, [F.col("k")], shares)
    per_salt = Counter((r["k"], r["_join_salt"]) for r in left.collect() if r["k"] in (7, None))
    assert len([1 for k, _ in per_salt if k == 7]) == 7  # 0.4 of 16 pieces, rounded up
    assert max(per_salt.values()) < 3000 / 3
    copies = Counter(r["k"] for r in right.collect())
    assert copies[7] == 7 and copies[None] == 4 and copies[150] == 1
    assert set(per_salt) <= {(r["k"], r["_join_salt"]) for r in right.collect()}


def test_without_a_frequent_key_nothing_is_salted(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    plan = skew.salted_join(df, lookup_rows(spark), ["k"])._jdf.queryExecution().toString()
    assert "_join_salt" not in plan


def test_keys_of_other_types_and_empty_tables(spark):
    df, lookup = hot_rows(spark), lookup_rows(spark)
    as_text = lookup.withColumn("k", F.col("k").cast("string"))
    assert rows(skew.salted_join(df, as_text, ["k"])) == rows(df.join(lookup, "k").select("k", "v", "name"))
    assert skew.salted_join(df.limit(0), lookup, ["k"], "left", costly=True).count() == 0
    assert skew.salted_join(df, lookup.limit(0), ["k"], "left").count() == 7500
