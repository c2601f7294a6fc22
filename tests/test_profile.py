"""Column figures and minimal keys against plain Python."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from conftest import rows
from ledgerline.operators import profile

SCHEMA = "a long, b string, `c d` double, e array<int>"


def brute_keys(data, names, width):
    found = []
    for size in range(1, width + 1):
        for chosen in itertools.combinations(range(len(names)), size):
            values = [tuple(row[i] for i in chosen) for row in data]
            if any(None in v for v in values) or len(set(values)) < len(values):
                continue
            if not any(set(key) <= set(chosen) for key in found):
                found.append(chosen)
    return [tuple(names[i] for i in key) for key in found]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from(["p", "q", "r"]), st.sampled_from([0.0, 1.0, None]),
                          st.none()), max_size=10))
def test_keys_of_any_table(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    assert profile.minimal_key_sets(df, 3) == brute_keys(data, ["a", "b", "c d"], 3)


def test_keys_of_many_rows_and_one_repeated_row(spark):
    # x and y together are a key until one row is repeated; z has too few values.
    df = spark.range(20000).selectExpr("id % 200 AS x", "id DIV 200 AS y", "id % 3 AS z", "id AS n")
    assert profile.minimal_key_sets(df.drop("n"), 3) == [("x", "y")]
    assert profile.minimal_key_sets(df, 3) == [("n",), ("x", "y")]
    assert profile.minimal_key_sets(df.drop("n").unionAll(df.drop("n").limit(1)), 3) == []
    rows_of_keys = rows(profile.minimal_keys(df, 2))
    assert rows_of_keys == [(1, ["n"]), (2, ["x", "y"])]


def test_the_slice_refutes_before_the_whole_table_is_counted(spark, monkeypatch):
    counted = []
    real = profile._without_repeats
    monkeypatch.setattr(profile, "_without_repeats", lambda df, sets: counted.extend(sets) or real(df, sets))
    df = spark.range(40000).selectExpr("IF(id % 20 = 0, id + 1, id) AS v", "id AS w")  # 5 % of the values of v twice
    assert profile.minimal_key_sets(df, 1) == [("w",)]
    assert counted == [("w",)]


def test_many_sets_are_decided_in_few_passes_over_the_table(spark):
    # The pair of a and b repeats in some 120 rows, which most other columns tell apart.
    n, names = 200000, ["a", "b", *[f"c`,.{k}" for k in range(8)]]
    passed = spark.sparkContext.accumulator(0)

    def mixed(ids, k, values):
        x = (ids.astype("uint64") + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype("int64") % values

    def made(batches):
        for ids in (batch["id"].to_numpy() for batch in batches):
            passed.add(len(ids))
            yield pd.DataFrame(dict(zip(names, [ids // 4, mixed(ids, 1, 5000), *[mixed(ids, 2 + k, 60) for k in range(8)]])))

    df = spark.range(n).mapInPandas(made, ", ".join(f"`{c.replace('`', '``')}` long" for c in names))
    found = profile.minimal_key_sets(df, 3)
    passes = passed.value / n
    data = pd.concat(made([pd.DataFrame({"id": np.arange(n)})]))
    assert data.duplicated(["a", "b"]).any()
    assert found == [s for s in itertools.combinations(names, 3) if not data.duplicated([*s]).any()] != []
    assert passes <= 12


def test_a_part_that_repeats_in_few_rows_decides_for_all_sets_that_hold_it(spark, monkeypatch):
    asked = {}
    real = profile._without_repeats
    monkeypatch.setattr(profile, "_without_repeats", lambda df, sets: asked.update(sets) or real(df, sets))
    # The pair of x and y repeats in 10 rows; p, q and r tell all, some and none of these apart.
    df = spark.range(300000).selectExpr(
        "id DIV 3 AS x", "IF(id < 15 AND id % 3 = 1, 0, id % 3) AS y", "id % 2 AS p", "IF(id < 6, id % 2, 0) AS q", "0L AS r")
    assert profile.minimal_key_sets(df, 3) == [("x", "y", "p")]
    assert profile._deciding_parts(
        [("x", "y", "p"), ("x", "y", "q")], {("x", "y"): 10, ("x", "y", "p"): 0, ("x", "y", "q"): 0}
    ) == {("x", "y", "p"): ("x", "y"), ("x", "y", "q"): ("x", "y")}
    assert asked[("x", "y", "p")] in {("x", "y"), ("x", "y", "p")}


@pytest.mark.parametrize("zero", [0.0, -0.0])
def test_values_that_are_equal_in_groups_are_no_key(spark, zero):
    df = spark.createDataFrame([(0.0, "a"), (zero, "b"), (float("nan"), "c"), (-float("nan"), "d")], "v double, w string")
    assert profile.minimal_key_sets(df, 2) == [("w",)]


def test_figures_of_columns(spark):
    long = "x" * 100
    data = [(1, long, 0.0, [1]), (1, long, -0.0, [1]), (2, "x", None, None), (None, long + "y", 1.5, [1, 2])]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(profile.profile_columns(df)) == [
        (1, "a", "bigint", 4, 1, 2, 2), (2, "b", "string", 4, 0, 3, 2),
        (3, "c d", "double", 4, 1, 2, 2), (4, "e", "array<int>", 4, 1, 2, 2),
    ]
    assert rows(profile.profile_columns(df, exact=False)) == [
        (1, "a", "bigint", 4, 1, 2), (2, "b", "string", 4, 0, 3),
        (3, "c d", "double", 4, 1, 2), (4, "e", "array<int>", 4, 1, 2),
    ]


@pytest.mark.parametrize("exact", [True, False])
def test_figures_of_an_empty_table(spark, exact):
    df = spark.createDataFrame([], SCHEMA)
    found = profile.profile_columns(df, exact)
    assert [row["column_name"] for row in found.orderBy("position").collect()] == ["a", "b", "c d", "e"]
    assert {value for row in rows(found) for value in row[3:]} == {0}


def test_sketched_figures_are_near_the_exact_ones(spark):
    df = spark.range(50000).selectExpr("id", "id % 7000 AS k")
    exact = {r["column_name"]: r["distinct_values"] for r in profile.profile_columns(df).collect()}
    near = {r["column_name"]: r["distinct_values"] for r in profile.profile_columns(df, exact=False).collect()}
    assert exact == {"id": 50000, "k": 7000}
    assert all(abs(near[c] - exact[c]) < 0.06 * exact[c] for c in exact)


def test_sizes_of_tables(spark):
    spark.range(5).createOrReplaceTempView("five")
    spark.range(0).createOrReplaceTempView("none")
    assert rows(profile.table_sizes(spark, ["five", "none"])) == [("five", 5), ("none", 0)]
    assert rows(profile.table_sizes(spark, [])) == []
