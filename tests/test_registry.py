"""The registered queries: contract and plans."""

import __spark_entry__ as entry

FOLDER = entry.SMOKE_FOLDER


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 100


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[0] == "column_name" and result.count() == 6


def plan_of(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_summary_takes_one_shuffle_of_rows(spark):
    plan = plan_of(spark, "compare_summary")
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "where_filter")
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThan(o_totalprice,100000.0)" in plan
    plan = plan_of(spark, "project_columns")
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in plan
    assert "PushedFilters: [IsNotNull(o_orderdate)" in plan_of(spark, "pivot_date_filter")


def test_pages_are_not_sorted_whole(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "history_page")
