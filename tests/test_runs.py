"""The run log: events, states, writers at the same time, comparisons that leave their runs."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest

from conftest import rows
from ledgerline.operators.search import last_runs, recent_orders
from ledgerline.plans import jobs
from ledgerline.plans.layouts import CompareSpec
from ledgerline.sinks import runs
from ledgerline.sinks.tables import DuplicateKeyError


def states(spark, path, **arguments):
    return runs.run_states(runs.read_events(spark, path), **arguments)


def test_a_log_that_no_run_has_written_is_empty(spark, folder):
    assert rows(states(spark, f"{folder}/none")) == []


def test_ends_of_runs(spark, folder):
    with runs.recorded_run(spark, folder, "good") as run:
        assert [(r["name"], r["status"]) for r in states(spark, folder).collect()] == [("good", "running")]
        run.report, run.figures["LeftRows"] = "here", 5
    with pytest.raises(KeyError):
        with runs.recorded_run(spark, folder, "bad"):
            raise KeyError("lost")
    found = {r["name"]: r for r in states(spark, folder).collect()}
    assert (found["good"]["status"], found["good"]["report"], found["good"]["figures"]) == ("finished", "here", {"LeftRows": 5})
    assert (found["bad"]["status"], found["bad"]["report"], found["bad"]["detail"]) == ("failed", None, "KeyError: 'lost'")
    assert all(r["started_at"] <= r["ended_at"] for r in found.values())
    assert [r["name"] for r in last_runs(states(spark, folder), "started_at", 1).collect()] == ["bad"]
    assert last_runs(states(spark, folder), "started_at", name="good").count() == 1


def test_a_run_whose_process_is_lost_grows_stale(spark, folder):
    runs.Run(spark, folder, "lost").record(runs.STARTED)
    assert states(spark, folder, stale_after=dt.timedelta(hours=1)).first()["status"] == "running"
    assert states(spark, folder, stale_after=dt.timedelta(seconds=-1)).first()["status"] == "stale"


def test_a_run_has_each_event_once(spark, folder):
    run = runs.Run(spark, folder, "once")
    run.record(runs.STARTED)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        run.record(runs.STARTED)


def test_runs_of_a_day_are_read_alone(spark, folder):
    for day in (dt.date(2020, 1, 1), dt.date(2020, 1, 2)):
        run = runs.Run(spark, folder, str(day))
        run.day = day
        run.record(runs.STARTED)
    assert [r["name"] for r in runs.read_events(spark, folder, dt.date(2020, 1, 2)).collect()] == ["2020-01-02"]


def test_writers_at_the_same_time_lose_no_event(spark, folder):
    def work(n):
        with runs.recorded_run(spark, folder, f"run {n}"):
            pass

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(work, range(12)))
    assert runs.read_events(spark, folder).count() == 24
    assert sorted(r["name"] for r in states(spark, folder).where("status = 'finished'").collect()) == sorted(f"run {n}" for n in range(12))


def test_a_comparison_leaves_its_run(spark, folder):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "a"), (2, "x")], "k long, v string")
    log = f"{folder}/log"
    jobs.compare_tables(left, right, CompareSpec("small", ["k"]), f"{folder}/report", log)
    with pytest.raises(DuplicateKeyError):
        jobs.compare_tables(left.union(left), right, CompareSpec("strict", ["k"], strict=True), f"{folder}/other", log)
    jobs.compare_tables(left, right, CompareSpec("unnoted", ["k"]), f"{folder}/third")
    found = {r["name"]: r for r in states(spark, log).collect()}
    assert set(found) == {"small", "strict"}
    assert (found["small"]["status"], found["small"]["report"]) == ("finished", f"{folder}/report")
    assert found["small"]["figures"] == {"LeftRows": 3, "RightRows": 2, "OverallCommonCount": 1, "OverallCombinedMismatchCount": 1}
    assert (found["strict"]["status"], found["strict"]["figures"]) == ("failed", {})


def test_pages_of_a_batch_by_a_chosen_column(spark):
    orders = spark.createDataFrame([(n, 1, 7, n % 2, n // 3) for n in range(6)], "id long, user_id long, batch_id long, start_time int, end_time int")
    batch = spark.createDataFrame([(7, "d")], "batch_id long, batch_date string")
    users = spark.createDataFrame([(1, "u")], "user_id long, name string")
    page = recent_orders(orders, batch, users, direction="asc", number=2, size=4, sort_by="start_time")
    assert page.columns == ["id", "start_time", "end_time", "batch_date", "name"]
    assert [r["id"] for r in page.collect()] == [3, 5]  # 0, 2, 4, 1 are the first page
    assert [r["id"] for r in recent_orders(orders, batch, users, size=3, sort_by="end_time").collect()] == [5, 4, 3]
    assert recent_orders(orders.drop("end_time"), batch, users).columns == ["id", "start_time", "batch_date", "name"]
