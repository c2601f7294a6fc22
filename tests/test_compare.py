"""Comparison: the three folds against plain Python, duplicates, NULLs, collisions."""

import datetime as dt
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows
from ledgerline.functions.rowtext import safe_hash, sketch, typed_hash, typed_key
from ledgerline.operators import compare as cmp
from ledgerline.plans import jobs
from ledgerline.plans.layouts import CompareSpec, FileLayout, Side, Slice
from ledgerline.sinks import report
from ledgerline.sinks.report import (
    DUPLICATES, META, MISMATCHES, PASSED, SUMMARY, compare_report, read_report, write_report,
)
from ledgerline.sinks.tables import DuplicateKeyError

SCHEMA = "k long, a string, b double"
LEFT = [(1, "x", 1.0), (2, "y", 2.0), (3, "z", None), (4, None, 4.0), (None, "n", 0.0), (6, "same", 6.0)]
RIGHT = [(1, "x", 1.5), (2, "y", 2.0), (3, None, None), (5, "new", 5.0), (None, "n", 0.0), (6, "same", 6.0)]


def sides(spark, left=LEFT, right=RIGHT, schema=SCHEMA):
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


def statuses(df):
    return {r["k"]: r["status"] for r in df.select("k", "status").collect()}


EXPECTED = {1: "changed", 2: "same", 3: "changed", 4: "left_only", 5: "right_only", None: "same", 6: "same"}


def test_status_by_both_folds(spark):
    assert statuses(cmp.align(*sides(spark), ["k"])) == EXPECTED
    assert statuses(cmp.key_status(*sides(spark), ["k"])) == EXPECTED


def test_status_by_join_of_unique_keys(spark):
    left, right = (side.filter("k IS NOT NULL") for side in sides(spark))
    expected = {k: v for k, v in EXPECTED.items() if k is not None}
    assert statuses(cmp.align(left, right, ["k"], unique_keys=True)) == expected


def test_cells(spark):
    aligned = cmp.align(*sides(spark), ["k"])
    changed = [("a", "3", "z", None), ("b", "1", "1.0", "1.5")]
    extra = [("a", "4", None, cmp.ABSENT), ("b", "4", "4.0", cmp.ABSENT), ("k", "4", "4", cmp.ABSENT),
             ("a", "5", cmp.ABSENT, "new"), ("b", "5", cmp.ABSENT, "5.0"), ("k", "5", cmp.ABSENT, "5")]
    assert rows(cmp.cell_diff(aligned, ["k"])) == rows(spark.createDataFrame(changed, "a string, b string, c string, d string"))
    assert sorted(map(str, rows(cmp.absent_cells(aligned, ["k"])))) == sorted(map(str, extra))
    assert cmp.difference_union(aligned, ["k"]).count() == len(changed) + len(extra)
    assert rows(cmp.mismatched_fields(aligned, ["k"])) == [("1", ["b"]), ("3", ["a"])]


def brute_summary(left, right, columns):
    """Summary of unique keys in plain Python."""
    l, r = {row[0]: row for row in left}, {row[0]: row for row in right}
    extra_l, extra_r = len(l.keys() - r.keys()), len(r.keys() - l.keys())
    result = {}
    for i, name in enumerate(columns):
        changed = sum(l[k][i] != r[k][i] for k in l.keys() & r.keys())
        result[name] = (len(left) - extra_l - changed, len(right) - extra_r - changed, changed + extra_l + extra_r,
                        extra_l, extra_r, len(left), len(right))
    return result


def as_dict(summary):
    return {r[0]: tuple(r)[1:] for r in summary.select(
        "column_name", "matched_left", "matched_right", "mismatched", "extra_in_left", "extra_in_right",
        "total_left", "total_right").collect()}


side_rows = st.dictionaries(st.integers(0, 12), st.tuples(st.sampled_from(["p", "q", None]), st.sampled_from([1.0, 2.0, None])), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(side_rows, side_rows)
def test_summary_of_any_tables(spark, left, right):
    left, right = ([(k, *v) for k, v in side.items()] for side in (left, right))
    expected = brute_summary(left, right, ["k", "a", "b"])
    l, r = sides(spark, left, right)
    aligned = cmp.align(l, r, ["k"])
    got = as_dict(cmp.summarise(aligned, ["k"]))
    assert got == expected
    for name, (matched_left, _, mismatched, extra_l, extra_r, total_left, _) in got.items():
        assert total_left == matched_left + extra_l + (mismatched - extra_l - extra_r)
    assert as_dict(cmp.summarise_differences(aligned.filter("status <> 'same'"), l, r, ["k"])) == expected


@pytest.mark.parametrize("wide", [False, True])
def test_summary_from_differing_rows(spark, wide):
    left, right = sides(spark)
    differing = cmp.align_differing(left, right, ["k"], wide=wide)
    assert set(statuses(differing)) == {1, 3, 4, 5}
    assert as_dict(cmp.summarise_differences(differing, left, right, ["k"])) == brute_summary(LEFT, RIGHT, ["k", "a", "b"])


def test_repeated_keys_make_no_pairs(spark):
    """One key with a third of the rows on each side."""
    left = [(7, "hot", float(i)) for i in range(400)] + [(100 + i, "cold", 0.0) for i in range(800)]
    right = [(7, "hot", float(i)) for i in range(400)] + [(100 + i, "cold", 0.0) for i in range(800)]
    l, r = sides(spark, left, right)
    aligned = cmp.align(l, r, ["k"])
    assert aligned.count() == 801
    assert set(statuses(aligned).values()) == {"same"}
    assert set(statuses(cmp.key_status(l, r, ["k"])).values()) == {"same"}
    counts = cmp.row_counts(cmp.pair_sketches(sketch(l, ["k"]), sketch(r, ["k"]))).first().asDict()
    assert counts["left_rows"] == counts["right_rows"] == 1200 and counts["mismatched_keys"] == 0


@pytest.mark.parametrize("left, right", [
    (["a", "b", "c"], ["a", "b", "d"]),  # the smallest rows agree
    (["a", "b", "b"], ["a", "c", "c"]),  # equal pairs on each side
    (["a", "b", "z"], ["a", "c", "z"]),  # smallest and largest agree
    (["a", "b"], ["a"]), (["a", "a"], ["a"]),
])
def test_any_difference_in_copies_shows(spark, left, right):
    l, r = sides(spark, [(1, v, 0.0) for v in left], [(1, v, 0.0) for v in right])
    assert statuses(cmp.align(l, r, ["k"])) == {1: "changed"}
    assert statuses(cmp.key_status(l, r, ["k"])) == {1: "changed"}


def test_null_moves_between_columns(spark):
    schema = "k long, a string, b string"
    l, r = sides(spark, [(1, "x", None)], [(1, None, "x")], schema)
    assert statuses(cmp.key_status(l, r, ["k"])) == {1: "changed"}
    assert statuses(cmp.align(l, r, ["k"])) == {1: "changed"}


def test_columns_of_different_type_meet_in_the_wider_type(spark):
    """Numbers as numbers; a number and a text as text."""
    l = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    r = spark.createDataFrame([(1, "5"), (2, "7")], "k long, v string")
    aligned = cmp.align(l, r, ["k"])
    assert {r["k"]: r["status"] for r in aligned.collect()} == {1: "same", 2: "changed"}


def test_keys_of_many_columns_and_no_values(spark):
    l, r = sides(spark, [(1, "a", 1.0), (1, "b", 1.0)], [(1, "a", 1.0), (2, "a", 1.0)])
    keys = ["k", "a", "b"]
    aligned = cmp.align(l, r, keys)
    assert Counter(r["status"] for r in aligned.collect()) == {"same": 1, "left_only": 1, "right_only": 1}
    assert rows(cmp.except_keys(l, r, ["k", "a"])) == [(1, "b")]
    assert as_dict(cmp.summarise(aligned, keys))["a"] == (1, 1, 2, 1, 1, 2, 2)


def test_extra_rows_keep_all_copies(spark):
    """Anti join: many rows of a missing hot key, of a present hot key, and NULL keys."""
    left = [(7, str(i), 0.0) for i in range(500)] + [(8, str(i), 0.0) for i in range(500)] + [
        (100 + i, "c", 0.0) for i in range(300)] + [(None, "n", 0.0)]
    right = [(8, "x", 0.0)] * 700 + [(100 + i, "c", 0.0) for i in range(0, 300, 2)] + [(None, "m", 0.0)]
    l, r = sides(spark, left, right)
    present = {row[0] for row in right}
    expected = Counter(row for row in left if row[0] not in present)
    assert Counter(tuple(x) for x in cmp.extra_rows(l, r, ["k"]).collect()) == expected
    kept = Counter(row for row in left if row[0] in present)
    assert Counter(tuple(x) for x in cmp.fetch_by_keys(l, r.select("k"), ["k"]).collect()) == kept


def test_sketch_collisions(spark):
    """Plain text lets (ab, c) equal (a, bc); the safe form does not."""
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("abc", None), (None, "abc")], "x string, y string")
    assert sketch(df, ["x"]).select("hash_value").distinct().count() == 1
    assert sketch(df, ["x"], form="safe").select("hash_value").distinct().count() == 4
    assert df.select(safe_hash(df, ["x", "y"])).distinct().count() == 4
    keys = spark.createDataFrame([("1", "23"), ("12", "3")], "x string, y string")
    assert keys.select(typed_key(keys, ["x", "y"])).distinct().count() == 1
    assert sketch(keys, ["x", "y"], form="safe").select("concatenated_keys").distinct().count() == 2


def test_typed_text_of_missing_values(spark):
    schema = "d date, t timestamp_ntz, s string, i int, f double, b boolean, n decimal(15,2)"
    df = spark.createDataFrame([(None,) * 7, (dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), "xchar(0)y", 7, 1e10, True, None)], schema)
    texts = [r[0] for r in df.select(typed_key(df, df.columns)).collect()]
    assert texts == ["1970-01-01" + "1970-01-01 09:00" + "" + "0" + "0" + "0" + "0",
                     "2024-01-02" + "2024-01-02T03:04:05" + "xy" + "7" + "1.0E10" + "1" + "0"]
    assert df.select(typed_hash(df, df.columns)).distinct().count() == 2


def test_columns_and_keys(spark):
    l, r = sides(spark)
    assert cmp.common_columns(l, r.drop("a").withColumn("c", F.lit(1)), exclude=["b"]) == ["k"]
    assert cmp.chosen_keys(["b"], ["k"], ["b", "a"]) == ["b", "k", "a"]
    assert cmp.side_suffix(l, ["k", "a"], "_x").columns == ["k_x", "a_x"]


def test_report(spark, folder):
    left, right = LEFT + [(9, "p", 1.0), (9, "q", 1.0)], RIGHT + [(9, "p", 1.0)]
    sections = compare_report(*sides(spark, left, right), ["k"], meta={"Name": "n"})
    write_report(sections, folder)
    assert rows(read_report(spark, folder, META)) == [
        ("Name", "n"), ("OverallCombinedMismatchCount", "2"), ("OverallCommonCount", "4")]
    summary = {r["column_name"]: r for r in read_report(spark, folder, SUMMARY).collect()}
    assert (summary["a"]["total_left"], summary["a"]["total_right"]) == (8, 7)
    assert summary["a"]["mismatched_flag"] and summary["a"]["extra_in_left_flag"]
    assert rows(read_report(spark, folder, DUPLICATES)) == [("9", 2, 1)]
    cells = read_report(spark, folder, MISMATCHES)
    assert cells.filter("absent_flag").count() == 9  # of keys 4 and 5, and of the copy (9, "q")
    assert (summary["a"]["extra_in_left"], summary["b"]["mismatched"]) == (2, 4)
    passed = {r["concatenated_keys"] for r in read_report(spark, folder, PASSED).collect()}
    assert passed == {"", "2", "6"}


def test_report_without_differences(spark, folder):
    same, _ = sides(spark)
    write_report(compare_report(same, same, ["k"]), folder)
    assert read_report(spark, folder, MISMATCHES).count() == 0
    assert {r["mismatched"] for r in read_report(spark, folder, SUMMARY).collect()} == {0}


def test_passed_sample_against_many_differences(spark, monkeypatch):
    left, right = sides(spark)
    differing = cmp.align(left, right, ["k"]).filter("status <> 'same'")
    expected = rows(report.passed_sample(left, differing, ["k"], 2))
    assert {r[1] for r in expected} == {"", "2"}
    monkeypatch.setattr(report, "fits_broadcast", lambda df, n: False)
    assert rows(report.passed_sample(left, differing, ["k"], 2)) == expected


def test_strict_job_stops_on_repeated_keys(spark, folder):
    left, right = sides(spark, LEFT + [(1, "again", 0.0)])
    with pytest.raises(DuplicateKeyError):
        jobs.compare_tables(left, right, CompareSpec("c", ["k"], strict=True), folder)


def test_job_of_tables_with_filters_and_slices(spark, folder):
    day = lambda d: dt.datetime(2024, 3, d)
    schema = "k long, v string, at timestamp_ntz, note string"
    left = spark.createDataFrame([(1, "a", day(1), "l"), (2, "b", day(1), "l"), (3, "c", day(2), "l")], schema)
    right = spark.createDataFrame([(1, "a", day(4), "r"), (2, "x", day(4), "r"), (9, "z", day(5), "r")], schema)
    spec = CompareSpec(
        "slices", ["k"], exclude=["note", "at"], batch_date=dt.date(2024, 3, 1),
        left=Side(where="v <> 'q'", slice=Slice("at")),
        right=Side(slice=Slice("at", choice="Custom", custom=dt.date(2024, 3, 4))),
    )
    jobs.compare_tables(left, right, spec, f"{folder}/report")
    cells = read_report(spark, f"{folder}/report", MISMATCHES).drop("absent_flag")
    assert rows(cells.select("column_name", "concatenated_keys", "left_value", "right_value")) == [("v", "2", "b", "x")]


def test_job_of_files(spark, folder):
    layout = FileLayout(["k", "v"], quote='"', headers=["H"], trailers=["ROWS=¶DATALINECOUNT•int•d¶"])
    for name, data in (("l", [("1", "a"), ("2", "b,c")]), ("r", [("1", "a"), ("2", 'b"c'), ("3", None)])):
        jobs.write_file(spark.createDataFrame(data, "k string, v string"), f"{folder}/{name}", layout)
    label = Side(trailer_label="ROWS")
    spec = CompareSpec("files", ["k"], left=label, right=label)
    jobs.compare_files(spark, f"{folder}/l", layout, f"{folder}/r", layout, spec, f"{folder}/report")
    meta = dict(rows(read_report(spark, f"{folder}/report", META)))
    assert meta["TrailerValidationSuccessForLeft"] == meta["TrailerValidationSuccessForRight"] == "Y"
    cells = read_report(spark, f"{folder}/report", MISMATCHES)
    got = {(r["column_name"], r["concatenated_keys"]): (r["left_value"], r["right_value"]) for r in cells.collect()}
    assert got == {("v", "2"): ("b,c", 'b"c'), ("k", "3"): (cmp.ABSENT, "3"), ("v", "3"): (cmp.ABSENT, None)}


def test_samples(spark):
    left, right = sides(spark)
    aligned = cmp.align(left, right, ["k"])
    assert cmp.passed_cells(aligned, ["k"], 2).count() == 6
    assert [r["k"] for r in cmp.passed_rows(aligned, ["k"], 2).collect()] == [None, 2]
    assert [r["k"] for r in cmp.first_rows(left, ["k"], 3).collect()] == [None, 1, 2]
    assert cmp.limit_differences(cmp.difference_union(aligned, ["k"]), 3).count() == 3
    pairs = cmp.three_way_pairs(aligned, ["k"], spark.createDataFrame([(1,), (4,), (6,)], "k long"))
    assert rows(pairs.select("k_x", "b_x", "b_y")) == [(1, 1.0, 1.5), (6, 6.0, 6.0)]
    assert cmp.merge_on_keys(aligned, ["k"]).columns == ["k", "a_x", "b_x", "a_y", "b_y"]


def test_values_that_differ_have_different_texts(spark):
    """Digits beyond the second, microseconds, and the two signs of zero."""
    left = spark.createDataFrame([(1, 1.001, dt.datetime(2024, 1, 2, 3, 4, 5, 1)), (2, 0.0, None)], "k int, x double, t timestamp_ntz")
    right = spark.createDataFrame([(1, 1.004, dt.datetime(2024, 1, 2, 3, 4, 5, 2)), (2, -0.0, None)], "k int, x double, t timestamp_ntz")
    for form in ("compatible", "typed", "safe"):
        for columns, same in ((["x"], 1), (["t"], 1), (["x", "t"], 1)):
            pairs = cmp.pair_sketches(sketch(left, ["k"], columns, form), sketch(right, ["k"], columns, form))
            assert cmp.mismatch_rows(pairs).count() == 1 and cmp.matching_rows(pairs).count() == same
    rounded = cmp.pair_sketches(sketch(left, ["k"], ["x"], scale=2), sketch(right, ["k"], ["x"], scale=2))
    assert cmp.mismatch_rows(rounded).count() == 0
    assert ("x", "1", "1.001", "1.004") in rows(cmp.cell_diff(cmp.align(left, right, ["k"]), ["k"]))


def test_copies_of_a_key_stay(spark):
    left = [(1, "x", 1.0), (1, "x", 1.0), (1, "y", 2.0), (2, "z", 3.0), (2, "z", 3.0), (None, "n", 0.0), (7, "l", 1.0)]
    right = [(1, "x", 1.0), (1, "w", 2.0), (2, "z", 3.0), (2, "z", 3.0), (None, "n", 0.0), (8, "r", 1.0)]
    l, r = sides(spark, left, right)
    joined = cmp.joined_rows(l, r, ["k"])
    product = [(*a, *b[1:]) for a in left for b in right if a[0] == b[0]]
    assert sorted(map(str, rows(cmp.merge_on_keys(joined, ["k"])))) == sorted(map(str, product))
    listed = spark.createDataFrame([(1,), (7,)], "k long")
    assert cmp.three_way_pairs(joined, ["k"], listed).count() == 6
    assert sorted(map(str, rows(cmp.same_rows(l, r, ["k"])))) == sorted(map(str, left[3:6]))
    names = "concatenated_keys string, hash_value string"
    a, b = (spark.createDataFrame([(str(x[0]), f"{x[1]}{x[2]}") for x in side], names) for side in (left, right))
    assert cmp.matching_pairs(a, b).count() == 2 + 4 + 1


@pytest.mark.parametrize("kind", ["bigint", "decimal(20,0)", "decimal(38,18)"])
def test_whole_numbers_and_doubles_meet_without_rounding(spark, kind):
    """2^53 and the number after it are one double, but not one key."""
    wholes = [1, 0, -7, 10, 2**53, 2**53 + 1, 10**17, None]
    doubles = [1.0, -0.0, -7.0, 10.0, float(2**53), 1e17, 1e-20, 1e25, float("nan"), float("inf"), None]
    left = spark.createDataFrame([(n, "v") for n in wholes], "k bigint, v string").withColumn("k", F.col("k").cast(kind))
    right = spark.createDataFrame([(d, "v") for d in doubles], "k double, v string")
    status = cmp.key_status(left, right, ["k"], ["v"]).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in status} == {cmp.SAME: 7, cmp.LEFT_ONLY: 1, cmp.RIGHT_ONLY: 4}
    only = cmp.extra_rows(left, right, ["k"]).select(F.col("k").cast("bigint"))
    assert [tuple(r) for r in only.collect()] == [(2**53 + 1,)]
    assert cmp.extra_rows(right, left, ["k"]).count() == 4


def test_decimals_and_doubles_of_equal_shortest_form_are_equal(spark):
    left = spark.sql("SELECT * FROM VALUES (CAST(0.1 AS DECIMAL(38,18))), (CAST(0.000000001 AS DECIMAL(38,18))), (CAST(1200 AS DECIMAL(38,18))) AS t(k)")
    right = spark.createDataFrame([(0.1,), (1e-9,), (1200.0,)], "k double")
    assert cmp.extra_rows(left, right, ["k"]).count() == 0 == cmp.extra_rows(right, left, ["k"]).count()
