"""Frames: line numbers over blocks and files, sections, counts, order of output."""

import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerline.operators import quality
from ledgerline.operators.numbering import number_rows
from ledgerline.plans import jobs
from ledgerline.plans.layouts import FIXED_WIDTH, FileLayout
from ledgerline.sinks.framed import fill_column_names, frame_output, write_lines
from ledgerline.sources.framed import frame_lines, open_framed, sorted_data_lines


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, lines, end="\n"):
    Path(path).write_text("".join(line + end for line in lines), newline="")


def test_line_numbers_over_many_blocks_and_files(spark, folder, small_blocks):
    sizes = {"a.txt": 700, "b.txt": 900, "c.txt": 800}
    for name, size in sizes.items():
        write(f"{folder}/{name}", [f"{name} line {i + 1} {'x' * (i % 37)}" for i in range(size)])
    files = open_framed(spark, folder, 2, 1)
    assert files.blocks.count() > 20
    got = files.lines().collect()
    assert len(got) == sum(sizes.values())
    for row in got:
        name = row["unit"].rsplit("/", 1)[1]
        assert row["value"].startswith(f"{name} line {row['line_no']} ")
        assert row["total_lines"] == sizes[name]
        section = "header" if row["line_no"] <= 2 else "trailer" if row["line_no"] == sizes[name] else "data"
        assert row["section"] == section
    counts = {r["unit"].rsplit("/", 1)[1]: r["data_lines"] for r in files.counts().collect()}
    assert counts == {name: size - 3 for name, size in sizes.items()}


def test_folder_is_one_unit_in_name_order(spark, folder, small_blocks):
    for part in range(12):
        write(f"{folder}/part-{part:05d}.txt", [f"line {part * 100 + i + 1}" for i in range(100)])
    files = open_framed(spark, folder, 2, 3, unit="folder")
    got = files.lines().collect()
    assert all(row["value"] == f"line {row['line_no']}" for row in got)
    assert {row["total_lines"] for row in got} == {1200}
    frame = files.frame()
    assert sorted((r["section"], r["ordinal"], r["value"]) for r in frame.collect()) == [
        ("header", 1, "line 1"), ("header", 2, "line 2"),
        ("trailer", 1, "line 1198"), ("trailer", 2, "line 1199"), ("trailer", 3, "line 1200"),
    ]
    # only the first and the last part are opened for the frame
    assert len(frame.select("value").inputFiles()) < 6


def test_other_blocks_than_counted_fail(spark, folder, small_blocks):
    """A change of the split size between the passes must not go unnoticed."""
    write(f"{folder}/a.txt", [f"line {i + 1}" for i in range(3000)])
    files = open_framed(spark, folder)
    assert files.blocks.count() > 3
    for size in ("2500", "4000", "20000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        with pytest.raises(Exception, match="other blocks"):
            files.lines().collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    assert files.lines().filter(F.concat(F.lit("line "), "line_no") != F.col("value")).count() == 0


def test_files_that_arrive_later_are_not_read(spark, folder):
    write(f"{folder}/b.txt", ["1", "2"])
    files = open_framed(spark, folder)
    write(f"{folder}/a.txt", ["3"] * 50)
    assert rows(files.lines().select("line_no", "value")) == [(1, "1"), (2, "2")]


def test_frame_over_several_files(spark, folder):
    """A header and trailer that are longer than their part files."""
    for part, lines in enumerate([["h1"], ["h2", "d1"], ["d2"], ["t1"], ["t2"]]):
        write(f"{folder}/part-{part}.txt", lines)
    files = open_framed(spark, folder, 2, 2, unit="folder")
    assert rows(files.frame().select("section", "ordinal", "value")) == [
        ("header", 1, "h1"), ("header", 2, "h2"), ("trailer", 1, "t1"), ("trailer", 2, "t2"),
    ]
    assert rows(files.lines().filter("section = 'data'").select("ordinal", "value")) == [(1, "d1"), (2, "d2")]


def test_gzip_windows_ends_and_blank_last_line(spark, folder):
    with gzip.open(f"{folder}/a.txt.gz", "wt", newline="") as file:
        file.write("head\r\none\r\ntwo\rstill two\r\nT=2\r\n\r\n")
    whole = frame_lines(spark, folder, 1, 1)
    assert whole.filter("section = 'trailer'").first()["value"] == ""
    clean = frame_lines(spark, folder, 1, 1, drop_blank_last=True)
    assert rows(clean.select("line_no", "section", "value")) == [
        (1, "header", "head"), (2, "data", "one"), (3, "data", "two\rstill two"), (4, "trailer", "T=2"),
    ]


def test_no_blank_line_to_drop(spark, folder):
    write(f"{folder}/a.txt", ["h", "d", "t"])
    clean = frame_lines(spark, folder, 1, 1, drop_blank_last=True)
    assert [r["section"] for r in clean.orderBy("line_no").collect()] == ["header", "data", "trailer"]


def test_frame_larger_than_the_file(spark, folder):
    write(f"{folder}/a.txt", ["only"])
    files = open_framed(spark, folder, 2, 2)
    assert files.counts().first().asDict() | {"unit": ""} == {
        "unit": "", "file_lines": 1, "header_lines": 1, "trailer_lines": 0, "data_lines": 0,
    }
    checks = quality.validate_frame(files.frame(), files.counts(), ["only", "second"], ["T"])
    assert rows(checks.select("section", "ordinal", "passed")) == [
        ("header", 1, True), ("header", 2, False), ("trailer", 1, False),
    ]


def test_sorted_lines(spark, folder):
    write(f"{folder}/a.txt", ["h", "b", "a", "C", "b"])
    got = sorted_data_lines(frame_lines(spark, folder, 1))
    assert rows(got) == [(1, "C"), (2, "a"), (3, "b"), (4, "b")]


def test_number_rows_over_partitions(spark):
    df = spark.range(0, 5000, 1, 16).select((F.col("id") * 7919 % 5000).alias("v"))
    numbered = number_rows(df, ["v"])
    assert numbered.filter(F.col("row_no") != F.col("v") + 1).count() == 0
    assert numbered.count() == 5000


def test_output_keeps_the_order_of_parts(spark, folder):
    lines = spark.range(0, 1000, 1, 8).orderBy(F.col("id").desc()).select(F.col("id").cast("string").alias("value"))
    framed = frame_output(lines, ["top", "N=¶DATALINECOUNT•int•06d¶"], ["end ¶EXPECTEDFILELINECOUNT•int•d¶"])
    write_lines(framed, f"{folder}/out")
    got = frame_lines(spark, f"{folder}/out", 2, 1, unit="folder").orderBy("line_no")
    assert [r["value"] for r in got.collect()] == [
        "top", "N=001000", *[str(i) for i in range(999, -1, -1)], "end 1003",
    ]


def test_output_as_single_file(spark, folder):
    lines = spark.range(0, 50, 1, 4).select(F.col("id").cast("string").alias("value"))
    write_lines(frame_output(lines, ["h"], ["t"]), f"{folder}/one", single_file=True)
    parts = list(Path(f"{folder}/one").glob("part-*"))
    assert len(parts) == 1
    assert parts[0].read_text().splitlines() == ["h", *[str(i) for i in range(50)], "t"]


def test_header_from_column_names():
    assert fill_column_names("AUTOPOPULATECOLNAMES", ["a", "b"]) == "a,b"
    assert fill_column_names("X AUTOPOPULATECOLNAMES", ["a", "b"], "|") == "X a|b"
    assert fill_column_names("AUTOPOPULATECOLNAMES", ["a", "b"], "|", ";", '"') == '"a";"b"'


def test_validation_ignores_marked_places(spark, folder):
    write(f"{folder}/a.txt", ["AT=2024-01-01 X", "d", "N=00000001"])
    files = open_framed(spark, folder, 1, 1)

    def check(header, trailer):
        checks = quality.validate_frame(files.frame(), files.counts(), [header], [trailer], "🧹")
        return [r[0] for r in rows(checks.select("passed"))]

    assert check("AT=🧹🧹🧹🧹🧹🧹🧹🧹🧹🧹 X", "N=¶EXPECTEDDATALINECOUNT•int•08d¶") == [True, True]
    assert check("AT=🧹🧹🧹🧹🧹🧹🧹🧹🧹🧹 Y", "N=00000002") == [False, False]
    assert check("", "N=00000001") == [True]


@pytest.mark.parametrize("last, label, matching", [
    ("ROWS=2", "ROWS", "Y"), ("ROWS=3", "ROWS", "N"), ("ROWS=x", "ROWS", ""), ("2", "", "Y"),
])
def test_trailer_count(spark, folder, last, label, matching):
    write(f"{folder}/a.txt", ["h", "d1", "d2", last])
    frame = open_framed(spark, folder, 1, 1).frame()
    assert quality.trailer_count_check(frame, label, 1, 1).first()["matching"] == matching


def test_conversion_keeps_line_order(spark, folder, small_blocks):
    columns = ["id", "name"]
    fixed = FileLayout(columns, FIXED_WIDTH, widths=[8, 20], alignments=[">", "^"], headers=["H"], validate=True)
    plain = FileLayout(columns, headers=["H ¶DATALINECOUNT•int•d¶"], trailers=["T"], validate=True)
    ids = [(i * 7919) % 1000 for i in range(1000)]
    data = spark.createDataFrame([(n, str(i), f"name {i}") for n, i in enumerate(ids)], "place int, id string, name string")
    jobs.write_file(data, f"{folder}/in", fixed, order=["place"])
    jobs.convert_file(spark, f"{folder}/in", fixed, f"{folder}/out", plain)
    got = frame_lines(spark, f"{folder}/out", 1, 1, "folder").orderBy("line_no").collect()
    assert [r["value"] for r in got] == ["H 1000", *[f"{i},name {i}" for i in ids], "T"]


def test_bad_frame_stops_the_job(spark, folder):
    write(f"{folder}/a.txt", ["wrong", "1,2"])
    layout = FileLayout(["a", "b"], headers=["right"], validate=True, unit="file")
    with pytest.raises(quality.CheckFailed):
        jobs.read_file(spark, f"{folder}/a.txt", layout)


def test_parts_are_ordered_by_number(spark, folder):
    """Names of parts from number 100000 on no longer sort like their numbers."""
    for number, line in ((0, "HEAD"), (99998, "d1"), (99999, "d2"), (100000, "d3"), (100001, "TAIL")):
        Path(folder, f"part-{number:05d}-x.txt").write_text(line + "\n")
    lines = frame_lines(spark, folder, 1, 1, unit="folder")
    got = sorted((r["line_no"], r["section"], r["value"]) for r in lines.collect())
    assert got == [(1, "header", "HEAD"), (2, "data", "d1"), (3, "data", "d2"), (4, "data", "d3"), (5, "trailer", "TAIL")]


def test_names_that_look_like_patterns(spark, folder):
    for number in range(9):
        Path(folder, f"part[{number}]{{a}}.txt").write_text(f"line {number}\n")
    frame = open_framed(spark, folder, 1, 1, unit="folder").frame()
    assert sorted(r["value"] for r in frame.collect()) == ["line 0", "line 8"]


def test_blank_expected_lines_are_not_checked(spark, folder):
    Path(folder, "one.txt").write_text("a\nb\n")
    files = open_framed(spark, folder + "/one.txt", 1, 0)
    assert quality.validate_frame(files.frame(), files.counts(), [""], []).count() == 0


def test_a_load_stops_before_the_table_changes(spark, folder):
    layout = FileLayout(["a", "b"], delimiter=",", quote='"', validate=True)
    spark.createDataFrame([("0", "x")], "a string, b string").write.parquet(f"{folder}/table")
    for n, bad in enumerate(('"3"', '"3","b","EXTRA"', '"4","x" y"', '"5","open')):
        Path(folder, f"in{n}").mkdir()
        Path(folder, f"in{n}", "part-00000").write_text(f'"1","a"\n"2","say ""hi"", ok"\n{bad}\n')
        with pytest.raises(quality.CheckFailed):
            jobs.load_file(spark, f"{folder}/in{n}", layout, f"{folder}/table", "append_load")
    assert rows(spark.read.parquet(f"{folder}/table")) == [("0", "x")]
