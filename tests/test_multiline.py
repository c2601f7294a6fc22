"""Records over several lines, in blocks of any size."""

import csv
import io
import random

import pytest

from conftest import rows
from ledgerline.plans import jobs
from ledgerline.plans.layouts import FileLayout
from ledgerline.sources.multiline import read_delimited_multiline, read_records

BLOCK_SIZES = [90, 1 << 27]


@pytest.fixture
def blocks(spark, request):
    """Files are cut into blocks of the given size."""
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield cut
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


def cells(seed, count):
    rng = random.Random(seed)
    pieces = ["a", "b,c", '"', '""', "\n", "\n\n", "word", " ", "\n\"\n", "été", "日本"]
    return [[str(n), *["".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(2)]] for n in range(count)]


def written(path, records, head="", tail=""):
    text = io.StringIO()
    csv.writer(text, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(records)
    path.write_text(head + text.getvalue() + tail, newline="")
    return str(path)


@pytest.mark.parametrize("size", BLOCK_SIZES)
def test_records_are_those_of_one_reader(spark, tmp_path, blocks, size):
    records = cells(1, 30)
    path = written(tmp_path / "a.csv", records)
    blocks(size)
    got = read_delimited_multiline(spark, path, ["id", "x", "y"], escape="", keep=["line_no", "lines"])
    found = sorted(got.collect(), key=lambda r: int(r["id"]))
    assert [[r["id"], r["x"] or "", r["y"] or ""] for r in found] == records
    line = 1
    for row, record in zip(found, records):
        assert (row["line_no"], row["lines"]) == (line, 1 + sum(c.count("\n") for c in record))
        line += row["lines"]


@pytest.mark.parametrize("size", BLOCK_SIZES)
def test_quotes_of_the_frame_do_not_count(spark, tmp_path, blocks, size):
    records = cells(2, 25)
    head, tail = 'odd " header\nsecond\n', 'T"\n"RECORDS" 25 "\n'
    path = written(tmp_path / "a.csv", records, head, tail)
    blocks(size)
    got = read_delimited_multiline(spark, path, ["id", "x", "y"], escape="", n_head=2, n_tail=2)
    assert [[r["id"], r["x"] or "", r["y"] or ""] for r in sorted(got.collect(), key=lambda r: int(r["id"]))] == records


@pytest.mark.parametrize("size", [250, 1 << 27])
def test_a_record_over_many_blocks_and_files_of_their_own(spark, tmp_path, blocks, size):
    long = "\n".join(f"line {n} of one field, \"\" quoted" for n in range(40)).replace('""', '"')
    for n in range(3):
        written(tmp_path / f"part-{n}.csv", [[str(n), long, "x\ny"], [str(n + 10), "", f"z{n}"]])
    blocks(size)
    got = read_delimited_multiline(spark, str(tmp_path), ["id", "x", "y"], escape="")
    assert rows(got) == sorted([*[(str(n), long, "x\ny") for n in range(3)], *[(str(n + 10), None, f"z{n}") for n in range(3)]], key=str)
    whole = read_records(spark, str(tmp_path), unit="folder")
    assert whole.count() == 6 and whole.select("line_no").distinct().count() == 6


def test_line_ends_inside_fields_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'"1","a\r\nb"\r\n"2","c\rd"\r\n')
    got = read_delimited_multiline(spark, str(tmp_path / "a.csv"), ["id", "x"], escape="")
    assert rows(got) == [("1", "a\r\nb"), ("2", "c\rd")]


def test_odd_files(spark, tmp_path, blocks):
    (tmp_path / "empty.csv").write_text("")
    assert read_records(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "short.csv").write_text("H\nT\n")
    assert read_records(spark, str(tmp_path / "short.csv"), n_head=2, n_tail=2).count() == 0
    (tmp_path / "open.csv").write_text('"1","a"\n"2","never\ncloses\n"3","\n')
    blocks(8)
    found = rows(read_records(spark, str(tmp_path / "open.csv")).select("line_no", "lines"))
    assert found[0] == (1, 1) and sum(n for _, n in found) <= 4
    with pytest.raises(ValueError):
        read_records(spark, str(tmp_path / "open.csv"), quote="")


def test_jobs_read_and_write_records_over_lines(spark, tmp_path, blocks):
    records = cells(3, 50)
    text = written(tmp_path / "in.csv", records, "NAMES\n", "RECORDCOUNT=00000050\n")
    layout = FileLayout(["id", "x", "y"], quote='"', escape="", headers=["NAMES"], unit="file", validate=True, multiline=True,
                        trailers=["RECORDCOUNT=¶EXPECTEDDATALINECOUNT•int•08d¶"])
    blocks(400)
    got = jobs.read_file(spark, text, layout)
    assert sorted([[r["id"], r["x"] or "", r["y"] or ""] for r in got.collect()], key=lambda r: int(r[0])) == records
    target = str(tmp_path / "table")
    spark.createDataFrame([], "id string, x string, y string").write.parquet(target)
    check = jobs.load_file(spark, text, layout, target, "append_load")
    assert check.first()["passed"] and spark.read.parquet(target).count() == 50
    out = jobs.write_file(got, str(tmp_path / "out"), FileLayout(
        ["id", "x", "y"], quote='"', headers=["NAMES"], trailers=["RECORDCOUNT=¶DATALINECOUNT•int•08d¶"], validate=True, multiline=True))
    assert rows(jobs.read_file(spark, out, FileLayout(["id", "x", "y"], quote='"', headers=["NAMES"], trailers=["T"], multiline=True))) == rows(got)
    bad = FileLayout(["id", "x"], quote='"', escape="", headers=["NAMES"], trailers=layout.trailers, unit="file", validate=True, multiline=True)
    with pytest.raises(Exception, match="malformed|fields"):
        jobs.read_file(spark, text, bad).collect()


def test_surplus_and_missing_fields_stop_every_job(spark, tmp_path):
    (tmp_path / "in.csv").write_text('"1","x"\n"2","b","EXTRA"\n"3"\n')
    layout = FileLayout(["id", "x"], quote='"', validate=True)
    fixed = FileLayout(["id", "x"], "fixed_width", widths=[5, 5], alignments=["<", "<"])
    source = str(tmp_path / "in.csv")
    with pytest.raises(Exception, match="malformed"):
        jobs.read_file(spark, source, layout).collect()
    with pytest.raises(Exception, match="malformed"):
        jobs.convert_file(spark, source, layout, str(tmp_path / "out"), fixed)
    with pytest.raises(Exception, match="malformed"):
        jobs.combine_files(spark, source, layout, source, layout, lambda a, b: a.join(b.select("id"), "id"), str(tmp_path / "both"), fixed)
    from ledgerline.plans.layouts import CompareSpec
    with pytest.raises(Exception, match="malformed"):
        jobs.compare_files(spark, source, layout, source, layout, CompareSpec("c", ["id"]), str(tmp_path / "report"))
    framed = FileLayout(["id", "x"], quote='"', headers=["A,B,C"], trailers=["END"], validate=True)
    (tmp_path / "framed").mkdir()
    (tmp_path / "framed" / "part-0.csv").write_text('A,B,C\n"1","x"\n"2","y"\nEND\n')
    both = jobs.combine_files(spark, str(tmp_path / "framed"), framed, str(tmp_path / "framed"), framed,
                              lambda a, b: a.join(b.select("id"), "id"), str(tmp_path / "joined"), fixed)
    assert spark.read.text(both).count() == 2  # lines of the frame are no malformed records
    lenient = FileLayout(["id", "x"], quote='"')
    assert rows(jobs.read_file(spark, source, lenient)) == [("1", "x"), ("2", "b"), ("3", None)]
