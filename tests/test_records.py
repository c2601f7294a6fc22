"""Records: delimited and fixed width, both ways, and line expressions."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows
from ledgerline.functions import lines as ln
from ledgerline.functions.tokens import file_name, render, spark_date_pattern
from ledgerline.operators.search import escape_like, search_ilike
from ledgerline.sinks.records import delimited_lines, fixed_width_lines
from ledgerline.sources.records import normalise_delimiters, read_delimited, read_fixed_width, split_normalised
from ledgerline.sources.tables import JdbcTable, posts, read_posts

HARD = [
    ("1", 'say "hi", now', "back\\slash"), ("2", "", None), ("3", '""', "\\"), ("4", ",,", "a\\,b"),
    ("5", "line\nbreak", '\\"'), ("6", "  blanks  ", "'"), ("7", "é🤩", "|"), ("8", '"', '",'), ("9", "\\\\", "end\\\\"),
]


def lines_of(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize("sep, quote", [(",", '"'), ("|", "🤩"), (";", "'"), (",", None), ("|", None), ("||", None)])
def test_round_trip(spark, sep, quote):
    df = spark.createDataFrame(HARD, "a string, b string, c string")
    back = read_delimited(delimited_lines(df, None, sep, quote), ["a", "b", "c"], sep, quote)
    assert rows(back) == sorted((a, b or None, c) for a, b, c in HARD)


text = st.text(alphabet=st.sampled_from(list('ab ,"\\|\n\'é')), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(text, text), min_size=1, max_size=30), st.sampled_from(['"', None]))
def test_round_trip_of_any_text(spark, pairs, quote):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    back = read_delimited(delimited_lines(df, None, ",", quote), ["i", "a", "b"], ",", quote)
    assert {r["i"]: (r["a"], r["b"]) for r in back.collect()} == {
        str(i): (a or None, b or None) for i, (a, b) in enumerate(pairs)
    }


def test_written_form(spark):
    df = spark.createDataFrame([("a", 'x"y', None)], "k string, v string, n string")
    assert delimited_lines(df, None, ",", '"').first()[0] == '"a","x""y",""'
    assert delimited_lines(df, None, "|").first()[0] == 'a|x"y|'


def test_leading_zeros_stay(spark):
    assert read_delimited(lines_of(spark, ["0001,007"]), ["a", "b"]).first().asDict() == {"a": "0001", "b": "007"}


def test_short_lines_give_nulls(spark):
    assert rows(read_delimited(lines_of(spark, ["1"]), ["a", "b"])) == [("1", None)]
    assert rows(read_delimited(lines_of(spark, ['"1"']), ["a", "b"], quote='"')) == [("1", None)]


def test_fixed_width(spark):
    df = spark.createDataFrame([("1", "abc", "x", "mid"), ("22", "longer than width", None, "even")],
                               "a string, b string, c string, d string")
    lines = [r[0] for r in fixed_width_lines(df, df.columns, [4, 6, 3, 6], ["<", ">", "<", "^"]).collect()]
    assert lines == ["1      abcx   mid  "[:0] + "1   " + "   abc" + "x  " + " mid  ", "22  longer than width    even "]
    back = read_fixed_width(lines_of(spark, lines[:1]), df.columns, [4, 6, 3, 6])
    assert rows(back) == [("1", "abc", "x", "mid")]
    for width in (5, 6, 7, 8):
        padded = df.select(ln.pad_cell(F.col("d"), width, "^")).collect()
        assert [p[0] for p in padded] == [f"{'mid':^{width}}", f"{'even':^{width}}"]


def test_normalise_delimiters(spark):
    lines = lines_of(spark, ['"a,b","c\\,d",e\\"f'])
    assert normalise_delimiters(lines, ",", '"').first()[0] == 'a␟b␟c\\,d␟e\\"f'
    assert rows(split_normalised(normalise_delimiters(lines_of(spark, ["a|b"]), "|"), ["x", "y"])) == [("a", "b")]


def test_mask(spark):
    df = spark.createDataFrame([("aba bbb cbc", "xxx yy"), ("no mark", "x"), ("b", ""), ("ab", None)], "e string, a string")
    got = [r[0] for r in df.select(ln.mask_line(F.col("e"), F.col("a"), "b")).collect()]
    assert got == ["xbx bb", "x", "", None]


@pytest.mark.parametrize("positions, expected", [
    ("0,2", "defghij"), ("3,5", "abcghij"), ("0,0,9,9", "bcdefghi"), ("0,3,9,12", "efghi"), ("ALL", "abcdefghij"),
    ("0,99", ""), ("", "abcdefghij"),
])
def test_cut(spark, positions, expected):
    df = lines_of(spark, ["abcdefghij"])
    assert df.select(ln.cut_spans(F.col("value"), ln.spans_of(positions))).first()[0] == expected


@pytest.mark.parametrize("positions", ["1", "1,x", "1,2,3"])
def test_bad_positions(positions):
    with pytest.raises(ValueError):
        ln.spans_of(positions)


def test_lists(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "items array<string>")
    got = df.select(ln.list_to_json(F.col("items")), ln.list_to_text(F.col("items"))).collect()
    assert [tuple(r) for r in got] == [('["a","b"]', "a,b"), ("[]", ""), ("[]", "")]
    texts = spark.createDataFrame([('["a", "b"]', "a,b"), ("", ""), (None, None)], "j string, t string")
    got = texts.select(ln.json_to_list(F.col("j")), ln.text_to_list(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], ["a", "b"]), ([], []), ([], [])]


def test_table_name(spark):
    df = lines_of(spark, ["db.dbo.[order]", "order", "[a].[b]"])
    assert [r[0] for r in df.select(ln.clean_table_name(F.col("value"))).collect()] == ["order", "order", "b"]


def test_pads(spark):
    df = lines_of(spark, ["123456"])
    assert tuple(df.select(ln.zero_pad(F.col("value"), 8), ln.zero_pad(F.col("value"), 4),
                           ln.zero_pad(F.col("value"), 4, "right"), ln.blank_pad(F.col("value"), 8)).first()) == (
        "00123456", "1234", "3456", "123456  ")


def test_tokens(spark):
    values = {"N": F.lit(7), "P": F.lit(3.14159), "S": "abc", "BDATE": dt.date(2024, 3, 9), "NEG": F.lit(-5)}
    template = "¶N•int•08d¶|¶N•int•5d¶|¶N•int•d¶|¶P•float•.2f¶|¶P•float•08.3f¶|¶S•str•<6¶|¶S•str•*>6¶|¶S•str•^6¶|¶NEG•int•05d¶|¶BDATE•date•DD/MM/YY¶"
    expected = f"{7:08d}|{7:5d}|7|3.14|{3.14159:08.3f}|abc   |***abc| abc  |{-5:05d}|09/03/24"
    assert spark.range(1).select(render(template, values)).first()[0] == expected
    assert spark.range(1).select(render("plain", {})).first()[0] == "plain"
    assert file_name("File_¶BDATE•date•YYYYMMDD¶", dt.date(2024, 3, 9), ".csv") == "File_20240309.csv"


def test_date_patterns(spark):
    assert spark_date_pattern("YYYY-MM-DDHH:mm:ss") == "yyyy-MM-ddHH:mm:ss"
    with pytest.raises(ValueError):
        spark_date_pattern("Q")


def test_like_marks_are_plain_text(spark):
    df = lines_of(spark, ["50% off", "500 off", "a_b", "axb", "c\\d"])
    assert escape_like("50%_") == "50\\%\\_"
    assert rows(search_ilike(df, ["value"], "50%")) == [("50% off",)]
    assert rows(search_ilike(df, ["value"], "A_b")) == [("a_b",)]
    assert rows(search_ilike(df, ["value"], "C\\D")) == [("c\\d",)]


def test_posts(spark, tmp_path):
    body = '{"userId": 1, "id": 2, "title": "t", "body": "a\\nb"}'
    assert rows(posts(lines_of(spark, [body]))) == [(1, 2, "t", "a b")]
    (tmp_path / "posts.json").write_text(f"[{body},\n{body}]")
    assert rows(read_posts(spark, str(tmp_path))) == [(1, 2, "t", "a b")] * 2


def test_jdbc_options():
    table = JdbcTable("jdbc:x:y", "dbo.order", column="id", lower="1", upper="900", partitions=8, properties={"user": "u"})
    assert table.options() == {
        "url": "jdbc:x:y", "dbtable": "dbo.order", "fetchsize": "10000", "user": "u",
        "partitionColumn": "id", "lowerBound": "1", "upperBound": "900", "numPartitions": "8",
    }
    with pytest.raises(ValueError):
        JdbcTable("jdbc:x:y", "t", column="id").options()
