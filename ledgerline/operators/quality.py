"""Checks that compare what is there with what should be there.

Each check is a DataFrame with a ``passed`` column; ``require`` turns it into an
error for a job that must stop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.functions.lines import any_of, mask_line
from ledgerline.functions.tokens import render
from ledgerline.sources.framed import DATA, HEADER, TRAILER


class CheckFailed(ValueError):
    """A check of a job did not pass."""


def require(checks: DataFrame, what: str) -> None:
    """Raise with the first failures when a row of ``checks`` has not passed."""
    failed = checks.filter(~F.col("passed")).limit(5).collect()
    if failed:
        raise CheckFailed(f"{what}: " + "; ".join(str(row.asDict()) for row in failed))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row with the number columns of all inputs, each of which has one row."""
    tagged = None
    for row in rows:
        entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("value")) for c in row.columns])
        long = row.select(F.explode(entries).alias("entry")).select("entry.*")
        tagged = long if tagged is None else tagged.unionByName(long)
    names = [c for row in rows for c in row.columns]
    return tagged.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def validate_frame(frame: DataFrame, counts: DataFrame, headers: Sequence[str], trailers: Sequence[str],
                   ignore: str | None = None, values: Mapping[str, object] | None = None) -> DataFrame:
    """Expected and actual header and trailer lines of each unit: ``section, ordinal,
    expected, actual, passed``. ``frame`` and ``counts`` come from the opened files.

    Empty expected lines are not checked; where the expected line holds ``ignore``
    the actual character does not matter; a missing line fails. The expected lines
    may use the tokens ``FILENAME``, ``FILELINECOUNT`` and ``EXPECTEDDATALINECOUNT``
    of the file that is checked, besides ``values``.
    """
    frame_size = len(headers) + len(trailers)
    known = {
        "FILENAME": F.element_at(F.split("unit", "/"), -1),
        "FILELINECOUNT": F.col("file_lines"),
        "EXPECTEDDATALINECOUNT": F.col("file_lines") - frame_size,
        **(values or {}),
    }
    slots = [(HEADER, i, t) for i, t in enumerate(headers, 1) if t]
    slots += [(TRAILER, i, t) for i, t in enumerate(trailers, 1) if t]
    # Without lines to check the array is empty, which has no type of its own.
    wanted = F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(i).cast("bigint").alias("ordinal"), render(t, known).alias("expected"))
        for s, i, t in slots
    ]).cast("array<struct<section:string,ordinal:bigint,expected:string>>")
    expected = counts.select("unit", F.explode(wanted).alias("slot")).select("unit", "slot.*")
    actual_lines = frame.filter(F.col("section") != DATA).select("unit", "section", "ordinal", "value")
    found = expected.join(actual_lines, ["unit", "section", "ordinal"], "left")
    actual = mask_line(F.col("expected"), F.col("value"), ignore) if ignore else F.col("value")
    return found.select(
        "unit", "section", "ordinal", "expected", F.col("value").alias("actual"),
        F.coalesce(actual == F.col("expected"), F.lit(False)).alias("passed"),
    )


def reconcile_input(counts: DataFrame, n_head: int, n_tail: int) -> DataFrame:
    """Expected data lines of each unit: all lines without the frame."""
    return counts.select(
        "unit", "file_lines", (F.col("file_lines") - n_head - n_tail).alias("expected_data_lines")
    )


def reconcile_output(counts: DataFrame, processed: DataFrame, n_head: int, n_tail: int) -> DataFrame:
    """A written file against the rows that went into it: lines = data + frame and
    processed rows = data lines. ``processed`` is a count of one row."""
    written = counts.agg(F.sum("file_lines").alias("file_lines"), F.sum("data_lines").alias("data_lines"))
    whole = side_by_side(written, processed.toDF("processed_rows"))
    expected = F.col("data_lines") + n_head + n_tail
    passed = (F.col("file_lines") == expected) & (F.col("processed_rows") == F.col("data_lines"))
    return whole.select("*", expected.alias("expected_file_lines"), passed.alias("passed"))


def reconcile_load(rows_before: DataFrame, rows_after: DataFrame, processed: DataFrame,
                   expected_data_lines: DataFrame) -> DataFrame:
    """Rows added to a table = processed rows = data lines of the file. Each input is
    a count of one row."""
    whole = side_by_side(rows_before.toDF("rows_before"), rows_after.toDF("rows_after"),
                         processed.toDF("processed_rows"), expected_data_lines.toDF("expected_rows"))
    added = F.col("rows_after") - F.col("rows_before")
    passed = (added == F.col("processed_rows")) & (F.col("processed_rows") == F.col("expected_rows"))
    return whole.select(added.alias("added_rows"), "processed_rows", "expected_rows", passed.alias("passed"))


def trailer_count_check(frame: DataFrame, label: str, n_head: int, n_tail: int) -> DataFrame:
    """The number in the last line (label and ``=`` removed) against the lines without
    the frame: ``Y``, ``N``, or blank when it is no number."""
    last = frame.filter(F.col("line_no") == F.col("total_lines"))
    text = F.trim(F.replace("value", F.lit(label), F.lit(""))) if label else F.trim("value")
    number = F.replace(text, F.lit("="), F.lit("")).try_cast("bigint")
    expected = F.col("total_lines") - n_head - n_tail
    result = F.when(number.isNull(), F.lit("")).when(number == expected, F.lit("Y")).otherwise(F.lit("N"))
    return last.select("unit", F.col("value").alias("last_line"), number.alias("stated_rows"),
                       expected.alias("expected_rows"), result.alias("matching"))


def key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether ``keys`` are unique and not NULL: ``total_rows, distinct_keys,
    duplicate_keys, null_key_rows, most_rows_per_key, is_key``. Keys are counted in
    place before the shuffle, so a frequent key costs nothing."""
    has_null = any_of([F.col(f"`{k}`").isNull() for k in keys])
    per_key = df.select(*[F.col(f"`{k}`") for k in keys]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    counts = per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("_rows") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(has_null, F.col("_rows")).otherwise(0)), F.lit(0)).alias("null_key_rows"),
        F.coalesce(F.max("_rows"), F.lit(0)).alias("most_rows_per_key"),
    )
    return counts.withColumn("is_key", (F.col("duplicate_keys") == 0) & (F.col("null_key_rows") == 0))


def schema_profile(df: DataFrame) -> DataFrame:
    """``position, column_name, data_type`` of a table, from its schema alone."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position long, column_name string, data_type string")


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Table and view names of a schema."""
    names = [(t.name,) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(names, "table_name string")


def predicate_is_valid(df: DataFrame, predicate: str) -> bool:
    """Whether a predicate can be applied; decided by analysis, no row is read."""
    try:
        df.filter(F.expr(predicate)).schema
    except AnalysisException:
        return False
    return True
