"""Whole jobs: convert, combine, extract, load, compare.

A check that fails raises and stops the job.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.operators import compare as cmp
from ledgerline.operators import quality
from ledgerline.operators.search import pivot_date, pivot_date_filter
from ledgerline.plans.layouts import DELIMITED, CompareSpec, FileLayout, Side
from ledgerline.session import stage
from ledgerline.sinks.framed import fill_column_names, frame_output, write_lines
from ledgerline.sinks.records import delimited_lines, fixed_width_lines
from ledgerline.sinks.report import META, SUMMARY, compare_report, read_report, write_report
from ledgerline.sinks.runs import Run, recorded_run
from ledgerline.sinks.tables import DuplicateKeyError, load_table
from ledgerline.sources.framed import DATA, FramedFiles, data_lines, open_framed, plain_line
from ledgerline.sources.multiline import read_records
from ledgerline.sources.records import malformed_lines, read_delimited, read_fixed_width, well_formed
from ledgerline.sources.tables import posts, row_count


SHOWN_TEXT = 200  # characters of a malformed line in the error that names it


# --- files -----------------------------------------------------------------

def parse(lines: DataFrame, layout: FileLayout, keep: Sequence[str] = ()) -> DataFrame:
    if layout.kind == DELIMITED:
        return read_delimited(lines, layout.columns, layout.delimiter, layout.quote, layout.escape, keep, layout.multiline)
    return read_fixed_width(lines, layout.columns, layout.widths, keep)


def _checked(lines: DataFrame, layout: FileLayout, among: Column | None = None) -> DataFrame:
    """``lines``; with ``layout.validate`` a delimited one that does not have the layout's fields
    fails the job that reads it. ``among`` says which lines are records; it is part of the
    check, because Spark may test a value before it leaves out other lines."""
    if not layout.validate or layout.kind != DELIMITED:
        return lines
    whole = well_formed(len(layout.columns), layout.delimiter, layout.quote, layout.escape)
    told = F.concat(F.lit(f"malformed line, not {len(layout.columns)} fields: "), F.left("value", F.lit(SHOWN_TEXT)))
    fails = ~whole if among is None else among & ~whole
    return lines.withColumn("value", F.when(fails, F.raise_error(told).cast("string")).otherwise(F.col("value")))


def render_lines(rows: DataFrame, layout: FileLayout) -> DataFrame:
    if layout.kind == DELIMITED:
        return delimited_lines(rows, layout.columns, layout.delimiter, layout.quote, layout.escape)
    return fixed_width_lines(rows, layout.columns, layout.widths, layout.alignments)


def read_file(spark: SparkSession, path: str, layout: FileLayout, values: Mapping[str, object] | None = None,
              keep: Sequence[str] = ()) -> DataFrame:
    """Records of a framed file. With ``layout.validate`` its header and trailer
    lines are checked first. ``keep`` may name ``unit`` and ``line_no``."""
    n_head, n_tail = layout.frame
    if not (n_head or n_tail or keep or layout.multiline):
        lines = spark.read.text(path, lineSep="\n")  # nothing to count
        return parse(_checked(lines.select(plain_line(F.col("value")).alias("value")), layout), layout)
    return _records(open_framed(spark, path, n_head, n_tail, layout.unit), layout, values, keep)


def _counts(files: FramedFiles, layout: FileLayout) -> DataFrame:
    """Lines per unit; where records may have several lines, a record counts as one, as it
    does in the frame that :func:`write_file` writes."""
    counts = files.counts()
    if not layout.multiline:
        return counts
    found = read_records(files.spark, files.path, layout.quote, files.n_head, files.n_tail, layout.unit) \
        .groupBy("unit").agg(F.count(F.lit(1)).alias("records"))
    frame = F.col("header_lines") + F.col("trailer_lines")
    return stage(counts.join(F.broadcast(found), "unit", "left").select(
        "unit", (frame + F.coalesce("records", F.lit(0))).alias("file_lines"), "header_lines",
        F.coalesce("records", F.lit(0)).alias("data_lines"), "trailer_lines"), "counts")


def _records(files: FramedFiles, layout: FileLayout, values: Mapping[str, object] | None = None,
             keep: Sequence[str] = (), check_fields: bool = False) -> DataFrame:
    if layout.validate and any(layout.frame):
        checks = quality.validate_frame(
            files.frame(), _counts(files, layout), layout.headers, layout.trailers, layout.ignore, values
        )
        quality.require(checks, f"frame of {files.path}")
    if layout.multiline:
        lines = read_records(files.spark, files.path, layout.quote, files.n_head, files.n_tail, layout.unit).select(*keep, "value")
        lines = lines if check_fields else _checked(lines, layout)
    else:
        lines = files.lines() if check_fields else _checked(files.lines(), layout, F.col("section") == DATA)
        lines = data_lines(lines, *keep)
    if check_fields and layout.validate and layout.kind == DELIMITED:
        broken = malformed_lines(lines, len(layout.columns), layout.delimiter, layout.quote, layout.escape)
        found = broken.agg(F.count(F.lit(1)).alias("malformed_lines"), F.min("value").alias("first"))
        quality.require(found.withColumn("passed", F.col("malformed_lines") == 0), f"fields of {files.path}")
    return parse(lines, layout, keep)


def write_file(rows: DataFrame, path: str, layout: FileLayout, values: Mapping[str, object] | None = None,
               order: Sequence[str] = (), costly: bool = False, single_file: bool = False) -> str:
    """Write rows as a framed file and, with ``layout.validate``, count it again.

    Lines come in the order of ``order``, else as the rows come. ``FILENAME`` in the frame is
    the last part of ``path``. Rows are read
    twice, once for the counts in the frame; ``costly`` stages them in between, for
    rows that come out of a join.
    """
    spark = rows.sparkSession
    if costly:
        rows = stage(rows.select(*order, *[c for c in layout.columns if c not in order]), "rows")
    placed = rows.orderBy(*order) if order else rows
    headers = [
        fill_column_names(h, layout.columns, layout.delimiter if layout.kind == DELIMITED else None,
                          layout.header_delimiter, layout.header_quote)
        for h in layout.headers
    ]
    named = {"FILENAME": path.rstrip("/").rsplit("/", 1)[-1], **(values or {})}
    framed = frame_output(render_lines(placed, layout), headers, layout.trailers, named)
    write_lines(framed, path, single_file)
    if layout.validate:
        n_head, n_tail = layout.frame
        counts = _counts(open_framed(spark, path, n_head, n_tail, "folder"), replace(layout, unit="folder"))
        quality.require(quality.reconcile_output(counts, row_count(rows), n_head, n_tail), f"counts of {path}")
    return path


def convert_file(spark: SparkSession, source: str, source_layout: FileLayout, target: str,
                 target_layout: FileLayout, values: Mapping[str, object] | None = None,
                 keep_order: bool = True) -> str:
    """Fixed width to delimited, delimited to fixed width, or a change of frame.

    Lines keep their order, which takes a range sort by line number; switch it off
    where the receiver does not care.
    """
    place = ("unit", "line_no") if keep_order else ()
    rows = read_file(spark, source, source_layout, values, place)
    return write_file(rows, target, target_layout, values, order=place)


def combine_files(spark: SparkSession, left: str, left_layout: FileLayout, right: str, right_layout: FileLayout,
                  combine: Callable[[DataFrame, DataFrame], DataFrame], target: str, target_layout: FileLayout,
                  values: Mapping[str, object] | None = None) -> str:
    """Two files joined by ``combine`` and written as a third."""
    rows = combine(read_file(spark, left, left_layout, values), read_file(spark, right, right_layout, values))
    return write_file(rows, target, target_layout, values, costly=True)


def posts_to_file(json_text: DataFrame, target: str, layout: FileLayout,
                  values: Mapping[str, object] | None = None) -> str:
    return write_file(posts(json_text), target, layout, values)


def extract_to_file(rows: DataFrame, target: str, layout: FileLayout,
                    values: Mapping[str, object] | None = None, costly: bool = False) -> str:
    """A table or the result of a query as a framed file."""
    return write_file(rows, target, layout, values, costly=costly)


def load_file(spark: SparkSession, source: str, layout: FileLayout, table: str, load_type: str,
              keys: Sequence[str] = (), values: Mapping[str, object] | None = None) -> DataFrame:
    """A framed file into the Parquet table at ``table``; returns the count check.

    For a merge the check compares the file with the rows that were merged, since
    updates add no rows. With ``layout.validate`` a line that has not the layout's fields
    stops the load; neither it nor a wrong count leaves anything in the table.
    """
    n_head, n_tail = layout.frame
    files = open_framed(spark, source, n_head, n_tail, layout.unit)
    rows = stage(_records(files, layout, values, check_fields=True), "load")
    expected = quality.reconcile_input(_counts(files, layout), n_head, n_tail).agg(F.sum("expected_data_lines"))
    nothing = spark.range(1).select(F.lit(0).cast("bigint"))
    before = nothing
    # Before the table changes: the records are as many as the file's lines.
    read = stage(quality.reconcile_load(nothing, row_count(rows), row_count(rows), expected), "check")
    quality.require(read, f"load of {source}")
    if load_type == "append_load":
        before = stage(row_count(spark.read.parquet(table)), "count")
    loaded = load_table(spark, table, rows, load_type, keys)
    after = row_count(rows if load_type == "merge_and_load" else loaded)
    checked = stage(quality.reconcile_load(before, after, row_count(rows), expected), "check")
    quality.require(checked, f"load of {source}")
    return checked


# --- steps -----------------------------------------------------------------

def custom_step(df: DataFrame, step: str | Callable[..., DataFrame], **arguments: object) -> DataFrame:
    """Apply a user function from DataFrame to DataFrame, given or named as
    ``module.function``."""
    if isinstance(step, str):
        module, _, name = step.rpartition(".")
        step = getattr(importlib.import_module(module), name)
    return df.transform(step, **arguments)


# --- comparisons -----------------------------------------------------------

def _chosen_rows(df: DataFrame, side: Side, spec: CompareSpec) -> DataFrame:
    if side.where:
        df = df.filter(F.expr(side.where))
    if side.slice:
        day = pivot_date(side.slice.choice, spec.batch_date, side.slice.custom)
        df = pivot_date_filter(df, side.slice.column, day, side.slice.date_format)
    return df


def compare_tables(left: DataFrame, right: DataFrame, spec: CompareSpec, path: str,
                   history: str | None = None) -> str:
    """Compare two tables (or query results) and write the report to ``path``.

    Keys that repeat are reported. A strict definition checks them before the
    comparison starts and raises; keys that pass let the rows be joined. ``history`` is
    the run log that the comparison leaves its start, end, report and figures in.
    """
    with recorded_run(left.sparkSession, history, spec.name) as run:
        _compare(left, right, spec, path)
        _note_report(run, path, history)
    return path


def _note_report(run: Run, path: str, history: str | None) -> None:
    """The report's place and its overall figures, read from the written report."""
    if history is None:
        return
    run.report = path
    meta = read_report(run.spark, path, META).filter(F.col("config_name").like("Overall%Count"))
    totals = read_report(run.spark, path, SUMMARY).agg(F.max("total_left"), F.max("total_right")).first()
    run.figures.update({row["config_name"]: int(row["config_value"]) for row in meta.collect()},
                       LeftRows=totals[0] or 0, RightRows=totals[1] or 0)


def _compare(left: DataFrame, right: DataFrame, spec: CompareSpec, path: str) -> str:
    left, right = _chosen_rows(left, spec.left, spec), _chosen_rows(right, spec.right, spec)
    keys = cmp.chosen_keys(spec.keys, spec.left.keys, spec.right.keys)
    columns = cmp.common_columns(left, right, spec.exclude)
    unique = False
    if spec.strict:
        checks = [quality.key_check(side, keys).first() for side in (left, right)]
        if any(check["duplicate_keys"] for check in checks):
            raise DuplicateKeyError(f"{spec.name}: the keys {keys} repeat")
        unique = all(check["is_key"] for check in checks)
    meta = {**spec.meta, "UniqueColumns": ",".join(keys), "ExcludedColumns": ",".join(spec.exclude)}
    return write_report(compare_report(left, right, keys, columns, meta, unique), path)


def compare_files(spark: SparkSession, left: str, left_layout: FileLayout, right: str, right_layout: FileLayout,
                  spec: CompareSpec, path: str, history: str | None = None) -> str:
    """Compare two framed files and write the report to ``path``; ``history`` as in
    :func:`compare_tables`. The run starts before the files are read."""
    with recorded_run(spark, history, spec.name) as run:
        _compare_files(spark, left, left_layout, right, right_layout, spec, path)
        _note_report(run, path, history)
    return path


def _compare_files(spark: SparkSession, left: str, left_layout: FileLayout, right: str, right_layout: FileLayout,
                   spec: CompareSpec, path: str) -> str:
    sides, meta = [], {**spec.meta, "LeftObjectName": left, "RightObjectName": right}
    for name, source, layout, side in (("Left", left, left_layout, spec.left),
                                       ("Right", right, right_layout, spec.right)):
        n_head, n_tail = layout.frame
        files = open_framed(spark, source, n_head, n_tail, layout.unit)
        sides.append(stage(_records(files, layout), "side"))
        if side.trailer_label:
            check = quality.trailer_count_check(files.frame(), side.trailer_label, n_head, n_tail).agg(
                F.min("matching").alias("matching")
            )
            meta[f"TrailerValidationSuccessFor{name}"] = check.first()["matching"]
    return _compare(*sides, replace(spec, meta=meta), path)
