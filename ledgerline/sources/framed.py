"""Framed text files: header lines, data lines, trailer lines."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerline.operators.numbering import spread_places
from ledgerline.operators.skew import broadcast_if_small
from ledgerline.session import stage

HEADER, DATA, TRAILER = "header", "data", "trailer"

MOVED_BLOCKS = (
    "the files were cut into other blocks than when their lines were counted; "
    "set spark.sql.files.minPartitionNum when executors come and go"
)

# Most files that are opened by name to read nothing but frame lines.
NAMED_FILES = 1000


def plain_line(value: Column) -> Column:
    """A line without the carriage return of a Windows line end. Lines are split at
    newlines only, so a carriage return elsewhere stays inside its line."""
    return F.when(value.endswith("\r"), F.left(value, F.length(value) - 1)).otherwise(value)


def in_order() -> list[Column]:
    """Blocks of a unit in the order of their lines: by folder, the number in a part
    file's name (names alone stop sorting at part 100000), name and place."""
    number = F.regexp_extract("_file", r"/part-(\d+)[^/]*$", 1).try_cast("bigint")
    return [F.regexp_replace("_file", "/[^/]*$", ""), F.coalesce(number, F.lit(-1)), F.col("_file"), F.col("_block")]


def as_glob(name: str) -> str:
    """A path that matches just this file where paths are patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)


def raw_lines(spark: SparkSession, path: str | Sequence[str], unit: str) -> DataFrame:
    """Lines as they are, with their unit, file, block and an id in the order of the scan."""
    owner = F.col("_metadata.file_path")
    if unit == "folder":
        owner = F.regexp_replace(owner, "/[^/]*$", "")
    elif unit != "file":
        raise ValueError(f"unit must be 'file' or 'folder', not {unit!r}")
    return spark.read.text(path, lineSep="\n").select(
        "value",
        owner.alias("unit"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )


def _placed_lines(spark: SparkSession, path: str | Sequence[str], unit: str) -> DataFrame:
    return raw_lines(spark, path, unit).withColumn("value", plain_line(F.col("value")))


@dataclass(frozen=True)
class FramedFiles:
    """Files with a frame after one pass that counted the lines of each read block.

    ``source`` is the scan itself, so that later passes see the same files.
    ``blocks`` has a row per block with its offset in the unit. It is staged, so its
    real size decides whether it is broadcast.
    """

    spark: SparkSession
    path: str | list[str]
    n_head: int
    n_tail: int
    source: DataFrame
    blocks: DataFrame

    def lines(self) -> DataFrame:
        """All lines: ``unit, line_no, total_lines, section, ordinal, value``.

        Spark must cut the files into the same blocks as in the counting pass. If it
        does not, some line falls outside its block, and the job fails rather than
        number lines wrongly or lose them.
        """
        blocks = broadcast_if_small(self.blocks.drop("unit"))  # a file has one unit
        placed = self.source.join(blocks, ["_file", "_block"], "left")
        place = F.col("_id") - F.col("_first") + 1
        inside = F.coalesce(place.between(1, F.col("_lines")), F.lit(False))
        moved = F.raise_error(F.lit(MOVED_BLOCKS)).cast("bigint")
        return self._named(placed, F.when(inside, F.col("_offset") + place).otherwise(moved))

    def frame(self) -> DataFrame:
        """Header lines, trailer lines and the last line, in the form of :meth:`lines`.

        Where few of the files hold frame lines, as in a folder of part files, only
        those are opened.
        """
        tail = max(self.n_tail, 1)
        files = self.blocks.groupBy("unit", "_file", "total_lines").agg(
            F.min("_offset").alias("_file_offset"), F.sum("_lines").alias("_file_lines")
        )
        holds_frame = (F.col("_file_offset") < self.n_head) | (
            F.col("_file_offset") + F.col("_file_lines") > F.col("total_lines") - tail
        )
        size = files.agg(F.count(F.lit(1)).alias("all"), F.count_if(holds_frame).alias("some")).first()
        is_frame = (F.col("section") != DATA) | (F.col("line_no") == F.col("total_lines"))
        if size["some"] > NAMED_FILES or size["some"] * 4 > size["all"]:
            return self.lines().filter(is_frame)
        chosen = files.filter(holds_frame)
        names = [as_glob(unquote(row["_file"])) for row in chosen.select("_file").collect()]
        within = open_framed(self.spark, names).lines().select(
            F.col("unit").alias("_file"), F.col("line_no").alias("_line"), "value"
        )
        placed = within.join(F.broadcast(chosen), "_file")
        return self._named(placed, F.col("_file_offset") + F.col("_line")).filter(is_frame)

    def counts(self) -> DataFrame:
        """``unit, file_lines, header_lines, data_lines, trailer_lines``, from the
        blocks alone."""
        whole = self.blocks.groupBy("unit").agg(F.max("total_lines").alias("file_lines"))
        header = F.least(F.lit(self.n_head), "file_lines")
        trailer = F.least(F.lit(self.n_tail), F.col("file_lines") - F.col("header_lines"))
        return whole.withColumn("header_lines", header).withColumn("trailer_lines", trailer).withColumn(
            "data_lines", F.col("file_lines") - F.col("header_lines") - F.col("trailer_lines")
        )

    def _named(self, placed: DataFrame, line_no: Column) -> DataFrame:
        numbered = placed.select("unit", line_no.alias("line_no"), "total_lines", "value").filter(
            F.col("line_no") <= F.col("total_lines")
        )
        first_of_tail = F.col("total_lines") - self.n_tail
        section = (
            F.when(F.col("line_no") <= self.n_head, F.lit(HEADER))
            .when(F.col("line_no") > first_of_tail, F.lit(TRAILER)).otherwise(F.lit(DATA))
        )
        ordinal = (
            F.when(F.col("section") == HEADER, F.col("line_no"))
            .when(F.col("section") == TRAILER, F.col("line_no") - first_of_tail)
            .otherwise(F.col("line_no") - self.n_head)
        )
        return numbered.withColumn("section", section).withColumn("ordinal", ordinal).select(
            "unit", "line_no", "total_lines", "section", "ordinal", "value"
        )


def open_framed(spark: SparkSession, path: str | list[str], n_head: int = 0, n_tail: int = 0,
                unit: str = "file", drop_blank_last: bool = False) -> FramedFiles:
    """Count the lines of framed files, so that each line can be placed.

    ``unit`` says what carries one frame: each file, or each folder of part files
    taken in the order of their numbers (how Spark writes a large file). ``drop_blank_last`` leaves
    out an empty last line before the trailer is counted.

    No task sees a whole file: lines are counted by block, and a running sum over
    that small table gives every block its offset in the unit.
    """
    found = [F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines")]
    if drop_blank_last:
        found.append(F.max_by(F.col("value") == "", F.col("_id")).alias("_blank_last"))
    source = _placed_lines(spark, path, unit)
    per_block = source.groupBy("unit", "_file", "_block").agg(*found)
    whole = Window.partitionBy("unit")
    before = whole.orderBy(*in_order()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_lines").over(whole)
    if drop_blank_last:
        total = total - F.max_by("_blank_last", F.struct(*in_order())).over(whole).cast("int")
    blocks = per_block.select(
        "unit", "_file", "_block", "_first", "_lines",
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_offset"), total.alias("total_lines"),
    )
    return FramedFiles(spark, path, n_head, n_tail, source, stage(blocks, "blocks"))


def frame_lines(spark: SparkSession, path: str | list[str], n_head: int = 0, n_tail: int = 0,
                unit: str = "file", drop_blank_last: bool = False) -> DataFrame:
    """Lines with ``unit, line_no, total_lines, section, ordinal, value``: ``line_no``
    counts from 1 in the unit, ``ordinal`` from 1 in the section."""
    return open_framed(spark, path, n_head, n_tail, unit, drop_blank_last).lines()


def data_lines(framed: DataFrame, *keep: str) -> DataFrame:
    return framed.filter(F.col("section") == DATA).select(*keep, "value")


def sorted_data_lines(framed: DataFrame) -> DataFrame:
    """Data lines in binary text order with their place, as ``place, value``."""
    return spread_places(data_lines(framed), ["value"]).select("place", "value")
