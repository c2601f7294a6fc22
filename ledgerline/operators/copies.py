"""Comparison of tables whose keys repeat, copy by copy.

The rows of a key are a multiset on each side. Copies that are equal on both sides match
first, however many there are. The copies left over are put in the order of their values and
paired one to one: the first of the left side with the first of the right side, and so on. A
pair is a changed row; copies without a partner are extra. Every copy of a side is in just
one pair or extra, so totals, matches, changes and extras add up.

Matching is one hash aggregate: rows count up for the left side and down for the right one,
grouped by key and values, so a key that holds a third of the rows is spread over its values
and combined before the shuffle. Only what is left over, usually little, is staged, numbered
by a range sort and paired by key and number, which is unique on each side. No task holds a
key, and no rows of a key are multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.operators.compare import (
    CHANGED, LEFT_ONLY, RIGHT_ONLY, SAME, WIDE_ROW, common_columns, key_status, same_types, summarise_differences,
)
from ledgerline.operators.numbering import number_rows, repeated
from ledgerline.operators.skew import fits_broadcast, key_presence_join, lookup_join, row_width
from ledgerline.session import stage


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def left_over(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``_key, _row, _n``: structs of keys and values that are not as often on both sides, with
    the number of copies more on the left (or, below zero, on the right)."""
    values = [c for c in columns if c not in keys]

    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(F.struct(*_quoted(keys)).alias("_key"), *_quoted(values), F.lit(sign).cast("bigint").alias("_sign"))

    row = F.struct(*_quoted(values)) if values else F.struct(F.lit(True).alias("_"))
    folded = side(left, 1).unionByName(side(right, -1)).groupBy("_key", *_quoted(values)).agg(F.sum("_sign").alias("_n"))
    return folded.where("_n <> 0").select("_key", row.alias("_row"), "_n")


def _ranked(rest: DataFrame) -> DataFrame:
    """Each copy by itself, numbered from 1 within its key and side, in the order of values."""
    copies = repeated(rest.withColumn("_left", F.col("_n") > 0), F.abs("_n"), "_copy").drop("_n")
    numbered = stage(number_rows(copies, ["_key", "_left", "_row", "_copy"], "_no"), "copies")
    firsts = stage(numbered.groupBy("_key", "_left").agg(F.min("_no").alias("_first")), "first-copies")
    on = F.struct("_key", "_left").alias("_group")
    ranked = lookup_join(numbered.select(on, "_row", "_no"), firsts.select(on, "_first"), ["_group"])
    return ranked.select(
        F.col("_group._key").alias("_key"), F.col("_group._left").alias("_left"), "_row",
        (F.col("_no") - F.col("_first") + 1).alias("_rank"))


def _paired(rest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed pairs and extra copies in the columns of ``align``."""
    ranked = _ranked(rest)
    left = ranked.where("_left").select(F.struct("_key", "_rank").alias("_at"), F.col("_row").alias("l"))
    right = ranked.where("NOT _left").select(F.struct("_key", "_rank").alias("_at"), F.col("_row").alias("r"))
    both = left.join(right, "_at", "full")
    there = [F.col(side).isNotNull().cast("bigint").alias(f"{name}_rows") for side, name in (("l", "left"), ("r", "right"))]
    status = F.when(F.col("r").isNull(), LEFT_ONLY).when(F.col("l").isNull(), RIGHT_ONLY).otherwise(CHANGED)
    return both.select(*[F.col("_at._key").getField(k).alias(k) for k in keys], "l", "r", *there, status.alias("status"))


def _sides(left: DataFrame, right: DataFrame, keys: Sequence[str],
           columns: Sequence[str] | None) -> tuple[DataFrame, DataFrame, list[str]]:
    columns = columns or common_columns(left, right)
    columns = [*keys, *[c for c in columns if c not in keys]]
    return (*same_types(left, right, columns), columns)


def differing_copies(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
                     wide: bool | None = None) -> DataFrame:
    """The copies that differ, in the columns of :func:`~ledgerline.operators.compare.align`:
    one row per changed pair and per extra copy; staged.

    Rows that are equal on both sides are not in it. Of wide rows (``wide``, else by declared
    width) only those of keys whose hashes differ are shuffled."""
    left, right, columns = _sides(left, right, keys, columns)
    if row_width(left) > WIDE_ROW if wide is None else wide:
        found = stage(key_status(left, right, keys, columns).where(F.col("status") != SAME).select(*_quoted(keys)), "keys")
        small = fits_broadcast(found, found.count())
        left, right = (key_presence_join(side, found, keys, "left_semi", small) for side in (left, right))
    return stage(_paired(stage(left_over(left, right, keys, columns), "left-over"), keys), "differing-copies")


def align_copies(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """All copies of both sides, in the columns of ``align``: matched pairs (status ``same``,
    a row for each pair), changed pairs and extra copies."""
    left, right, columns = _sides(left, right, keys, columns)
    values = [c for c in columns if c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        ones = [F.lit(int(name == s)).cast("bigint").alias(f"_{s}") for s in ("left", "right")]
        return df.select(F.struct(*_quoted(keys)).alias("_key"), *_quoted(values), *ones)

    counted = side(left, "left").unionByName(side(right, "right")).groupBy("_key", *_quoted(values)).agg(
        F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))
    row = F.struct(*_quoted(values)) if values else F.struct(F.lit(True).alias("_"))
    folded = stage(counted.select("_key", row.alias("_row"), "_left", "_right"), "counted-rows")
    one = F.lit(1).cast("bigint")
    same = repeated(folded, F.least("_left", "_right")).select(
        *[F.col("_key").getField(k).alias(k) for k in keys], F.col("_row").alias("l"), F.col("_row").alias("r"),
        one.alias("left_rows"), one.alias("right_rows"), F.lit(SAME).alias("status"))
    rest = folded.select("_key", "_row", (F.col("_left") - F.col("_right")).alias("_n")).where("_n <> 0")
    return same.unionByName(_paired(rest, keys))


def differing_rows(left: DataFrame, right: DataFrame, noted: DataFrame, keys: Sequence[str],
                   columns: Sequence[str] | None = None) -> DataFrame:
    """The rows that differ, from ``noted``, the result of ``align_differing``: keys of one
    row a side as they are there, keys that repeat copy by copy. Only the rows of repeated
    keys that differ are read again."""
    kept = [*keys, "l", "r", "left_rows", "right_rows", "status"]
    differing = noted.where(F.col("status") != SAME).select(*_quoted(kept))
    many = (F.col("left_rows") > 1) | (F.col("right_rows") > 1)
    found = differing.where(many).select(*_quoted(keys))
    count = found.count()
    if not count:
        return differing
    left, right, columns = _sides(left, right, keys, columns)
    small = fits_broadcast(found, count)
    rows = [key_presence_join(side, found, keys, "left_semi", small) for side in (left, right)]
    copies = differing_copies(*rows, keys, columns, wide=False)
    return differing.where(~many).unionByName(copies.select(*_quoted(kept)))


def summarise_copies(left: DataFrame, right: DataFrame, keys: Sequence[str],
                     columns: Sequence[str] | None = None) -> DataFrame:
    """The summary of all columns, each copy counted."""
    left, right, columns = _sides(left, right, keys, columns)
    return summarise_differences(differing_copies(left, right, keys, columns), left, right, keys, columns)
