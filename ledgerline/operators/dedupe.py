"""Duplicate groups and their clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.operators.numbering import number_rows


def duplicate_groups(df: DataFrame, keys: Sequence[str], row_id: str | Column, with_count: bool = False) -> DataFrame:
    """Groups with more than one row and their lowest ``row_id`` (as ``first_id``)."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(row_id).alias("first_id"))
    repeated = groups.filter(F.col("rows") > 1)
    return repeated if with_count else repeated.drop("rows")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group. Spark keeps one row per group and task before the
    shuffle (``WindowGroupLimit``), so a large group is not gathered."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") == 1).drop("_place")


def keep_last_renumber(df: DataFrame, name: str, row_id: str, new_id: str = "id") -> DataFrame:
    """One row per ``name``: the last one by ``row_id``, at the place of the first,
    numbered 1..n."""
    others = [c for c in df.columns if c != name]
    kept = df.groupBy(name).agg(
        F.min(row_id).alias("_first"), F.max_by(F.struct(*others), F.col(row_id)).alias("_last")
    )
    return number_rows(kept, ["_first"], new_id).select(new_id, name, "_last.*")
