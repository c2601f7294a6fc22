"""Row numbers over a whole ordered table without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.session import stage

_INDEX_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "row_no") -> DataFrame:
    """Add ``name`` = 1..n in the given order; the order should be unique.

    A range sort spreads the rows; each sorted partition is numbered from 0 where
    it lies and staged, because a second run of the sort may cut the ranges
    elsewhere. The partition sizes (one row per sort partition) give the offsets.
    """
    low = (1 << _INDEX_BITS) - 1
    tagged = df.orderBy(*order).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias("_at"),
    )
    staged = stage(tagged, "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    numbered = staged.join(F.broadcast(offsets), "_part")
    return numbered.select(*df.columns, (F.col("_offset") + F.col("_at") + 1).alias(name))


_REPEAT = 4096  # longest array made to repeat a row; two of them repeat it 16 million times


def repeated(df: DataFrame, times: Column, name: str = "copy") -> DataFrame:
    """Each row ``times`` times, with ``name`` from 0. Two short arrays are made in turn, never
    one as long as the number of copies; beyond 16 million of one row the first grows."""
    outer = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((times - 1) / F.lit(_REPEAT))))
    spread = df.withColumn("_times", times).where("_times > 0").withColumn("_outer", outer)
    last = F.least(F.lit(_REPEAT).cast("bigint"), F.col("_times") - F.col("_outer") * _REPEAT) - 1
    return spread.withColumn("_inner", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn(
        name, F.col("_outer") * _REPEAT + F.col("_inner")).drop("_times", "_outer", "_inner")


def spread_places(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """:func:`number_rows` for rows that have only the columns ``order`` and may repeat: equal
    rows are counted before they are sorted, so a row with very many copies is one row of the
    sort, and its copies are dealt out in pieces of ``_REPEAT``."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in order]
    counted = df.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    tagged = counted.orderBy(*columns).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    staged = stage(tagged, "counted")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged.groupBy("_part").agg(F.sum("_n").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = staged.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(parts), "_part")
    pieces = placed.select(
        *columns, "_n", (F.col("_offset") + F.col("_before")).alias("_first"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / F.lit(_REPEAT)))).alias("_piece"))
    dealt = pieces.repartition("_first", "_piece")
    last = F.least(F.lit(_REPEAT).cast("bigint"), F.col("_n") - F.col("_piece") * _REPEAT) - 1
    copies = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return copies.select(*columns, (F.col("_first") + F.col("_piece") * _REPEAT + F.col("_copy") + 1).alias(name))
