"""Stored digests of a table by key range, so that a later comparison reads little.

A snapshot has two parts. The levels hold, for each range of keys, the number of rows and
sums of hashes of its rows; a range of one level is ``2 ** FANOUT_BITS`` ranges of the level below, and
as the digests are sums, all levels come from one aggregate. The rows hold the sketch (key
text and row hash) of every row, sorted by range in folders of neighbouring ranges.

Comparing two snapshots starts at the lowest level that is still small and goes down, level
by level, into the ranges whose digests differ. Only the sketches in differing ranges of the
last level are read, by folder and by sorted row groups. When little has changed, the cost
follows the change and not the table.

A single whole-number key is cut into ranges of ``2 ** LEAF_BITS`` keys, so neighbours share a
range and folders follow the key. Other keys are cut by the range of their hash; the number of
ranges then comes from the first snapshot, and later ones are made ``like`` it. Rows that
repeat a key share its range, however many they are. NULL keys have a range of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerline.functions.rowtext import sketch
from ledgerline.operators.compare import outer_diff, pair_sketches
from ledgerline.operators.skew import broadcast_if_small
from ledgerline.session import stage

LEAF_BITS = 12
FANOUT_BITS = 4
LEVELS = (64 - LEAF_BITS) // FANOUT_BITS + 1
#: Largest number of ranges of a level that a comparison reads whole.
FIRST_LEVEL = 10_000
#: Largest number of folders that the rows of a snapshot are written to.
FOLDERS = 256

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SUMS = ["rows", "d0", "d1", "d2", "d3"]


def _by_value(df: DataFrame, keys: Sequence[str]) -> bool:
    return len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, _WHOLE)


def _leaf(df: DataFrame, keys: Sequence[str], leaf_bits: int) -> Column:
    """The number of a row's range. NULL keys take the least number, which no other has."""
    if _by_value(df, keys):
        key = F.col(f"`{keys[0]}`").cast("bigint")
        return F.coalesce(F.shiftright(key, leaf_bits), F.lit(-(1 << 63)).cast("bigint"))
    return F.shiftright(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), leaf_bits)


def _digests() -> list[Column]:
    """Sums over pieces of 24 bits, which stay in a bigint for 10^11 rows."""
    pieces = [f"shiftright(xxhash64({salt}, concatenated_keys, hash_value), {shift}) & 16777215L" for salt in (1, 2) for shift in (0, 24)]
    return [F.count(F.lit(1)).alias("rows"), *[F.sum(F.expr(p)).alias(f"d{i}") for i, p in enumerate(pieces)]]


def _meta(spark: SparkSession, path: str) -> dict:
    return spark.read.parquet(f"{path}/meta").first().asDict()


def write_snapshot(df: DataFrame, keys: Sequence[str], path: str, columns: Sequence[str] | None = None,
                   like: str | None = None, form: str = "safe") -> str:
    """Store the digests and sketches of ``df`` under ``path``. ``like`` names a snapshot that
    this one is to be compared with, of a table with the same keys and columns."""
    spark, columns = df.sparkSession, list(columns or df.columns)
    if like:
        leaf_bits = _meta(spark, like)["leaf_bits"]
    elif _by_value(df, keys):
        leaf_bits = LEAF_BITS
    else:
        leaves = max(df.count() >> LEAF_BITS, 1)
        leaf_bits = max(64 - leaves.bit_length(), LEAF_BITS)
    leaf = _leaf(df, keys, leaf_bits)
    marked = df.withColumn("_leaf", leaf)
    rows = sketch(marked, keys, columns, form, keep=["_leaf"]).withColumnRenamed("_leaf", "leaf")
    leaves = stage(rows.groupBy("leaf").agg(*_digests()), "leaves")
    nodes = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))) \
        .withColumn("node", F.expr(f"shiftright(leaf, level * {FANOUT_BITS})")) \
        .groupBy("level", "node").agg(*[F.sum(c).alias(c) for c in _SUMS])
    nodes = stage(nodes, "levels")
    nodes.repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.partitionBy("level").parquet(f"{path}/levels")
    sizes = nodes.groupBy("level").count()
    folder_level = sizes.where(F.col("count") <= FOLDERS).agg(F.min("level")).first()[0] or 0
    rows.withColumn("folder", F.expr(f"shiftright(leaf, {folder_level * FANOUT_BITS})")) \
        .repartitionByRange("leaf", "concatenated_keys").sortWithinPartitions("folder", "leaf") \
        .write.partitionBy("folder").parquet(f"{path}/rows")
    meta = [(leaf_bits, folder_level, _by_value(df, keys), form, ",".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys),
             ",".join(columns))]
    spark.createDataFrame(meta, "leaf_bits int, folder_level int, by_value boolean, form string, keys string, columns string") \
        .coalesce(1).write.parquet(f"{path}/meta")
    return path


def _levels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node long, rows long, d0 long, d1 long, d2 long, d3 long, level int").parquet(f"{path}/levels")


def _unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ranges whose digests differ, or that one side does not have."""
    both = left.select("node", *_SUMS).unionByName(right.select("node", *[(-F.col(c)).alias(c) for c in _SUMS]))
    folded = both.groupBy("node").agg(F.count(F.lit(1)).alias("sides"), *[F.sum(c).alias(c) for c in _SUMS])
    differ = reduce(lambda a, b: a | b, [F.col("sides") != 2, *[F.col(c) != 0 for c in _SUMS]])
    return folded.where(differ).select("node")


def differing_ranges(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Ranges (``node``) of the last level in which two snapshots differ."""
    metas = [_meta(spark, path) for path in (left, right)]
    alike = {(m["leaf_bits"], m["form"], "" if m["by_value"] else m["keys"], m["columns"]) for m in metas}
    if len(alike) > 1:
        raise ValueError(f"the snapshots are not alike: {metas}")
    sides = [_levels(spark, path) for path in (left, right)]
    sizes = sides[0].unionByName(sides[1]).groupBy("level").count().collect()  # one row a level
    small = [r["level"] for r in sizes if r["count"] <= FIRST_LEVEL]
    start = min(small, default=LEVELS - 1)
    found = None
    for level in range(start, -1, -1):
        now = [side.where(F.col("level") == level) for side in sides]
        if found is not None:
            above = broadcast_if_small(found.withColumnRenamed("node", "above"))
            now = [side.join(above, F.shiftright("node", FANOUT_BITS) == F.col("above"), "left_semi") for side in now]
        found = stage(_unequal(*now), "ranges")
    return found if found is not None else spark.createDataFrame([], "node long")


def rows_in_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """The sketches of a snapshot in some ranges; only the folders that hold them are read."""
    level = _meta(spark, path)["folder_level"]
    folders = ranges.select(F.shiftright("node", level * FANOUT_BITS).alias("folder")).distinct()
    # A snapshot has few folders, so this list is short whatever the number of ranges.
    stored = spark.read.schema("concatenated_keys string, hash_value string, leaf long, folder long").parquet(f"{path}/rows")
    known = _levels(spark, path).where(F.col("level") == level).select(F.col("node").alias("folder"))
    names = [r["folder"] for r in folders.join(known, "folder", "left_semi").collect()]
    chosen = stored.where(F.col("folder").isin(names))
    return chosen.join(broadcast_if_small(ranges), F.col("leaf") == F.col("node"), "left_semi") \
        .select("concatenated_keys", "hash_value")


def compare_by_digest_tree(spark: SparkSession, left: str, right: str) -> DataFrame:
    """``concatenated_keys, left_hash, right_hash`` of keys that differ between two snapshots or
    are in one only, as :func:`~ledgerline.operators.compare.outer_diff` has them."""
    ranges = differing_ranges(spark, left, right)
    return outer_diff(pair_sketches(*[rows_in_ranges(spark, path, ranges) for path in (left, right)]))
