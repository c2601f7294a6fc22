"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ledgerline.functions.lines import all_of
from ledgerline.session import stage

# Largest side that may be broadcast, by row count times declared row width.
BROADCAST_BYTES = 64 * 1024 * 1024

# Number of frequent keys looked for, and counters used to look for them.
HOT_KEYS = 64
HOT_COUNTERS = 8192

_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8,
    T.TimestampNTZType: 8, T.DecimalType: 16,
}


def row_width(df: DataFrame) -> int:
    """Rough bytes per row by declared types; text and nested columns count 64."""
    return sum(_WIDTHS.get(type(f.dataType), 64) for f in df.schema.fields) or 1


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether ``rows`` rows, those of ``df``, may be broadcast. Text and nested values are
    measured, but only where the declared widths leave few enough rows to read."""
    declared = rows * row_width(df)
    if declared > BROADCAST_BYTES:
        return False
    varying = [f for f in df.schema.fields if type(f.dataType) not in _WIDTHS]
    if not varying or not rows:
        return True
    values = [F.col(f"`{f.name}`") if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`").cast("string") for f in varying]
    sizes = [F.coalesce(F.octet_length(v).cast("bigint"), F.lit(0)) for v in values]
    held = df.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0
    return max(declared, held) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Count ``df`` (which should be cheap: staged or aggregated) and mark it for
    broadcast when it fits; otherwise leave the choice to Spark."""
    return F.broadcast(df) if fits_broadcast(df, df.count()) else df


def hot_hashes(df: DataFrame, on: Sequence[str]) -> list[int]:
    """Hashes of the join keys that are frequent in ``df``."""
    return list(hot_shares(df, on))


def hot_shares(df: DataFrame, on: Sequence[str]) -> dict[int, float]:
    """Hashes of the join keys that are frequent in ``df``, with their share of the rows.

    One pass with a small sketch per task, no shuffle of rows. The answer only
    steers how a join is split, so an inexact sketch cannot change a result.
    """
    items = F.expr(
        f"approx_top_k(xxhash64({', '.join(f'`{c}`' for c in on)}), {HOT_KEYS}, {HOT_COUNTERS})"
    )
    top = df.select(*on).agg(items.alias("top"), F.count(F.lit(1)).alias("rows")).first()
    floor = top["rows"] / (2 * HOT_KEYS)
    return {entry["item"]: entry["count"] / top["rows"] for entry in top["top"] or [] if entry["count"] > floor}


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


_DOUBLE_DIGITS = 15  # decimal numbers of so many digits are whole in a double


def meet_as_number_text(left: T.DataType, right: T.DataType) -> bool:
    """Whether one is a binary fraction and the other has numbers that no double holds."""
    def exact(kind):
        return isinstance(kind, T.LongType) or isinstance(kind, T.DecimalType) and kind.precision > _DOUBLE_DIGITS

    floats = [isinstance(k, (T.FloatType, T.DoubleType)) for k in (left, right)]
    return floats[0] and exact(right) or floats[1] and exact(left)


def number_text(value: Column, kind: T.DataType) -> Column:
    """A number as plain decimal text without trailing zeros, so that equal numbers of
    different types have equal text. A double counts as the shortest decimal that reads back
    as it; one that no decimal holds keeps its own text."""
    def trimmed(text: Column) -> Column:
        return F.regexp_replace(text, r"\.?0+$", "")

    if isinstance(kind, T.DecimalType):
        return trimmed(value.cast("string")) if kind.scale else value.cast("string")
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return value.cast("string")
    value = value.cast("double")
    fine, large = value.try_cast("decimal(38,18)"), value.try_cast("decimal(38,0)")
    return F.when(fine.try_cast("double") == value, trimmed(fine.cast("string"))) \
        .when(large.try_cast("double") == value, large.cast("string")).otherwise(value.cast("string"))


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type that holds the values of both: the wider number or time, else text."""
    if left == right:
        return left
    if meet_as_number_text(left, right):
        return T.StringType()
    kinds = (left, right)
    if all(isinstance(k, _WHOLE) for k in kinds):
        return max(kinds, key=lambda k: _WHOLE.index(type(k)))
    if all(isinstance(k, T.NumericType) for k in kinds):
        if any(isinstance(k, (T.FloatType, T.DoubleType)) for k in kinds):
            return T.DoubleType()
        return T.DecimalType(38, max(getattr(k, "scale", 0) for k in kinds))
    times = (T.TimestampType, T.TimestampNTZType)
    if all(isinstance(k, (T.DateType, *times)) for k in kinds):
        return next((k for k in kinds if isinstance(k, T.TimestampType)), T.TimestampNTZType())
    return T.StringType()


def _keyed(df: DataFrame, other: DataFrame, on: Sequence[str]) -> list[Column]:
    """The key columns of ``df`` in the types that it has in common with ``other``."""
    def met(c: str) -> Column:
        own, its = df.schema[c].dataType, other.schema[c].dataType
        if meet_as_number_text(own, its):
            return number_text(F.col(f"`{c}`"), own)
        return F.col(f"`{c}`").cast(common_type(own, its))

    return [met(c).alias(c) for c in on]


def _same_keys(keys: Sequence[Column], on: Sequence[str]) -> Column:
    """Join condition with ``_k_`` prefixed keys; NULL keys equal each other."""
    return all_of([key.eqNullSafe(F.col(f"_k_{c}")) for key, c in zip(keys, on)])


def key_presence_join(df: DataFrame, keys_df: DataFrame, on: Sequence[str], how: str,
                      small: bool | None = None, unique: bool = False, costly: bool = False) -> DataFrame:
    """``left_semi`` or ``left_anti`` of ``df`` against the keys of ``keys_df``; NULL
    keys equal each other, keys of different types meet in the wider one.

    ``keys_df`` is reduced to one row per key, combined before its shuffle. ``small``
    states that it was counted and fits a broadcast; ``df`` then stays in place.
    Otherwise rows of ``df`` with a frequent key stay where they are and meet a
    broadcast of at most ``HOT_KEYS`` keys; the others take the shuffle join.
    ``unique`` states that ``df`` has no frequent key. ``costly`` states that ``df`` is
    more than a scan of stored rows; :func:`salted_presence` then evaluates it once.
    """
    if costly and not small and not unique:
        return salted_presence(df, keys_df, on, how, costly)
    own = _keyed(df, keys_df, on)
    keys = keys_df.select(*[k.alias(f"_k_{c}") for k, c in zip(_keyed(keys_df, df, on), on)]).distinct()
    if small:
        return df.join(F.broadcast(keys), _same_keys(own, on), how)
    hot = [] if unique else hot_hashes(df.select(*own), on)
    if not hot:
        return df.join(keys, _same_keys(own, on), how)
    is_hot, key_is_hot = F.xxhash64(*own).isin(hot), F.xxhash64(*keys.columns).isin(hot)
    cold_part = df.filter(~is_hot).join(keys.filter(~key_is_hot), _same_keys(own, on), how)
    hot_part = df.filter(is_hot).join(F.broadcast(keys.filter(key_is_hot)), _same_keys(own, on), how)
    return cold_part.unionByName(hot_part)


def lookup_join(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
                costly: bool = False) -> DataFrame:
    """Join many rows to a lookup that holds one row per key: by a broadcast when the
    lookup is counted and fits, else by :func:`split_join`. ``costly`` states that the
    sides are more than scans of stored rows: each is then evaluated once, the lookup
    into a stage where it is counted, and frequent keys are salted."""
    if costly:
        lookup = stage(lookup, "lookup")
    if fits_broadcast(lookup, lookup.count()):
        return _matched(df, lookup, on, how, F.broadcast)
    return salted_join(df, lookup, on, how, costly) if costly else split_join(df, lookup, on, how)


def split_join(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many rows to a large lookup that holds one row per key.

    Rows of ``df`` with a frequent key stay in place and meet a broadcast of their
    lookup rows, at most one for each frequent key, so its size does not grow with
    the data; the other rows take the shuffle join. ``how`` is ``inner`` or ``left``.
    """
    own, other = _keyed(df, lookup, on), _keyed(lookup, df, on)
    hot = hot_hashes(df.select(*own), on)
    if not hot:
        return _matched(df, lookup, on, how)
    is_hot, found = F.xxhash64(*own).isin(hot), F.xxhash64(*other).isin(hot)
    cold_part = _matched(df.filter(~is_hot), lookup.filter(~found), on, how)
    hot_part = _matched(df.filter(is_hot), lookup.filter(found), on, how, F.broadcast)
    return cold_part.unionByName(hot_part)


def _pieces(hashed: Column, shares: dict[int, float], partitions: int) -> Column:
    """Into how many salts a key goes: its share of twice the shuffle's partitions, so
    that a piece is about half of an even partition; 1 for a key that is not frequent."""
    counts = {h: max(math.ceil(share * 2 * partitions), 1) for h, share in shares.items()}
    known = F.create_map(*[F.lit(x).cast("bigint") for entry in counts.items() for x in entry])
    return F.coalesce(F.try_element_at(known, hashed), F.lit(1).cast("bigint"))


def shuffle_partitions(df: DataFrame) -> int:
    """Partitions that a shuffle starts with."""
    conf = df.sparkSession.conf
    first = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(first or 0), int(conf.get("spark.sql.shuffle.partitions")))


def _salted(df: DataFrame, own: Sequence[Column], lookup: DataFrame, other: Sequence[Column],
            shares: dict[int, float]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_join_salt``. A row of ``df`` takes its salt from the number
    of its input partition, so a task that runs again salts alike, whatever the order of
    its rows; a row of ``lookup`` is copied for each salt of its key. All copies together
    are at most twice the shuffle's partitions, besides one for each key."""
    partitions = shuffle_partitions(df)
    salt = F.pmod(F.spark_partition_id().cast("bigint"), _pieces(F.xxhash64(*own), shares, partitions))
    last = _pieces(F.xxhash64(*other), shares, partitions) - 1
    return (df.withColumn("_join_salt", salt),
            lookup.withColumn("_join_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last))))


def salted_join(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
                costly: bool = False) -> DataFrame:
    """Join many rows to a large lookup that holds one row per key, in one plan.

    Rows of a frequent key, NULL included, are dealt to as many salts as its share of the
    rows asks for, and only the lookup rows of these keys are copied, once per salt. Each
    side is read once by the join; the sketch before it reads the key columns of ``df``.
    ``costly`` states that ``df`` is more than a scan of stored rows: it is then staged,
    so that it is evaluated once, and the sketch reads the staged columns. ``how`` is
    ``inner`` or ``left``.
    """
    df = stage(df, "side") if costly else df
    own, other = _keyed(df, lookup, on), _keyed(lookup, df, on)
    shares = hot_shares(df.select(*own), on)
    if not shares:
        return _matched(df, lookup, on, how)
    left, right = _salted(df, own, lookup, other, shares)
    return _matched(left, right, [*on, "_join_salt"], how).drop("_join_salt")


def salted_presence(df: DataFrame, keys_df: DataFrame, on: Sequence[str], how: str,
                    costly: bool = False) -> DataFrame:
    """``left_semi`` or ``left_anti`` as :func:`key_presence_join`, in one plan and with
    frequent keys salted as in :func:`salted_join`; NULL keys equal each other."""
    df = stage(df, "side") if costly else df
    own = _keyed(df, keys_df, on)
    keys = keys_df.select(*[k.alias(f"_k_{c}") for k, c in zip(_keyed(keys_df, df, on), on)]).distinct()
    shares = hot_shares(df.select(*own), on)
    if not shares:
        return df.join(keys, _same_keys(own, on), how)
    left, right = _salted(df, own, keys, [F.col(c) for c in keys.columns], shares)
    same = _same_keys(own, on) & (F.col("_join_salt") == F.col("_k__join_salt"))
    return left.join(right.withColumnRenamed("_join_salt", "_k__join_salt"), same, how).drop("_join_salt")


def _matched(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str, hint=lambda side: side) -> DataFrame:
    """The keys as ``df`` has them, its other columns, those of the lookup. Keys of
    different types meet in the wider one."""
    rest = [c for c in lookup.columns if c not in on]
    side = lookup.select(*[k.alias(f"_k_{c}") for k, c in zip(_keyed(lookup, df, on), on)], *[F.col(f"`{c}`") for c in rest])
    same = all_of([key == F.col(f"_k_{c}") for key, c in zip(_keyed(df, lookup, on), on)])
    own = [*on, *[c for c in df.columns if c not in on]]
    joined = df.join(hint(side), same, how)
    return joined.select(*[df[c] for c in own], *[side[c] for c in rest])
