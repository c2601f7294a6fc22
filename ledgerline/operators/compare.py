"""Comparison of two tables by key.

Every operator rests on one of three folds. Each puts the rows of the two sides
in one grouped aggregate instead of a join: one shuffle, rows combined before it,
NULL keys equal to each other, and no pairs where a key repeats.

``presence`` counts equal values. ``key_status`` shuffles a key with a few numbers
made from hashes of its rows and says what happened to the key. ``align`` carries
the rows themselves. A key is meant to name one row; where it does not, ``align``
keeps the smallest row and the number of rows, and a difference in any copy shows
in the status; ``ledgerline.operators.copies`` compares such rows copy by copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerline.functions.lines import all_of, any_of
from ledgerline.functions.rowtext import cell_text, key_text, value_text
from ledgerline.operators.quality import side_by_side
from ledgerline.operators.numbering import repeated
from ledgerline.operators.skew import (
    common_type, fits_broadcast, key_presence_join, meet_as_number_text, number_text, row_width,
)
from ledgerline.session import stage

# Fixed value: what a report shows for the cell of a side that has no such row.
ABSENT = "Does_Not_Exists"
LEFT_ONLY, RIGHT_ONLY, CHANGED, SAME = "left_only", "right_only", "changed", "same"

WIDE_ROW = 400  # declared bytes; several times what key_status shuffles for a row

_PIECE_BITS = 24  # a sum of such numbers over 10^11 rows stays in a bigint


# --- columns ---------------------------------------------------------------

def common_columns(left: DataFrame, right: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns of both sides in the order of the left one, without ``exclude``."""
    return [c for c in left.columns if c in right.columns and c not in exclude]


def chosen_keys(chosen: Sequence[str], left_keys: Sequence[str] = (), right_keys: Sequence[str] = ()) -> list[str]:
    return list(dict.fromkeys([*chosen, *left_keys, *right_keys]))


def side_suffix(df: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + suffix) for c in columns])


def same_types(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with equal types: numbers and times that differ in type compare in the
    wider one, whole numbers and fractions that a double would round as number text,
    anything else as text."""
    def cell(df: DataFrame, other: DataFrame, c: str) -> Column:
        own, its = df.schema[c].dataType, other.schema[c].dataType
        if own == its:
            return F.col(f"`{c}`")
        if meet_as_number_text(own, its):
            return number_text(F.col(f"`{c}`"), own).alias(c)
        kind = common_type(own, its)
        if own == kind:
            return F.col(f"`{c}`")
        return (cell_text(df, c) if isinstance(kind, T.StringType) else F.col(f"`{c}`").cast(kind)).alias(c)

    return left.select(*[cell(left, right, c) for c in columns]), right.select(*[cell(right, left, c) for c in columns])


# --- the folds -------------------------------------------------------------

def presence(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of ``columns`` with ``left_rows`` and ``right_rows``."""
    left, right = same_types(left, right, columns)
    both = left.select("*", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select("*", F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return both.groupBy(*columns).agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _hash_pieces(columns: Sequence[str]) -> list[Column]:
    """Four numbers of 24 bits from two hashes of a row. NULL flags are hashed too,
    because a hash passes over NULL values."""
    parts = ", ".join(f"{_quoted(c)} IS NULL, {_quoted(c)}" for c in columns)
    mask = (1 << _PIECE_BITS) - 1
    return [
        F.expr(f"shiftright(xxhash64({salt}, {parts}), {shift}) & {mask}L")
        for salt in (1, 2) for shift in (0, _PIECE_BITS)
    ]


def _status(equal: Column) -> Column:
    return (
        F.when(F.col("right_rows") == 0, F.lit(LEFT_ONLY))
        .when(F.col("left_rows") == 0, F.lit(RIGHT_ONLY))
        .when(equal, F.lit(SAME)).otherwise(F.lit(CHANGED))
    )


def key_status(left: DataFrame, right: DataFrame, keys: Sequence[str],
               columns: Sequence[str] | None = None) -> DataFrame:
    """Keys with ``left_rows``, ``right_rows`` and ``status``, without the rows.

    Row hashes count up for the left side and down for the right one; a key whose
    numbers all end at zero has the same rows on both sides, however many there
    are. The buffers have a fixed size, so Spark aggregates by hash without a sort.
    """
    keys = list(keys)
    columns = columns or common_columns(left, right)
    values = [c for c in columns if c not in keys]
    left, right = same_types(left, right, [*keys, *values])

    def side(df: DataFrame, sign: int) -> DataFrame:
        pieces = [(p * sign).alias(f"_p{i}") for i, p in enumerate(_hash_pieces(values or keys))]
        return df.select(*[F.col(f"`{k}`") for k in keys], F.lit(sign).alias("_sign"), *pieces)

    sums = [F.sum(f"_p{i}").alias(f"_p{i}") for i in range(4)]
    folded = side(left, 1).unionByName(side(right, -1)).groupBy(*keys).agg(
        F.count_if(F.col("_sign") == 1).alias("left_rows"), F.count_if(F.col("_sign") == -1).alias("right_rows"), *sums
    )
    equal = all_of([F.col("left_rows") == F.col("right_rows"), *[F.col(f"_p{i}") == 0 for i in range(4)]])
    return folded.select(*keys, "left_rows", "right_rows", _status(equal).alias("status"))


def align(left: DataFrame, right: DataFrame, keys: Sequence[str],
          columns: Sequence[str] | None = None, unique_keys: bool = False) -> DataFrame:
    """One row per key: the keys, ``l`` and ``r`` (structs of the other columns),
    ``left_rows``, ``right_rows`` and ``status``.

    ``unique_keys`` states that a check has shown the keys to be unique and not
    NULL on both sides; a full outer join then does the same in less time.
    """
    keys = list(keys)
    columns = columns or common_columns(left, right)
    values = [c for c in columns if c not in keys]
    left, right = same_types(left, right, [*keys, *values])
    row = F.struct(*values) if values else F.struct(F.lit(True).alias("_"))
    if unique_keys:
        return _joined(left.select(*keys, row.alias("l")), right.select(*keys, row.alias("r")), keys)

    def side(df: DataFrame, sign: int) -> DataFrame:
        mine, other = ("l", "r") if sign == 1 else ("r", "l")
        pieces = [(p * sign).alias(f"_p{i}") for i, p in enumerate(_hash_pieces(values or keys)[:2])]
        tagged = df.select(*keys, row.alias(mine), F.lit(sign).alias("_sign"), *pieces)
        return tagged.withColumn(other, F.lit(None).cast(tagged.schema[mine].dataType))

    sums = [F.sum(f"_p{i}").alias(f"_p{i}") for i in range(2)]
    folded = side(left, 1).unionByName(side(right, -1)).groupBy(*keys).agg(
        F.min("l").alias("l"), F.min("r").alias("r"),
        F.count_if(F.col("_sign") == 1).alias("left_rows"), F.count_if(F.col("_sign") == -1).alias("right_rows"), *sums
    )
    equal = all_of([
        F.col("l").eqNullSafe(F.col("r")), F.col("left_rows") == F.col("right_rows"),
        *[F.col(f"_p{i}") == 0 for i in range(2)],
    ])
    return folded.withColumn("status", _status(equal)).drop("_p0", "_p1")


def align_differing(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
                    unique_keys: bool = False, wide: bool | None = None) -> DataFrame:
    """:func:`align` for the keys that are not the same on both sides or that repeat;
    the result is staged.

    Narrow rows are aligned and filtered. Wide rows (``wide``, else by their declared
    width) are not shuffled: the status of every key comes first, then the rows of
    the keys found, by a broadcast of those keys when their counted size allows it.
    That takes two scans of each side, but the rows that are equal, nearly all as a
    rule, stay in place.
    """
    keys = list(keys)
    columns = columns or common_columns(left, right)
    columns = [*keys, *[c for c in columns if c not in keys]]
    left, right = same_types(left, right, columns)
    noteworthy = (F.col("status") != SAME) | (F.col("left_rows") > 1) | (F.col("right_rows") > 1)
    if wide is None:
        wide = row_width(left) > WIDE_ROW
    if not wide:
        return stage(align(left, right, keys, columns, unique_keys).filter(noteworthy), "differing")
    found = stage(key_status(left, right, keys, columns).filter(noteworthy).select(*keys), "keys")
    small = fits_broadcast(found, found.count())
    rows = [key_presence_join(side, found, keys, "left_semi", small) for side in (left, right)]
    return stage(align(*rows, keys, columns, unique_keys), "differing")


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    there = [F.col(side).isNotNull().cast("bigint").alias(f"{name}_rows") for side, name in (("l", "left"), ("r", "right"))]
    joined = left.join(right, list(keys), "full").select(*keys, "l", "r", *there)
    return joined.withColumn("status", _status(F.col("l").eqNullSafe(F.col("r"))))


# --- keys on one or both sides ---------------------------------------------

def union_distinct_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return presence(left, right, keys).select(*keys)


def except_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have."""
    return presence(left, right, keys).filter(F.col("right_rows") == 0).select(*keys)


def intersect_rows(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of ``columns`` on both sides."""
    found = presence(left, right, columns)
    return found.filter((F.col("left_rows") > 0) & (F.col("right_rows") > 0)).select(*columns)


def extra_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], costly: bool = False) -> DataFrame:
    """All rows of ``left`` whose key ``right`` does not have. ``costly`` states that
    ``left`` is more than a scan of stored rows; it is then evaluated once."""
    return key_presence_join(left, right.select(*keys), keys, "left_anti", costly=costly)


def fetch_by_keys(df: DataFrame, key_list: DataFrame, keys: Sequence[str], limit: int | None = None,
                  costly: bool = False) -> DataFrame:
    """Rows of ``df`` whose key is in ``key_list``, in key order; ``costly`` as in
    :func:`extra_rows`."""
    found = key_presence_join(df, key_list, keys, "left_semi", costly=costly)
    ordered = found.orderBy(*keys)
    return ordered.limit(limit) if limit else ordered


# --- sketches --------------------------------------------------------------

def pair_sketches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two sketches by key: ``concatenated_keys, left_hash, right_hash, left_rows,
    right_rows, status``."""
    pairs = align(left, right, ["concatenated_keys"], ["concatenated_keys", "hash_value"])
    return pairs.select(
        "concatenated_keys", F.col("l.hash_value").alias("left_hash"), F.col("r.hash_value").alias("right_hash"),
        "left_rows", "right_rows", "status",
    )


def mismatch_rows(pairs: DataFrame) -> DataFrame:
    """Keys of both sides whose rows differ."""
    return pairs.filter(F.col("status") == CHANGED).select("concatenated_keys", "left_hash", "right_hash")


def matching_rows(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("status") == SAME).select("concatenated_keys", F.col("left_hash").alias("hash_value"))


def matching_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that two sketches share, a row for each pair of copies."""
    both = presence(left, right, ["concatenated_keys", "hash_value"])
    # As in an SQL join, a NULL equals nothing.
    shared = both.filter("left_rows > 0 AND right_rows > 0 AND concatenated_keys IS NOT NULL AND hash_value IS NOT NULL")
    return repeated(repeated(shared, F.col("left_rows")), F.col("right_rows")).select("concatenated_keys", "hash_value")


def outer_diff(pairs: DataFrame) -> DataFrame:
    """Keys that differ or are on one side only."""
    return pairs.filter(F.col("status") != SAME).select("concatenated_keys", "left_hash", "right_hash")


def row_counts(pairs: DataFrame) -> DataFrame:
    """Rows and keys per side and per outcome, from one pass."""
    def rows(column: str, *statuses: str) -> Column:
        chosen = F.col("status").isin(*statuses) if statuses else F.lit(True)
        return F.coalesce(F.sum(F.when(chosen, F.col(column)).otherwise(0)), F.lit(0))

    return pairs.agg(
        rows("left_rows").alias("left_rows"), rows("right_rows").alias("right_rows"),
        rows("left_rows", LEFT_ONLY).alias("extra_in_left"), rows("right_rows", RIGHT_ONLY).alias("extra_in_right"),
        F.count_if(F.col("status") == CHANGED).alias("mismatched_keys"),
        F.count_if(F.col("status") == SAME).alias("common_keys"),
    )


# --- cells -----------------------------------------------------------------

def _differs(column: str) -> Column:
    return F.expr(f"NOT (l.{_quoted(column)} <=> r.{_quoted(column)})")


def _values(aligned: DataFrame) -> list[str]:
    return [f.name for f in aligned.schema["l"].dataType.fields]


def _side_texts(aligned: DataFrame, side: str, keys: Sequence[str] = ()) -> dict[str, Column]:
    """Text of each key and of each value of one side."""
    fields = aligned.schema[side].dataType.fields
    return {k: cell_text(aligned, k) for k in keys} | {
        f.name: value_text(F.col(side).getField(f.name), f.dataType) for f in fields
    }


def _cell(name: str, left: Column, right: Column) -> Column:
    return F.struct(F.lit(name).alias("column_name"), left.alias("left_value"), right.alias("right_value"))


def _long(rows: DataFrame, keys: Sequence[str], cells: Sequence[Column]) -> DataFrame:
    """One line per cell; a NULL cell gives none."""
    return rows.select(
        key_text(rows, keys).alias("concatenated_keys"), F.explode(F.array_compact(F.array(*cells))).alias("cell")
    ).select("cell.column_name", "concatenated_keys", "cell.left_value", "cell.right_value")


def _differences(aligned: DataFrame, keys: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    values, absent, status = _values(aligned), F.lit(ABSENT), F.col("status")
    left, right = _side_texts(aligned, "l", keys), _side_texts(aligned, "r", keys)
    names = values if list(statuses) == [CHANGED] else [*keys, *values]
    cells = []
    for name in names:
        cell = F.when(status == LEFT_ONLY, _cell(name, left[name], absent)).when(
            status == RIGHT_ONLY, _cell(name, absent, right[name])
        )
        if name in values:
            cell = cell.when((status == CHANGED) & _differs(name), _cell(name, left[name], right[name]))
        cells.append(cell)
    return _long(aligned.filter(status.isin(*statuses)), keys, cells)


def cell_diff(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Differing cells of changed rows: ``column_name, concatenated_keys,
    left_value, right_value``."""
    return _differences(aligned, keys, [CHANGED])


def absent_cells(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All cells of one-sided rows, the other side shown as ``Does_Not_Exists``."""
    return _differences(aligned, keys, [LEFT_ONLY, RIGHT_ONLY])


def difference_union(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every cell that differs: extras of both sides and changed cells."""
    return _differences(aligned, keys, [LEFT_ONLY, RIGHT_ONLY, CHANGED])


def mismatched_fields(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Names of the differing columns of each changed row."""
    names = F.array_compact(F.array(*[F.when(_differs(c), F.lit(c)) for c in _values(aligned)]))
    return aligned.filter(F.col("status") == CHANGED).select(
        key_text(aligned, keys).alias("concatenated_keys"), names.alias("fields")
    )


def passed_cells(aligned: DataFrame, keys: Sequence[str], rows: int = 10) -> DataFrame:
    """The first equal rows by key, one line per column."""
    passed = aligned.filter(F.col("status") == SAME).orderBy(*keys).limit(rows)
    left, right = _side_texts(aligned, "l", keys), _side_texts(aligned, "r", keys)
    return _long(passed, keys, [_cell(name, left[name], right[name]) for name in left])


def limit_differences(differences: DataFrame, rows: int) -> DataFrame:
    """The cap on differing rows shown, in key order. Counts are never capped."""
    return differences.orderBy("concatenated_keys", "column_name").limit(rows)


# --- rows side by side -----------------------------------------------------

def _suffixed(aligned: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> list[Column]:
    cells = []
    for struct, suffix in (("l", "_x"), ("r", "_y")):
        cells += [(F.col(c) if c in keys else F.col(struct).getField(c)).alias(c + suffix) for c in columns]
    return cells


def joined_rows(left: DataFrame, right: DataFrame, keys: Sequence[str],
                columns: Sequence[str] | None = None) -> DataFrame:
    """Every left row with every right row of its key, in the columns of :func:`align`;
    NULL keys equal each other. Where keys repeat, operators on shared keys get all
    pairs from it, where ``align`` has the smallest row of each side."""
    keys = list(keys)
    columns = columns or common_columns(left, right)
    values = [c for c in columns if c not in keys]
    left, right = same_types(left, right, [*keys, *values])
    row = F.struct(*[F.col(f"`{c}`") for c in values]) if values else F.struct(F.lit(True).alias("_"))
    mine = left.select(*[F.col(f"`{k}`") for k in keys], row.alias("l"))
    other = right.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], row.alias("r"))
    same_key = all_of([mine[f"`{k}`"].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    one = F.lit(1).cast("bigint")
    joined = mine.join(other, same_key).drop(*[f"_k{i}" for i in range(len(keys))])
    return joined.select("*", one.alias("left_rows"), one.alias("right_rows")).withColumn(
        "status", _status(F.col("l").eqNullSafe(F.col("r"))))


def same_rows(left: DataFrame, right: DataFrame, keys: Sequence[str],
              columns: Sequence[str] | None = None) -> DataFrame:
    """All left rows of keys whose rows are the same on both sides, every copy."""
    same = key_status(left, right, keys, columns).filter(F.col("status") == SAME).select(*keys)
    chosen = columns or common_columns(left, right)
    values = [c for c in chosen if c not in keys]
    left, right = same_types(left, right, [*keys, *values])
    return key_presence_join(left, same, keys, "left_semi")


def merge_on_keys(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides for shared keys: keys, then the values as ``_x`` and ``_y``."""
    shared = aligned.filter((F.col("left_rows") > 0) & (F.col("right_rows") > 0))
    return shared.select(*keys, *_suffixed(aligned, keys, _values(aligned)))


def three_way_pairs(aligned: DataFrame, keys: Sequence[str], key_list: DataFrame) -> DataFrame:
    """Left row and right row side by side for the listed keys on both sides."""
    listed = key_presence_join(aligned, key_list, keys, "left_semi")
    shared = listed.filter((F.col("left_rows") > 0) & (F.col("right_rows") > 0))
    return shared.select(
        key_text(aligned, keys).alias("concatenated_keys"),
        *_suffixed(aligned, keys, [*keys, *_values(aligned)]),
    )


def passed_rows(aligned: DataFrame, keys: Sequence[str], rows: int = 10) -> DataFrame:
    """Left rows without a difference, the first ones by key."""
    passed = aligned.filter(F.col("status") == SAME).orderBy(*keys).limit(rows)
    return passed.select(*keys, "l.*")


def first_rows(df: DataFrame, keys: Sequence[str], rows: int = 10) -> DataFrame:
    """The sample shown when nothing differs."""
    return df.orderBy(*keys).limit(rows)


# --- summary ---------------------------------------------------------------

def _counts(aligned: DataFrame, columns: Sequence[str]) -> list[Column]:
    both = "left_rows > 0 AND right_rows > 0"
    counts = [
        "coalesce(sum(if(right_rows = 0, left_rows, 0L)), 0L) AS extra_in_left",
        "coalesce(sum(if(left_rows = 0, right_rows, 0L)), 0L) AS extra_in_right",
    ]
    values = _values(aligned)
    for i, name in enumerate(columns):
        cell = _quoted(name)
        changed = f"count_if({both} AND NOT (l.{cell} <=> r.{cell}))" if name in values else "count_if(false)"
        counts.append(f"{changed} AS _changed_{i}")
    return [F.expr(c) for c in counts]


def _summary(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_changed_{i}").alias("changed"))
        for i, c in enumerate(columns)
    ])
    changed = F.col("entry.changed")
    return counted.withColumn("entry", F.explode(entries)).select(
        F.col("entry.column_name").alias("column_name"),
        (F.col("total_left") - F.col("extra_in_left") - changed).alias("matched_left"),
        (F.col("total_right") - F.col("extra_in_right") - changed).alias("matched_right"),
        (changed + F.col("extra_in_left") + F.col("extra_in_right")).alias("mismatched"),
        "extra_in_left", "extra_in_right", "total_left", "total_right",
    )


def summarise(aligned: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: ``matched_left, matched_right, mismatched, extra_in_left,
    extra_in_right, total_left, total_right``, all counted in one aggregate."""
    columns = list(columns or [*keys, *_values(aligned)])
    totals = [F.coalesce(F.sum(f"{side}_rows"), F.lit(0)).alias(f"total_{side}") for side in ("left", "right")]
    return _summary(aligned.agg(*totals, *_counts(aligned, columns)), columns)


def summarise_differences(differing: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str],
                          columns: Sequence[str] | None = None) -> DataFrame:
    """The summary from rows that are not the same on both sides (usually few and
    staged); the totals are plain row counts of the two tables."""
    columns = list(columns or [*keys, *_values(differing)])
    counted = differing.agg(*_counts(differing, columns))
    totals = [side.agg(F.count(F.lit(1)).alias(name)) for name, side in (("total_left", left), ("total_right", right))]
    return _summary(side_by_side(*totals, counted), columns)


def column_mismatch_counts(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    return summarise(aligned, keys).select("column_name", "mismatched")


def flagged_summary(summary: DataFrame) -> DataFrame:
    """The summary with a flag beside each count that should be zero."""
    flags = [(F.col(c) > 0).alias(f"{c}_flag") for c in ("mismatched", "extra_in_left", "extra_in_right")]
    return summary.select("*", *flags)


def flagged_cells(differences: DataFrame) -> DataFrame:
    """Differences with a flag on cells that a side does not have."""
    return differences.withColumn(
        "absent_flag", any_of([F.col("left_value") == ABSENT, F.col("right_value") == ABSENT])
    )
