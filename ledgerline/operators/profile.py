"""What the rows say about a table: values per column, and its keys.

:func:`minimal_keys` goes through the lattice of column sets. Two rows that agree refute a
set and each part of it; they are looked for in a few rows first, then for each set that is
left in a slice of its own values, which holds all rows of a value. What is left is decided
over all rows. A part of few repeated rows decides for each set that holds it: rows that
agree on the set are among those, so one pass over the table serves many sets.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ledgerline.functions.rowtext import value_text
from ledgerline.session import stage

# Size of a sketch: 2^14 counters, whose estimate is off by 0.8 % (one standard deviation).
SKETCH_BITS = 14
# Rows in which repeats are looked for, and the shares of them (one in so many) tried first.
SLICE_ROWS, SHARES = 1 << 17, (32, 4, 1)
# Sets of columns in one pass over these rows, in one pass over the table for slices.
MARKED, SLICED = 64, 16
# A part of a set decides for it where about so many rows at most have repeated values.
PART_ROWS = 1 << 20
# The first argument of the second of two hashes.
SEED = 14
# Longer values go through a shuffle as their digest.
LONG_VALUE = 64

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _name(column: str) -> Column:
    return F.col(_quoted(column))


def _value(field: T.StructField) -> Column:
    """Text that tells the values of a column apart; nested values as JSON."""
    column, kind = _name(field.name), field.dataType
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, _NESTED):
        return F.when(column.isNotNull(), F.to_json(F.struct(column)))
    return value_text(column, kind)


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column ``position, column_name, data_type, total_rows, null_rows,
    distinct_values`` and, where ``exact``, ``most_rows_per_value``.

    The exact form is one scan and one shuffle of the distinct values of each task, which
    are counted before they are sent, so a frequent value costs nothing; a value longer
    than ``LONG_VALUE`` characters is sent as its SHA-256. Otherwise sketches are merged in
    one aggregate. NULL is not a value; an empty table has a row of zeros per column.
    """
    fields = df.schema.fields
    spark = df.sparkSession
    listed = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields, 1)],
                                   "position int, column_name string, data_type string")
    names = ["total_rows", "null_rows", "distinct_values", *(["most_rows_per_value"] if exact else [])]
    if not fields:
        counts = spark.createDataFrame([], "position int, " + ", ".join(f"{n} long" for n in names))
    elif exact:
        values = F.array(*[F.struct(F.lit(i).alias("position"), _value(f).alias("value"))
                           for i, f in enumerate(fields, 1)])
        cells = _cells(df, values)
        per_value = cells.groupBy("position", "is_long", "value").agg(F.count(F.lit(1)).alias("n"))
        there = F.col("value").isNotNull()
        counts = per_value.groupBy("position").agg(
            F.sum("n").alias("total_rows"), F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("null_rows"),
            F.count("value").alias("distinct_values"), F.max(F.when(there, F.col("n"))).alias("most_rows_per_value"),
        )
    else:
        sketched = df.agg(F.array(*[
            F.struct(F.lit(i).alias("position"), F.count(F.lit(1)).alias("total_rows"),
                     F.count_if(_name(f.name).isNull()).alias("null_rows"),
                     _estimate(F.when(_name(f.name).isNotNull(), F.xxhash64(_value(f)))).alias("distinct_values"))
            for i, f in enumerate(fields, 1)
        ]).alias("columns"))
        counts = sketched.select(F.explode("columns").alias("c")).select("c.*")
    found = listed.join(F.broadcast(counts), "position", "left")  # a row per column on both sides
    return found.select(F.col("position").cast("bigint").alias("position"), "column_name", "data_type",
                        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def _cells(df: DataFrame, values: Column) -> DataFrame:
    """A row per cell, a long value as its digest."""
    cells = df.select(F.explode(values).alias("cell")).select("cell.position", "cell.value")
    long = F.coalesce(F.length("value") > LONG_VALUE, F.lit(False))
    return cells.select("position", long.alias("is_long"),
                        F.when(long, F.sha2("value", 256)).otherwise(F.col("value")).alias("value"))


def _estimate(hashed: Column) -> Column:
    """Distinct values by a mergeable sketch."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(SKETCH_BITS))), F.lit(0))


Columns = tuple[str, ...]


def _batches(items: Iterable[Columns], size: int) -> Iterable[list[Columns]]:
    items = iter(items)
    while batch := list(itertools.islice(items, size)):
        yield batch


def _parts(columns: Columns) -> Iterable[Columns]:
    """The sets of columns within a set, itself included."""
    return (part for size in range(1, len(columns) + 1) for part in itertools.combinations(columns, size))


def _hashed(columns: Iterable[str]) -> Column:
    """128 bits per column."""
    return F.struct(*[F.struct(F.xxhash64(_name(c)).alias("h"), F.xxhash64(F.lit(SEED), _name(c)).alias("g")).alias(c)
                      for c in columns]).alias("row")


def _hash(columns: Iterable[str]) -> str:
    return f"xxhash64({', '.join(columns)})"


def _mark(number: int, first: Sequence[str], second: Sequence[str]) -> str:
    """The value of a set of columns as its number and 128 bits."""
    return f"named_struct('i', {number}, 'h', {_hash(first)}, 'g', {_hash([str(SEED), *second])})"


def _repeats(rows: DataFrame, marks: Sequence[str]) -> dict[int, int]:
    """Rows of values that repeat, by the number of the set; sets without are left out."""
    cells = rows.select(F.expr(f"explode(array({', '.join(marks)}))").alias("m")).filter("m IS NOT NULL").select("m.*")
    per_value = cells.groupBy("i", "h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return {row["i"]: row["n"] for row in per_value.groupBy("i").agg(F.sum("n").alias("n")).collect()}


def _refuted(hashed: DataFrame, sets: Iterable[Columns]) -> set[Columns]:
    """The sets of columns of which rows of :func:`_hashed` repeat a value, with their parts.
    Wide sets come first, as a repeat of theirs refutes each part."""
    found: set[Columns] = set()
    for _, wide in itertools.groupby(sorted(sets, key=len, reverse=True), len):
        for batch in _batches([s for s in wide if s not in found], MARKED):
            marks = [_mark(i, [f"row.{_quoted(c)}.h" for c in s], [f"row.{_quoted(c)}.g" for c in s])
                     for i, s in enumerate(batch)]
            for i in _repeats(hashed, marks):
                found.update(_parts(batch[i]))
    return found


def _repeated_in_slices(df: DataFrame, sets: Iterable[Columns], slices: int) -> dict[Columns, int]:
    """Per set of columns the rows that repeat a value, in one of ``slices`` of its values.
    Equal values are in the same slice, so a repeat there is one of the table. One pass
    serves many sets, and sends one row in ``slices`` for each."""
    found = {}
    for batch in _batches(sets, SLICED):
        quoted = [[*map(_quoted, s)] for s in batch]
        inside = [f"pmod({_hash(s)}, {slices}) = 0" for s in quoted]
        marks = [f"if({kept}, {_mark(i, s, s)}, NULL)" for i, (s, kept) in enumerate(zip(quoted, inside))]
        repeats = _repeats(df.filter(" OR ".join(inside)), marks)
        found.update((s, repeats.get(i, 0)) for i, s in enumerate(batch))
    return found


def _deciding_parts(sets: Iterable[Columns], few: Mapping[Columns, int]) -> dict[Columns, Columns]:
    """For each set the part whose repeated rows decide it, out of ``few``, which has the
    sets too, with about how many rows repeat. The part that most sets hold comes first."""
    held: dict[Columns, set[Columns]] = defaultdict(set)
    for columns in sets:
        for part in _parts(columns):
            if part in few:
                held[part].add(columns)
    chosen = {}
    while held:
        part = max(held, key=lambda p: (len(held[p]), -few[p]))
        decided = held.pop(part)
        chosen.update(dict.fromkeys(sorted(decided), part))
        held = {p: left for p, those in held.items() if (left := those - decided)}
    return chosen


def _without_repeats(df: DataFrame, sets: Mapping[Columns, Columns]) -> list[Columns]:
    """The sets of columns of which no value repeats in all rows, without those that hold
    another. Each comes with a part of it, whose values are counted as 64 bits: where these
    differ the values do. Rows in which they repeat are staged, and all sets that hold the
    part are decided among them."""
    keys: list[Columns] = []
    for part in dict.fromkeys(sets.values()):
        held = [s for s, of in sets.items() if of == part and set(keys).isdisjoint(_parts(s))]
        if not held:
            continue
        value = F.xxhash64(*map(_name, part)).alias("value")
        counted = df.select(value).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        repeated = stage(counted.filter("n > 1").select("value"), "repeated-values")
        if values := repeated.count():
            few = F.broadcast(repeated) if values <= PART_ROWS else repeated
            rows = df.select(value, _hashed(sorted({c for s in held for c in s})))
            refuted = _refuted(stage(rows.join(few, "value", "left_semi").select("row"), "repeated-rows"), held)
            held = [s for s in held if s not in refuted]
        keys += held
    return [s for s in keys if sum(part in set(keys) for part in _parts(s)) == 1]


def minimal_key_sets(df: DataFrame, width: int = 3) -> list[Columns]:
    """The sets of at most ``width`` columns that are keys, none of them within another.

    A key has no NULL and no repeated value. Nested columns are left out. In a table of one
    row or none each column without NULL is a key. All sets are decided over all rows; the
    driver holds one number per set of columns. Sets grow as the columns choose the width.
    """
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, _NESTED)]
    if not names:
        return []
    filled = df.agg(F.count(F.lit(1)), *[F.count(_name(c)) for c in names]).first()
    rows, free = filled[0], [c for c, n in zip(names, filled[1:]) if n == filled[0]]
    sets = [s for size in range(1, width + 1) for s in itertools.combinations(free, size)]
    if not sets:
        return []
    share = SLICE_ROWS / max(rows, SLICE_ROWS)
    some = df.filter(F.rand(0) < share).select(F.rand(1).alias("place"), _hashed(free))
    some = stage(some.repartition(df.sparkSession.sparkContext.defaultParallelism), "some-rows")
    for fewer in SHARES:
        refuted = _refuted(some.filter(F.col("place") < 1 / fewer), sets)
        sets = [s for s in sets if s not in refuted]
    slices = max(-(-rows // SLICE_ROWS), 1)
    in_slices = _repeated_in_slices(df, sets, slices)
    refuted = {part for s, n in in_slices.items() if n for part in _parts(s)}
    likely = [s for s in sets if s not in refuted]
    few = {s: n * slices for s, n in in_slices.items() if n * slices <= PART_ROWS}
    found = _without_repeats(df, _deciding_parts(likely, {**few, **dict.fromkeys(likely, 0)}))
    return sorted(found, key=lambda s: (len(s), [free.index(c) for c in s]))


def minimal_keys(df: DataFrame, width: int = 3) -> DataFrame:
    """:func:`minimal_key_sets` as rows ``width, key_columns``, an array in table order."""
    found = [(len(key), list(key)) for key in minimal_key_sets(df, width)]
    return df.sparkSession.createDataFrame(found, "width long, key_columns array<string>")


def table_sizes(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``table_name, total_rows`` of tables and views."""
    empty = spark.createDataFrame([], "table_name string, total_rows long")
    counts = [spark.table(name).agg(F.count(F.lit(1)).alias("total_rows")).select(F.lit(name).alias("table_name"), "*")
              for name in names]
    return reduce(DataFrame.unionByName, counts, empty)
