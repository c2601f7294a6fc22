"""Pages at any depth of an ordered table, without sorting what lies before them.

``OFFSET`` lets one task pass over every row before the page. Here two splitters are taken from
a small sample, on both sides of where the page should be, and one aggregate counts the rows
before, at, between and after them, exactly. Only the part that holds the page is looked at
again, in the same way, until it is small enough to be sorted. A part shrinks to about an
eighth in each round. Rows that equal a splitter in all columns are alike, however many they
are, and are taken without a sort. Each round scans the table with a filter; the driver sees a
sample and five counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.lines import all_of, any_of
from ledgerline.operators.search import ASCENDING, order_pairs, search_columns

#: Rows that are sorted in the end, and rows expected in a sample.
SORTED_ROWS = 100_000
SAMPLED_ROWS = 1_000

Order = Sequence[tuple[str, bool]]  # names, and whether descending


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _sorted(df: DataFrame, order: Order) -> DataFrame:
    """NULL comes first where ascending and last where descending, as Spark sorts."""
    return df.orderBy(*[_column(c).desc() if down else _column(c).asc() for c, down in order])


def _before(df: DataFrame, order: Order, splitter: Sequence[str | None]) -> Column:
    """Whether a row comes before a splitter, column by column."""
    found, equal = [], []
    for (name, down), text in zip(order, splitter):
        here, value = _column(name), F.lit(text).cast(df.schema[name].dataType)
        if text is None:
            first = here.isNotNull() if down else F.lit(False)
        elif down:
            first = F.coalesce(here > value, F.lit(False))
        else:
            first = F.coalesce(here < value, F.lit(True))
        found.append(all_of([*equal, first]))
        equal.append(here.eqNullSafe(value))
    return any_of(found)


def _equals(df: DataFrame, order: Order, splitter: Sequence[str | None]) -> Column:
    return all_of([_column(n).eqNullSafe(F.lit(t).cast(df.schema[n].dataType)) for (n, _), t in zip(order, splitter)])


def _splitters(df: DataFrame, order: Order, rows: int, offset: int, size: int, seed: int) -> list[tuple]:
    """One or two sampled rows, as text, around the rows from ``offset`` on."""
    texts = [_column(c).cast("string") for c, _ in order]
    sample: list[tuple] = []
    while not sample:
        sample = [tuple(r) for r in _sorted(df.sample(min(1.0, SAMPLED_ROWS / rows), seed), order).select(*texts).collect()]
        seed += 1
    margin = 2 * len(sample) ** 0.5
    low = int(offset / rows * len(sample) - margin)
    high = int((offset + size) / rows * len(sample) + margin) + 1
    places = [n for n in (low, high) if 0 <= n < len(sample)]
    return list(dict.fromkeys(sample[n] for n in places or [len(sample) // 2]))


def _pieces(df: DataFrame, order: Order, rows: int, offset: int, size: int, seed: int) -> list[DataFrame]:
    size = min(size, rows - offset)
    if size <= 0:
        return []
    if rows <= SORTED_ROWS:
        return [_sorted(df, order).offset(offset).limit(size)]
    marks = _splitters(df, order, rows, offset, size, seed)
    # Parts in order: before a splitter, equal to it, ..., after the last.
    part = F.lit(2 * len(marks))
    for n in range(len(marks) - 1, -1, -1):
        part = F.when(_before(df, order, marks[n]), 2 * n).when(_equals(df, order, marks[n]), 2 * n + 1).otherwise(part)
    counts = df.select(part.alias("part")).agg(*[F.count_if(F.col("part") == n) for n in range(2 * len(marks) + 1)]).first()
    found, passed = [], 0
    for n, count in enumerate(counts):
        start, end = max(offset - passed, 0), min(offset + size - passed, count)
        if start < end:
            inside = df.where(part == n)
            if n % 2:  # rows that are all alike
                found.append(inside.limit(end - start))
            else:
                found += _pieces(inside, order, count, start, end - start, seed + 1)
        passed += count
    return found


def deep_page(df: DataFrame, order: Order, offset: int, size: int, seed: int = 17) -> DataFrame:
    """``size`` rows from ``offset`` on, in order. Columns that ``order`` does not name come
    last, ascending, so that every row has its place; ``df`` should be a scan or staged."""
    if size <= 0 or offset < 0:
        raise ValueError("a page has a size, and does not start before the first row")
    whole = [*order, *[(c, False) for c in df.columns if c not in {name for name, _ in order}]]
    found = _pieces(df, whole, df.count(), offset, size, seed)
    return _sorted(reduce(DataFrame.unionByName, found), whole) if found else df.limit(0)


def deep_history_page(df: DataFrame, columns: Sequence[str], search_positions: Sequence[int] = (), query: str = "",
                      order: Sequence[int | str] = (0, 0), number: int = 1, size: int = 33) -> DataFrame:
    """The rows of :func:`~ledgerline.operators.search.history_page`, for pages far behind."""
    chosen = search_columns(df.select(*columns), search_positions, query)
    pairs = dict.fromkeys((chosen.columns[position], way != ASCENDING) for position, way in order_pairs(order))
    first: dict[str, bool] = {}
    for name, down in pairs:
        first.setdefault(name, down)
    return deep_page(chosen, list(first.items()), (number - 1) * size, size)
