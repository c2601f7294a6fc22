"""History queries: search, sort, page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.lines import any_of
from ledgerline.functions.tokens import DATE_FORMATS, spark_date_pattern
from ledgerline.operators.skew import lookup_join

ASCENDING, DESCENDING = 0, 1


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_ilike(df: DataFrame, columns: Sequence[str], query: str = "") -> DataFrame:
    """Rows where one of ``columns`` contains ``query`` in any case."""
    if not query:
        return df
    return df.filter(any_of([F.col(c).ilike(f"%{escape_like(query)}%") for c in columns]))


def search_columns(df: DataFrame, positions: Sequence[int], query: str = "") -> DataFrame:
    """Rows where one of the columns at ``positions`` contains ``query``."""
    if not query:
        return df
    return df.filter(any_of([F.col(df.columns[i]).contains(query) for i in positions]))


def optional_filters(df: DataFrame, **equal: object) -> DataFrame:
    """All given conditions; ``None`` is no condition."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def order_pairs(flat: Sequence[int | str]) -> list[tuple[int, int]]:
    """``[column, direction, ...]`` to pairs; an odd last item is dropped and an empty
    list sorts by the first column."""
    numbers = [int(n) for n in flat]
    return list(zip(numbers[::2], numbers[1::2])) or [(0, ASCENDING)]


def order_by_ordinals(df: DataFrame, flat: Sequence[int | str]) -> DataFrame:
    return df.orderBy(*ordering(df, flat))


def ordering(df: DataFrame, flat: Sequence[int | str]) -> list[Column]:
    by = {ASCENDING: lambda c: c.asc(), DESCENDING: lambda c: c.desc()}
    return [by[way](F.col(df.columns[position])) for position, way in order_pairs(flat)]


def page(ordered: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ordered rows; a size of 0 or less is all of them."""
    if size <= 0:
        return ordered
    return ordered.offset((number - 1) * size).limit(size)


def history_page(df: DataFrame, columns: Sequence[str], search_positions: Sequence[int] = (),
                 query: str = "", order: Sequence[int | str] = (0, 0), number: int = 1, size: int = 33) -> DataFrame:
    chosen = search_columns(df.select(*columns), search_positions, query)
    # The other columns come last, so that rows with equal sort values keep one order on all pages.
    return page(chosen.orderBy(*ordering(chosen, order), *[F.col(c) for c in columns]), number, size)


def entity_page(df: DataFrame, search_in: Sequence[str], query: str = "", order_by: str = "id",
                direction: str = "asc", number: int = 1, size: int = 33) -> DataFrame:
    found = search_ilike(df, search_in, query)
    column = F.col(order_by)
    rest = [F.col(f"`{c}`") for c in df.columns if c != order_by]  # rows with equal values keep one order
    return page(found.orderBy(column.asc() if direction == "asc" else column.desc(), *rest), number, size)


def pivot_date(choice: str, batch: object = None, custom: object = None) -> Column:
    """The date a slice stands for: that of the batch, the current one or a given one."""
    if choice == "Current":
        return F.current_date()
    if choice not in ("Batch", "Custom"):
        raise ValueError(f"unknown choice {choice!r}")
    return F.to_date(F.lit(str(batch if choice == "Batch" else custom)))


def pivot_date_filter(df: DataFrame, column: str, day: Column, date_format: str) -> DataFrame:
    """Rows of one day. A date or time column is compared as a range on the raw
    column, which prunes files; a text column is compared in ``date_format``."""
    if date_format not in DATE_FORMATS:
        raise ValueError(f"unknown date format {date_format!r}")
    value, kind = F.col(column), df.schema[column].dataType.simpleString()
    if kind == "date":
        return df.filter(value == day)
    if kind.startswith("timestamp"):
        return df.filter((value >= day.cast(kind)) & (value < F.date_add(day, 1).cast(kind)))
    return df.filter(value == F.date_format(day, spark_date_pattern(date_format)))


def orders_with_users(orders: DataFrame, users: DataFrame, costly: bool = False) -> DataFrame:
    """``order_id, batch_id, name, email`` of each order; ``orders`` has ``id, user_id,
    batch_id`` and ``users`` has ``id, name, email``, one row per user. ``costly`` states
    that they are more than scans; each is then evaluated once."""
    named = users.select(F.col("id").alias("user_id"), "name", "email")
    return lookup_join(orders, named, ["user_id"], costly=costly).select(F.col("id").alias("order_id"), "batch_id", "name", "email")


def only_row(df: DataFrame, what: str) -> DataFrame:
    """``df``, which may have one row at most; more than one raise."""
    if len(df.limit(2).select(F.lit(1)).collect()) > 1:
        raise ValueError(f"more than one {what}")
    return df


def recent_orders(orders: DataFrame, batch: DataFrame, users: DataFrame, search_in: Sequence[str] = ("name",),
                  query: str = "", direction: str = "desc", number: int = 1, size: int = 33,
                  sort_by: str = "id") -> DataFrame:
    """Orders of one batch (a table of one row) with the user's name, a page of them, by
    ``sort_by`` and then by ``id``, both in ``direction``. ``end_time`` is in the result
    where orders have it.

    The batch is a single row, so it is broadcast and only its orders go on."""
    of_batch = orders.join(F.broadcast(only_row(batch, "batch")), "batch_id")
    named = lookup_join(of_batch, users, ["user_id"])
    if query:
        named = named.filter(any_of([F.col(c).contains(query) for c in search_in]))
    by = [F.col("id")] if sort_by == "id" else [F.col(f"`{sort_by}`"), F.col("id")]
    ordered = named.orderBy(*[c.desc() if direction == "desc" else c.asc() for c in by])
    ended = ["end_time"] if "end_time" in orders.columns else []
    return page(ordered, number, size).select("id", "start_time", *ended, "batch_date", "name")


def last_order(orders: DataFrame, batch: DataFrame) -> DataFrame:
    """Newest order id of one batch."""
    of_batch = orders.join(F.broadcast(only_row(batch, "batch")), "batch_id")
    return of_batch.agg(F.max("id").alias("last_order_id"))


def last_runs(runs: DataFrame, order_by: str, rows: int = 10, **equal: object) -> DataFrame:
    return optional_filters(runs, **equal).orderBy(F.col(order_by).desc()).limit(rows)


def total_for_paging(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def history_export(df: DataFrame) -> DataFrame:
    """The whole result without its first column."""
    return df.select(*df.columns[1:])


def rename_to(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The listed columns under their new names, in the listed order."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])
