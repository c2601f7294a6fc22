"""Generated rows. Each value is drawn from a hash of seed, name and row number,
so that a lost task makes the same rows again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.functions.lines import blank_pad, zero_pad
from ledgerline.sources.tables import date_series

# Parts of made-up names.
FIRST_NAMES = ("Ada", "Ben", "Cora", "Dev", "Eli", "Fay", "Gus", "Hana")
LAST_NAMES = ("Archer", "Brook", "Castle", "Dale", "Ember", "Frost", "Grove", "Hill")
CATEGORY_NAMES = ("Books", "Garden", "Kitchen", "Music", "Office", "Sport", "Tools", "Toys")

DAY_SECONDS, EPOCH = 86_400, "1970-01-01 00:00:00"


def draw(row: Column, name: str, size: int | Column, seed: int = 0) -> Column:
    """A whole number from 0 to ``size - 1``, fixed by seed, name and row."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), row.cast("string")).cast("binary"))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
    return number % (size if isinstance(size, Column) else F.lit(size))


def _pick(row: Column, name: str, words: Sequence[str], seed: int) -> Column:
    options = F.array(*[F.lit(w) for w in words])
    return F.element_at(options, (draw(row, name, len(words), seed) + 1).cast("int"))


@dataclass(frozen=True)
class FixedColumn:
    name: str
    kind: str  # int, float, str, date, datetime
    length: int


def numbered_range(spark: SparkSession, rows: int) -> DataFrame:
    return spark.range(1, rows + 1).select(F.col("id").alias("row_no"))


def fixed_records(numbered: DataFrame, columns: Sequence[FixedColumn], last_day: str,
                  seed: int = 0) -> DataFrame:
    """Text columns of fixed length for each ``row_no``.

    The first column, when it is an int, is the row number itself; dates fall
    between 1970-01-01 and ``last_day``.
    """
    row = F.col("row_no")
    days = F.datediff(F.to_date(F.lit(last_day)), F.to_date(F.lit("1970-01-01")))
    cells = []
    for place, column in enumerate(columns):
        if column.kind == "int":
            number = row if place == 0 else draw(row, column.name, 1_000_000, seed) + 1
            cell = zero_pad(number.cast("string"), column.length)
        elif column.kind == "float":
            whole = draw(row, column.name + "/whole", 100_000_000_000_000, seed)
            cents = draw(row, column.name + "/cents", 100, seed)
            text = F.concat(whole.cast("string"), F.lit("."), F.lpad(cents.cast("string"), 2, "0"))
            cell = zero_pad(text, column.length, keep="right")
        elif column.kind == "str":
            first = _pick(row, column.name + "/first", FIRST_NAMES, seed)
            last = _pick(row, column.name + "/last", LAST_NAMES, seed)
            cell = blank_pad(F.concat_ws(" ", first, last), column.length)
        elif column.kind in ("date", "datetime"):
            seconds = draw(row, column.name, days.cast("bigint") * DAY_SECONDS, seed)
            moment = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
            pattern = "yyyy-MM-dd" if column.kind == "date" else "yyyy-MM-dd HH:mm:ss"
            cell = F.date_format(moment, pattern)
        else:
            raise ValueError(f"unknown kind {column.kind!r}")
        cells.append(cell.alias(column.name))
    return numbered.select(*cells)


def batches(bounds: DataFrame, seed: int = 0) -> DataFrame:
    """One completed batch per day of ``bounds``: 07:00 to a little after 17:00."""
    day = F.col("batch_date")
    number = F.datediff(day, F.lit("1970-01-01"))
    late = draw(number, "batch/late", 3_600, seed)
    start = F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" 07:00:00")))
    end = F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" 17:00:00")))
    return date_series(bounds, name="batch_date").select(
        number.cast("bigint").alias("id"),
        "batch_date",
        F.lit("completed").alias("status"),
        start.alias("start_time"),
        (end + F.make_dt_interval(secs=late.cast("decimal(18,6)"))).alias("end_time"),
    )


def users(numbered: DataFrame, seed: int = 0) -> DataFrame:
    row = F.col("row_no")
    first, last = _pick(row, "user/first", FIRST_NAMES, seed), _pick(row, "user/last", LAST_NAMES, seed)
    return numbered.select(
        row.alias("id"),
        F.concat_ws(" ", first, last).alias("name"),
        F.concat(F.lower(first), F.lit("."), row.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("555-"), F.lpad(draw(row, "user/phone", 10_000, seed).cast("string"), 4, "0"))
        .alias("phone_number"),
    )


def products(numbered: DataFrame, seed: int = 0) -> DataFrame:
    row = F.col("row_no")
    price = (draw(row, "product/cents", 100_000, seed) / 100).cast("decimal(15,2)")
    return numbered.select(row.alias("id"), F.concat(F.lit("Product "), row.cast("string")).alias("name"),
                           price.alias("price"))


def category_links(numbered: DataFrame, n_products: int, seed: int = 0) -> DataFrame:
    """Random product and category pairs; pairs may repeat."""
    row = F.col("row_no")
    return numbered.select(
        row.alias("id"),
        (draw(row, "link/product", n_products, seed) + 1).alias("product_id"),
        (draw(row, "link/category", len(CATEGORY_NAMES), seed) + 1).alias("category_id"),
        _pick(row, "link/category", CATEGORY_NAMES, seed).alias("category_name"),
    )


def orders(numbered: DataFrame, n_users: int, first_day: str, n_days: int, seed: int = 0) -> DataFrame:
    """One order per ``row_no``: a random user and batch, starting 1-6 hours into
    the batch and taking 50-250 seconds."""
    row = F.col("row_no")
    day = F.date_add(F.to_date(F.lit(first_day)), draw(row, "order/day", n_days, seed).cast("int"))
    hours = (draw(row, "order/hour", 6, seed) + 8).cast("int")
    seconds = draw(row, "order/seconds", 201, seed) + 50
    start = F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" "),
                                        F.lpad(hours.cast("string"), 2, "0"), F.lit(":00:00")))
    return numbered.select(
        row.alias("id"),
        (draw(row, "order/user", n_users, seed) + 1).alias("user_id"),
        F.datediff(day, F.lit("1970-01-01")).cast("bigint").alias("batch_id"),
        start.alias("start_time"),
        (start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("end_time"),
    )


def order_items(order_rows: DataFrame, n_products: int, seed: int = 0) -> DataFrame:
    """1-6 items of quantity 1-6 for each order ``id``."""
    order = F.col("id")
    count = (draw(order, "order/items", 6, seed) + 1).cast("int")
    each = order_rows.select(order.alias("order_id"), F.explode(F.sequence(F.lit(1), count)).alias("item_no"))
    item = F.col("order_id") * 6 + F.col("item_no") - 6
    return each.select(
        item.alias("id"),
        "order_id",
        (draw(item, "item/product", n_products, seed) + 1).alias("product_id"),
        (draw(item, "item/quantity", 6, seed) + 1).alias("quantity"),
    )
