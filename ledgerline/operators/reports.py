"""Shares, running shares, the paged print report and order totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.functions.lines import pad_cell
from ledgerline.functions.rowtext import cell_text
from ledgerline.operators.numbering import number_rows
from ledgerline.operators.skew import lookup_join

# Half turn used for the angles, layout of the print report.
HALF_TURN = 3.14
ROWS_PER_PAGE, CELL_CUT, CELL_WIDTH, LINE_WIDTH = 10, 20, 25, 100


def status_share(df: DataFrame, status: str, colours: Mapping[str, str] | None = None) -> DataFrame:
    """Rows per status, angle of its wedge and colour: ``status, rows, angle, colour``."""
    counted = df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())  # one row per status by now
    colour = F.lit(None).cast("string")
    for name, value in (colours or {}).items():
        colour = F.when(F.col("status") == name, F.lit(value)).otherwise(colour)
    return counted.select("status", "rows", (F.col("rows") / total * 2 * HALF_TURN).alias("angle"),
                          colour.alias("colour"))


def running_share(shares: DataFrame) -> DataFrame:
    """Start and end angle of each wedge in status order."""
    order = Window.orderBy("status")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    return shares.select(
        "status", F.coalesce(F.sum("angle").over(before), F.lit(0.0)).alias("start_angle"),
        F.sum("angle").over(until).alias("end_angle"),
    )


def paged_report(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Print lines: ``row_no, part, line``; in that order they are the report.

    Each page starts with its number, the column names and a rule. The first page
    is headed before row 1, each later one before a row whose number divides by
    the page length, so the first page has one row less than the others.
    """
    texts = df.select(*order, *[cell_text(df, c).alias(f"_cell_{i}") for i, c in enumerate(columns)])
    numbered = number_rows(texts, order)
    number = F.floor(F.col("row_no") / ROWS_PER_PAGE) + 1
    heading = F.lpad(F.concat(F.lit("page_number="), number.cast("string")), LINE_WIDTH, "*")
    names = F.lit("".join(c.ljust(CELL_WIDTH) for c in columns))
    rule = F.lit("-" * LINE_WIDTH)
    cells = [pad_cell(F.substring(F.coalesce(F.col(f"_cell_{i}"), F.lit("")), 1, CELL_CUT), CELL_WIDTH)
             for i in range(len(columns))]
    line = F.concat(*cells)
    starts = (F.col("row_no") == 1) | (F.col("row_no") % ROWS_PER_PAGE == 0)
    lines = F.when(starts, F.array(heading, names, rule, line)).otherwise(F.array(line))
    return numbered.select("row_no", F.posexplode(lines).alias("part", "line"))


def order_total(items: DataFrame, products: DataFrame, costly: bool = False) -> DataFrame:
    """Sum of price x quantity per order; ``items`` has ``order_id, product_id,
    quantity`` and ``products`` has ``product_id, price``, one row per product.
    ``costly`` states that they are more than scans; each is then evaluated once."""
    priced = lookup_join(items.select("order_id", "product_id", "quantity"), products, ["product_id"], costly=costly)
    amount = F.col("price").cast("decimal(15,2)") * F.col("quantity").cast("decimal(10,0)")
    return priced.groupBy("order_id").agg(F.sum(amount).alias("total_price"))
