"""Rows to lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.lines import pad_cell
from ledgerline.functions.rowtext import cell_text


def _twice(text: Column, mark: str) -> Column:
    return F.replace(text, F.lit(mark), F.lit(mark + mark))


def delimited_line(df: DataFrame, columns: Sequence[str] | None = None, sep: str = ",",
                   quote: str | None = None, escape: str = "\\", scale: int | None = None) -> Column:
    """One line per row, no column header.

    With ``quote`` every field is quoted, an inner quote doubled and an inner
    escape character escaped. Without it nothing is quoted, and separators and
    escape characters inside a field are escaped. NULL is an empty field.
    """
    cells = []
    for name in columns or df.columns:
        text = F.coalesce(cell_text(df, name, scale), F.lit(""))
        if escape:
            text = _twice(text, escape)
        if quote:
            text = F.concat(F.lit(quote), _twice(text, quote), F.lit(quote))
        elif escape:
            text = F.replace(text, F.lit(sep), F.lit(escape + sep))
        cells.append(text)
    return F.concat_ws(sep, *cells)


def fixed_width_line(df: DataFrame, columns: Sequence[str], widths: Sequence[int],
                     alignments: Sequence[str], scale: int | None = None) -> Column:
    """Padded cells side by side; a value longer than its width is not cut."""
    cells = [pad_cell(cell_text(df, name, scale), width, align)
             for name, width, align in zip(columns, widths, alignments, strict=True)]
    return F.concat(*cells)


def delimited_lines(df: DataFrame, columns: Sequence[str] | None = None, sep: str = ",",
                    quote: str | None = None, escape: str = "\\", scale: int | None = None) -> DataFrame:
    return df.select(delimited_line(df, columns, sep, quote, escape, scale).alias("value"))


def fixed_width_lines(df: DataFrame, columns: Sequence[str], widths: Sequence[int],
                      alignments: Sequence[str], scale: int | None = None) -> DataFrame:
    return df.select(fixed_width_line(df, columns, widths, alignments, scale).alias("value"))
