"""Expressions on lines of text: padding, masks, cut spans, lists, names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def pad_cell(text: Column, width: int, align: str = "<", fill: str = " ") -> Column:
    """Pad to ``width``: ``<`` left, ``>`` right, ``^`` centre with the smaller half on
    the left. Longer text is kept whole, unlike ``rpad`` and ``lpad``."""
    text = F.coalesce(text, F.lit(""))
    missing = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    blank = F.lit(fill)
    if align == "<":
        return F.concat(text, F.repeat(blank, missing))
    if align == ">":
        return F.concat(F.repeat(blank, missing), text)
    if align == "^":
        left = F.floor(missing / 2).cast("int")
        return F.concat(F.repeat(blank, left), text, F.repeat(blank, missing - left))
    raise ValueError(f"unknown alignment {align!r}")


def zero_pad(text: Column, width: int, keep: str = "left") -> Column:
    """Zero-pad on the left; text that is too long keeps its left or right end."""
    if keep == "right":
        text = F.when(F.length(text) > width, F.right(text, F.lit(width))).otherwise(text)
    return F.lpad(text, width, "0")


def blank_pad(text: Column, width: int) -> Column:
    """Blank-pad on the right and cut to ``width``."""
    return F.rpad(text, width, " ")


def mask_line(expected: Column, actual: Column, ignore: str) -> Column:
    """``actual`` with ``ignore`` at each position where ``expected`` holds it.

    Walks the characters of the actual line once: a position beyond the expected
    line never holds the mark, so the line keeps its own length.
    """
    wanted = F.split(expected, "")
    given = F.split(actual, "")
    marked = F.transform(
        given,
        lambda ch, i: F.when(F.try_element_at(wanted, i + 1) == F.lit(ignore), F.lit(ignore)).otherwise(ch),
    )
    needed = (F.instr(expected, ignore) > 0) & (actual != "")
    return F.when(needed, F.array_join(marked, "")).otherwise(actual)


def cut_spans(text: Column, spans: Sequence[tuple[int, int]] | str) -> Column:
    """Drop inclusive 0-based ``(start, end)`` spans, given in ascending order;
    ``"ALL"`` leaves the text as it is."""
    if spans == "ALL":
        return text
    kept, at = [], 0
    for start, end in spans:
        if start > at:
            kept.append(F.substring(text, at + 1, start - at))
        at = max(at, end + 1)
    kept.append(F.substring(text, F.lit(at + 1), F.greatest(F.length(text) - at, F.lit(0))))
    return F.concat(*kept)


def spans_of(positions: str) -> list[tuple[int, int]] | str:
    """``"0,3,10,12"`` to spans; odd counts and other characters are errors."""
    if positions == "ALL":
        return positions
    numbers = [p for p in positions.split(",") if p]
    if len(numbers) % 2 or not all(p.isdigit() for p in numbers):
        raise ValueError(f"positions must be pairs of numbers: {positions!r}")
    numbers = [int(p) for p in numbers]
    return list(zip(numbers[::2], numbers[1::2]))


def list_to_json(items: Column) -> Column:
    return F.when(items.isNull() | (F.size(items) == 0), F.lit("[]")).otherwise(F.to_json(items))


def json_to_list(text: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | (text == ""), empty).otherwise(F.from_json(text, "array<string>"))


def list_to_text(items: Column, separator: str = ",") -> Column:
    return F.coalesce(F.array_join(items, separator), F.lit(""))


def text_to_list(text: Column, separator: str = ",") -> Column:
    empty = F.array().cast("array<string>")
    parts = F.split(text, f"\\Q{separator}\\E", -1)
    return F.when(text.isNull() | (text == ""), empty).otherwise(parts)


def clean_table_name(full_name: Column) -> Column:
    """Last dotted part without surrounding brackets."""
    return F.regexp_replace(F.element_at(F.split(full_name, "[.]"), -1), r"^[\[\]]+|[\[\]]+$", "")


def strip_quotes_commas(text: Column) -> Column:
    return F.translate(text, '",', "")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
