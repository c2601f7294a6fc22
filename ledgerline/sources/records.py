"""Records in lines: delimited, fixed width, and delimiter normalisation.

All fields are read as text, so that ``0001`` keeps its zeros; cast with an
explicit schema where a type is wanted. An empty field is NULL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: what separators become in normalised lines.
UNIT_SEPARATOR = "␟"

# Stand-ins inside a line while it is split; both are Unicode noncharacters.
_HELD = "\ufdd0"
_QUOTE = "\ufdd1"


def _one_unit(mark: str) -> bool:
    """Whether the CSV parser can take ``mark``: one UTF-16 code unit."""
    return len(mark.encode("utf-16-le")) == 2


def read_delimited(lines: DataFrame, columns: Sequence[str], sep: str = ",", quote: str | None = None,
                   escape: str = "\\", keep: Sequence[str] = (), newlines: bool = False) -> DataFrame:
    """Delimited lines (column ``value``) to text columns; ``keep`` names columns of
    ``lines`` to carry along. ``newlines`` keeps line ends inside fields as they are.

    With ``quote`` the fields are quoted, an inner quote is doubled and an inner
    escape character is escaped. Without it nothing is quoted and the escape
    character protects the separator.
    """
    value, stand_in = F.col("value"), None
    if quote:
        if not _one_unit(quote):
            stand_in = quote
            value, quote = F.replace(value, F.lit(quote), F.lit(_QUOTE)), _QUOTE
        schema = ", ".join(f"`{c}` STRING" for c in columns)
        options = {"sep": sep, "quote": quote, "escape": quote, "mode": "PERMISSIVE",
                   "multiLine": str(newlines).lower()}
        row = lines.select(*keep, F.from_csv(value, schema, options).alias("row"))
        fields = [F.col("row").getField(c) for c in columns]
        if stand_in:
            fields = [F.replace(f, F.lit(_QUOTE), F.lit(stand_in)) for f in fields]
    else:
        held = F.replace(value, F.lit(escape + escape), F.lit(_HELD)) if escape else value
        guard = f"(?<!{re.escape(escape)})" if escape else ""
        row = lines.select(*keep, F.split(held, guard + re.escape(sep), -1).alias("row"))
        fields = [F.get(F.col("row"), F.lit(i)) for i in range(len(columns))]
    return row.select(*keep, *[_plain(f, escape, bool(quote)).alias(c) for f, c in zip(fields, columns)])


def well_formed(columns: int, sep: str = ",", quote: str | None = None, escape: str = "\\") -> Column:
    """Whether a line (column ``value``) has just ``columns`` fields, and quotes that close and
    are followed by a separator or the end."""
    mark, one = re.escape(sep), len(sep) == 1
    if quote:
        inner = f"{re.escape(quote)}[^{re.escape(quote)}]*+(?:{re.escape(quote * 2)}[^{re.escape(quote)}]*+)*+{re.escape(quote)}"
        bare = f"[^{re.escape(quote)}{mark}]*+" if one else f"(?:(?!{mark})[^{re.escape(quote)}])*+"
        field = f"(?:{inner}|{bare})"
    elif escape:
        plain = f"[^{re.escape(escape)}{mark}]*+" if one else f"(?:(?!{mark})[^{re.escape(escape)}])*+"
        field = f"{plain}(?:{re.escape(escape)}.{plain})*+"
    else:
        field = f"[^{mark}]*+" if one else f"(?:(?!{mark}).)*+"
    return F.col("value").rlike(f"(?s)^{field}(?:{mark}{field}){{{columns - 1}}}$")


def malformed_lines(lines: DataFrame, columns: int, sep: str = ",", quote: str | None = None,
                    escape: str = "\\") -> DataFrame:
    """The lines (column ``value``) that do not have just ``columns`` fields, or whose quotes
    do not close or are followed by more than a separator."""
    return lines.filter(~well_formed(columns, sep, quote, escape))


def _plain(field: Column, escape: str, quoted: bool) -> Column:
    if escape:
        if quoted:
            field = F.replace(field, F.lit(escape + escape), F.lit(_HELD))
        field = F.replace(F.replace(field, F.lit(escape), F.lit("")), F.lit(_HELD), F.lit(escape))
    return F.nullif(field, F.lit(""))


def read_fixed_width(lines: DataFrame, columns: Sequence[str], widths: Sequence[int],
                     keep: Sequence[str] = ()) -> DataFrame:
    """Cut each line at the cumulative widths and strip blanks."""
    fields, start = [], 1
    for name, width in zip(columns, widths, strict=True):
        text = F.trim(F.substring("value", start, width))
        fields.append(F.nullif(text, F.lit("")).alias(name))
        start += width
    return lines.select(*keep, *fields)


def normalise_delimiters(lines: DataFrame, sep: str = ",", quote: str | None = None,
                         escape: str = "\\") -> DataFrame:
    """Replace each unescaped separator by ``␟`` and drop each unescaped quote.

    A separator inside quotes still splits unless it is escaped.
    """
    guard = f"(?<!{re.escape(escape)})"
    value = F.regexp_replace("value", guard + re.escape(sep), UNIT_SEPARATOR)
    if quote:
        value = F.regexp_replace(value, guard + re.escape(quote), "")
    return lines.select(value.alias("value"))


def split_normalised(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of lines that :func:`normalise_delimiters` made."""
    parts = F.split("value", UNIT_SEPARATOR, -1)
    return lines.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])
