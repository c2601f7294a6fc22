"""Tokens ``¶name•type•format¶`` in file names, header lines and trailer lines."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from ledgerline.functions.lines import pad_cell

# The marks around a token and between its parts.
GROUP_MARK, PART_MARK = "¶", "•"

# The accepted date formats of a slice.
DATE_FORMATS = (
    "YYYY-MM-DD", "YYYYMMDD", "MM/DD/YYYY", "DD/MM/YYYY", "YYYY/MM/DD", "MM-DD-YYYY",
    "DD-MM-YYYY", "YYYY-DD-MM", "MM/DD/YY", "DD/MM/YY", "YY/MM/DD",
)

# Tokens that stand for the time of the job, unless a value is given.
CURRENT = ("CDATE", "CDATETIME", "CTIME")

_DATE_PARTS = {
    "YYYY": "yyyy", "YY": "yy", "MM": "MM", "M": "M", "DD": "dd", "D": "d",
    "HH": "HH", "H": "H", "hh": "hh", "h": "h", "mm": "mm", "m": "m", "ss": "ss", "s": "s", "A": "a",
}
_DATE_TOKEN = re.compile("|".join(sorted(_DATE_PARTS, key=len, reverse=True)) + "|[A-Za-z]|.")
_TOKEN = re.compile(f"{GROUP_MARK}([^{GROUP_MARK}{PART_MARK}]+){PART_MARK}"
                    f"([^{GROUP_MARK}{PART_MARK}]+){PART_MARK}([^{GROUP_MARK}]+){GROUP_MARK}")
_SPEC = re.compile(r"(?:(?P<fill>.)?(?P<align>[<>^]))?(?P<zero>0)?(?P<width>\d+)?"
                   r"(?:\.(?P<digits>\d+))?(?P<kind>[dfs])?")


def spark_date_pattern(text: str) -> str:
    """``YYYY-MM-DD`` style to the pattern letters of ``date_format``."""
    parts = []
    for token in _DATE_TOKEN.findall(text):
        if token in _DATE_PARTS:
            parts.append(_DATE_PARTS[token])
        elif token.isalpha():
            raise ValueError(f"unknown date letter {token!r} in {text!r}")
        else:
            parts.append("''" if token == "'" else token)
    return "".join(parts)


def format_value(value: Column, kind: str, spec: str) -> Column:
    """A value rendered by ``date``, ``int``, ``float`` or ``str`` and a format."""
    if kind == "date":
        return F.date_format(value, spark_date_pattern(spec))
    match = _SPEC.fullmatch(spec.strip() if kind != "str" else spec)
    if not match:
        raise ValueError(f"unknown format {spec!r}")
    width = int(match["width"] or 0)
    if kind == "int":
        text = F.format_string(f"%0{width}d" if match["zero"] and width else "%d", value.cast("bigint"))
    elif kind == "float":
        digits = match["digits"] or "6"
        flags = f"0{width}" if match["zero"] and width else ""
        text = F.format_string(f"%{flags}.{digits}f", value.cast("double"))
    elif kind == "str":
        text = value.cast("string")
        if match["digits"]:
            text = F.substring(text, 1, int(match["digits"]))
    else:
        raise ValueError(f"unknown token type {kind!r}")
    default = "<" if kind == "str" else ">"
    return pad_cell(text, width, match["align"] or default, match["fill"] or " ")


def _as_column(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def render(template: str, values: Mapping[str, object]) -> Column:
    """The template as one text expression; values may be columns or constants. ``CDATE``,
    ``CDATETIME`` and ``CTIME`` are the time of the query, in the session's zone."""
    parts, at = [], 0
    for match in _TOKEN.finditer(template):
        if match.start() > at:
            parts.append(F.lit(template[at:match.start()]))
        name, kind, spec = match.groups()
        value = F.current_timestamp() if name in CURRENT and name not in values else _as_column(values[name])
        parts.append(format_value(value, kind, spec))
        at = match.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def file_name(template: str, business_date: dt.date, extension: str = "", now: dt.datetime | None = None) -> str:
    """File name of a job on the driver; only date tokens of ``BDATE`` and of the current time
    occur there."""
    codes = {"yyyy": "%Y", "yy": "%y", "MM": "%m", "dd": "%d", "HH": "%H", "hh": "%I", "mm": "%M", "ss": "%S", "a": "%p"}
    any_code = re.compile("|".join(codes))

    def one(match: re.Match) -> str:
        if match[1] not in ("BDATE", *CURRENT) or match[2] != "date":
            raise ValueError(f"unknown file name token {match[0]!r}")
        moment = business_date if match[1] == "BDATE" else now or dt.datetime.now()
        return any_code.sub(lambda code: moment.strftime(codes[code[0]]), spark_date_pattern(match[3]))
    return _TOKEN.sub(one, template) + extension
