"""Text form of values, row keys and row hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Key separator and the texts that stand for a missing value.
KEY_SEPARATOR = "▼"
EMPTY_DATE = "1970-01-01"
EMPTY_DATETIME = "1970-01-01 09:00"
DROPPED_TEXT = "char(0)"

_FLOATS = (T.FloatType, T.DoubleType)
_TIMES = (T.TimestampType, T.TimestampNTZType)
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def value_text(column: Column, kind: T.DataType, scale: int | None = None) -> Column:
    """A value as text that tells it from every other value; NULL stays NULL.

    Floating point is the shortest text that reads back as the same number, times have
    all digits of their fraction. Only where ``scale`` is given, floating point is
    rounded to a decimal of so many digits.
    """
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, _FLOATS):
        # Zero has two signs, which are equal.
        whole = F.when(column == 0, F.lit("0.0")).otherwise(column.cast("string"))
        return whole if scale is None else F.coalesce(column.try_cast(f"decimal(38,{scale})").cast("string"), whole)
    return column.cast("string")


def cell_text(df: DataFrame, name: str, scale: int | None = None) -> Column:
    return value_text(F.col(f"`{name}`"), df.schema[name].dataType, scale)


def typed_text(df: DataFrame, name: str, scale: int | None = None) -> Column:
    """Type-aware text with the fixed stand-ins for missing values."""
    column, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.coalesce(column.cast("string"), F.lit(EMPTY_DATE))
    if isinstance(kind, _TIMES):
        return F.coalesce(F.replace(value_text(column, kind), F.lit(" "), F.lit("T")), F.lit(EMPTY_DATETIME))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.replace(column, F.lit(DROPPED_TEXT), F.lit("")), F.lit(""))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column.cast("int").cast("string"), F.lit("0"))
    if isinstance(kind, (*_FLOATS, *_INTEGERS, T.DecimalType)):
        return F.coalesce(value_text(column, kind, scale), F.lit("0"))
    return column.cast("string")


def key_text(df: DataFrame, keys: Sequence[str], separator: str = KEY_SEPARATOR, scale: int | None = None) -> Column:
    """Key columns joined to one text; NULL parts are left out."""
    return F.concat_ws(separator, *[cell_text(df, k, scale) for k in keys])


def row_md5(df: DataFrame, columns: Sequence[str], scale: int | None = None) -> Column:
    """md5 of the columns joined without a separator; NULL parts are left out."""
    return F.md5(F.concat_ws("", *[cell_text(df, c, scale) for c in columns]).cast("binary"))


def row_sha256(df: DataFrame, columns: Sequence[str], scale: int | None = None) -> Column:
    return F.sha2(F.concat_ws("", *[cell_text(df, c, scale) for c in columns]).cast("binary"), 256)


def typed_key(df: DataFrame, keys: Sequence[str], scale: int | None = None) -> Column:
    return F.concat_ws("", *[typed_text(df, k, scale) for k in keys])


def typed_hash(df: DataFrame, columns: Sequence[str], scale: int | None = None) -> Column:
    return F.md5(F.concat_ws("", *[typed_text(df, c, scale) for c in columns]).cast("binary"))


def _framed_part(text: Column) -> Column:
    """Length-prefixed text, ``-`` for NULL: no two different rows give one text."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def safe_key(df: DataFrame, keys: Sequence[str], scale: int | None = None) -> Column:
    return F.concat_ws("|", *[_framed_part(cell_text(df, k, scale)) for k in keys])


def safe_hash(df: DataFrame, columns: Sequence[str], scale: int | None = None) -> Column:
    joined = F.concat_ws("|", *[_framed_part(cell_text(df, c, scale)) for c in columns])
    return F.md5(joined.cast("binary"))


def sketch(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
           form: str = "compatible", scale: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Two columns per row: ``concatenated_keys`` and ``hash_value``; ``keep`` names more.

    ``compatible`` joins plain text, ``typed`` uses the type-aware text, ``safe``
    marks lengths and NULLs so that different rows cannot join to equal text.
    ``scale`` rounds floating point; without it no two values share a text.
    """
    columns = list(columns or df.columns)
    key_of, hash_of = {
        "compatible": (key_text, row_md5),
        "typed": (typed_key, typed_hash),
        "safe": (safe_key, safe_hash),
    }[form]
    return df.select(key_of(df, keys, scale=scale).alias("concatenated_keys"), hash_of(df, columns, scale).alias("hash_value"),
                     *keep)
