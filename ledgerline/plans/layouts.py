"""Definitions that a job takes: the layout of a file and of a comparison."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

DELIMITED, FIXED_WIDTH = "delimited", "fixed_width"


@dataclass(frozen=True)
class FileLayout:
    """Records and frame of a file. ``unit`` says whether each file or each folder of
    part files carries one frame; ``multiline`` that quoted fields may hold newlines."""

    columns: Sequence[str]
    kind: str = DELIMITED
    delimiter: str = ","
    quote: str | None = None
    escape: str = "\\"
    widths: Sequence[int] = ()
    alignments: Sequence[str] = ()
    headers: Sequence[str] = ()
    trailers: Sequence[str] = ()
    header_delimiter: str | None = None
    header_quote: str = ""
    ignore: str | None = None
    validate: bool = False
    unit: str = "folder"
    multiline: bool = False

    def __post_init__(self) -> None:
        if self.multiline and not (self.kind == DELIMITED and self.quote):
            raise ValueError("records over several lines are delimited and quoted")
        if self.kind not in (DELIMITED, FIXED_WIDTH):
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.kind == FIXED_WIDTH and not len(self.columns) == len(self.widths) == len(self.alignments):
            raise ValueError("a fixed-width layout needs a width and an alignment for each column")

    @property
    def frame(self) -> tuple[int, int]:
        return len(self.headers), len(self.trailers)


@dataclass(frozen=True)
class Slice:
    """Rows of one day of a column; ``choice`` is Batch, Current or Custom."""

    column: str
    date_format: str = "YYYY-MM-DD"
    choice: str = "Batch"
    custom: dt.date | None = None


@dataclass(frozen=True)
class Side:
    """One side of a comparison: a predicate, a slice, and keys declared for it."""

    where: str | None = None
    slice: Slice | None = None
    keys: Sequence[str] = ()
    trailer_label: str = ""


@dataclass(frozen=True)
class CompareSpec:
    name: str
    keys: Sequence[str]
    exclude: Sequence[str] = ()
    left: Side = field(default_factory=Side)
    right: Side = field(default_factory=Side)
    batch_date: dt.date | None = None
    strict: bool = False
    meta: Mapping[str, str] = field(default_factory=dict)
