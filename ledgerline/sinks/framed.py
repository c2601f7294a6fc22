"""Framed output: header lines, data lines, trailer lines, in that order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerline.functions.tokens import render

# Fixed value: the placeholder for column names in a header.
COLUMN_NAMES = "AUTOPOPULATECOLNAMES"

# Names under which the counts of the output can be used in header and trailer.
DATA_LINES, FILE_LINES = "DATALINECOUNT", "EXPECTEDFILELINECOUNT"


def fill_column_names(template: str, columns: Sequence[str], delimiter: str | None = None,
                      header_delimiter: str | None = None, header_quote: str = "") -> str:
    """Replace the placeholder by the column names of the output. The header's own
    delimiter comes first, then that of the file, then a comma."""
    sep = header_delimiter or delimiter or ","
    names = sep.join(f"{header_quote}{c}{header_quote}" for c in columns)
    return template.replace(COLUMN_NAMES, names)


def frame_output(lines: DataFrame, headers: Sequence[str] = (), trailers: Sequence[str] = (),
                 values: Mapping[str, object] | None = None) -> DataFrame:
    """``value`` rows: rendered headers, the data lines as they come, rendered trailers.

    A union keeps the order of its inputs and of their partitions, so writing the
    result gives part files that, in the order of their numbers, are the framed file; no line
    moves between tasks. The counts come from an aggregate of ``lines``, for which
    Spark prunes every column; give a staged input when it is costly to make.
    """
    counts = lines.agg(F.count(F.lit(1)).alias(DATA_LINES)).withColumn(
        FILE_LINES, F.col(DATA_LINES) + len(headers) + len(trailers)
    )
    known = {DATA_LINES: F.col(DATA_LINES), FILE_LINES: F.col(FILE_LINES), **(values or {})}

    def part(templates: Sequence[str]) -> DataFrame:
        rendered = F.array(*[render(t, known) for t in templates])
        return counts.select(F.explode(rendered).alias("value"))

    parts = [part(headers)] if headers else []
    parts.append(lines.select("value"))
    if trailers:
        parts.append(part(trailers))
    whole = parts[0]
    for following in parts[1:]:
        whole = whole.union(following)
    return whole


def write_lines(lines: DataFrame, path: str, single_file: bool = False) -> str:
    """Write ``value`` rows as text in their order. ``single_file`` sends all lines
    through one task; use it for small files that a receiver wants in one piece."""
    out = lines.coalesce(1) if single_file else lines
    out.select("value").write.text(path)
    return path
