"""Records whose quoted fields hold newlines, in files that are read in blocks.

Whether a newline ends a record depends on the quotes before it, back to the start of the
file. A line with an even number of quote characters keeps the state (outside or inside a
quoted field), one with an odd number turns it, so a block's effect on the state is one bit,
and the states at all block starts are a running sum over the small table of blocks.

The first pass counts, per block, the lines, the parity of their quotes, and the last place
where a record would start if the block began outside a quote and if it began inside one.
Lines of the frame are not records and must not turn the state; as a block does not know yet
which of its lines are frame lines, it reports its figures with each number of first and last
lines left out, at most as many as the frame has. The second pass knows each block's state
and cuts the records. Those within one block are made where they lie; only the pieces of
records that cross a block's border are shuffled, to be joined in the order of the blocks.

Texts pass through Arrow batches, as a running state over a block cannot be told in column
expressions without a shuffle of all lines. A task holds a batch and the record it is in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerline.operators.skew import broadcast_if_small
from ledgerline.session import stage
from ledgerline.sources.framed import MOVED_BLOCKS, in_order, plain_line, raw_lines
from ledgerline.sources.records import read_delimited

_BLOCK = ("unit string, _file string, _block long, _lines long, _head array<int>, _tail array<int>, "
          "_last_outside array<long>, _last_inside array<long>")


def _turns(values: pa.Array, quote: str) -> np.ndarray:
    """For each line whether it turns the state."""
    return pc.fill_null(pc.count_substring(values, quote), 0).to_numpy(zero_copy_only=False).astype(np.int64) & 1


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, str, int], pa.RecordBatch]]:
    """The parts of a batch that lie in one block each, with unit, file and block."""
    file = pc.dictionary_encode(batch.column("_file")).indices.to_numpy(zero_copy_only=False)
    block = batch.column("_block").to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
        if end > start:
            part = batch.slice(start, end - start)
            yield (part.column("unit")[0].as_py(), part.column("_file")[0].as_py(), int(block[start])), part


class _Block:
    """Figures of one block, line by line. ``ends`` are those of the block without its last
    lines: parity and the last starts, for the newest ``n_tail + 1`` line ends."""

    def __init__(self, name: tuple[str, str, int], n_head: int, n_tail: int):
        self.name, self.n_head, self.keep = name, n_head, n_tail + 1
        self.lines, self.head = 0, [0]
        self.ends = np.array([[0, -1, -1]], np.int64)

    def add(self, turns: np.ndarray) -> None:
        if len(self.head) <= self.n_head:
            more = (self.head[-1] + np.cumsum(turns[:self.n_head + 1 - len(self.head)])) & 1
            self.head += more.tolist()
        parity, outside, inside = self.ends[-1]
        after = (parity + np.cumsum(turns)) & 1
        before = np.concatenate(([parity], after[:-1]))
        at = np.arange(self.lines, self.lines + len(turns))
        starts = [np.maximum(last, np.maximum.accumulate(np.where(before == state, at, -1)))
                  for last, state in ((outside, 0), (inside, 1))]
        self.ends = np.concatenate([self.ends, np.stack([after, *starts], axis=1)])[-self.keep:]
        self.lines += len(turns)

    def row(self) -> tuple:
        newest = self.ends[::-1]
        return (*self.name, self.lines, self.head, newest[:, 0].tolist(), newest[:, 1].tolist(), newest[:, 2].tolist())


def _counted(quote: str, n_head: int, n_tail: int):
    names = [f.strip().split()[0] for f in _BLOCK.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()),
             pa.list_(pa.int64()), pa.list_(pa.int64())]

    def out(block: _Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block.row(), kinds)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for name, part in _stretches(batch):
                if block is None or block.name != name:
                    if block is not None:
                        yield out(block)
                    block = _Block(name, n_head, n_tail)
                block.add(_turns(part.column("value"), quote))
        if block is not None:
            yield out(block)

    return count


def _clamped(number: Column, most: Column) -> Column:
    return F.least(F.greatest(number, F.lit(0)), most).cast("int")


def _composed(blocks: DataFrame, n_head: int, n_tail: int) -> DataFrame:
    """Per block: its offset, the frame lines at its start and end, ``_state`` (that of its
    first line if the frame's quotes counted), whether it begins and ends inside a quoted
    field, and the line where the record that runs into it starts."""
    whole = Window.partitionBy("unit")
    before = whole.orderBy(*in_order()).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(
        "*", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_offset"), F.sum("_lines").over(whole).alias("_total"))
    data_end = F.col("_total") - n_tail
    framed = placed.withColumn("_skip", _clamped(n_head - F.col("_offset"), F.col("_lines"))).withColumn(
        "_drop", _clamped(F.col("_offset") + F.col("_lines") - data_end, F.col("_lines")))
    has_data = F.col("_skip") + F.col("_drop") < F.col("_lines")
    head = F.get("_head", F.col("_skip"))
    turned = F.when(has_data, (head + F.get("_tail", F.col("_drop"))) % 2).otherwise(0)
    stated = framed.withColumn("_turned", turned).withColumn(
        "_begins", (F.coalesce(F.sum("_turned").over(before), F.lit(0)) % 2).cast("int")).withColumn(
        "_state", (F.col("_begins") + head) % 2)
    last = F.when(F.col("_state") == 0, F.get("_last_outside", F.col("_drop"))).otherwise(F.get("_last_inside", F.col("_drop")))
    started = F.when(has_data & (last >= F.col("_skip")), F.col("_offset") + last + 1)
    return stated.withColumn("_started", started).select(
        "unit", "_file", "_block", "_lines", "_offset", "_total", "_skip", "_drop", "_state", "_begins",
        ((F.col("_begins") + F.col("_turned")) % 2).alias("_ends"),
        F.last("_started", ignorenulls=True).over(before).alias("_open"))


_PIECE = "unit string, line_no long, part long, lines long, value string"


def _cut(quote: str, borders: bool):
    """Records within one block or, for ``borders``, the pieces of those that cross borders."""
    names = [f.strip().split()[0] for f in _PIECE.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, seen, held = None, 0, None
        for batch in batches:
            found: list[tuple] = []
            for this, part in _stretches(batch):
                offset, lines, skip, drop, first, begins, opened = (
                    part.column(c)[0].as_py() for c in ("_offset", "_lines", "_skip", "_drop", "_state", "_begins", "_open"))
                if offset is None:
                    raise RuntimeError(MOVED_BLOCKS)
                if this != name:
                    if name is not None and seen != expected:
                        raise RuntimeError(MOVED_BLOCKS)
                    name, seen, state, expected = this, 0, first, lines
                    held = [opened, True, []] if begins else None  # line, begun before, lines
                turns = _turns(part.column("value"), quote)
                after = (state + np.cumsum(turns)) & 1
                before = np.concatenate(([state], after[:-1]))
                state = int(after[-1])
                low, high = max(skip - seen, 0), min(max(lines - drop - seen, 0), part.num_rows)
                values = part.column("value").to_pylist()
                for n in range(low, high):
                    if before[n] == 0:
                        held = [offset + seen + n + 1, False, []]
                    held[2].append(values[n])
                    if after[n] == 0:
                        if held[1] == borders:
                            found.append((this[0], held[0], offset, len(held[2]), "\n".join(held[2])))
                        held = None
                seen += part.num_rows
                if seen > lines:
                    raise RuntimeError(MOVED_BLOCKS)
                if seen == lines and held is not None:  # the record goes on in the next block
                    if borders and held[2]:
                        found.append((this[0], held[0], offset, len(held[2]), "\n".join(held[2])))
                    held = None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
        if name is not None and seen != expected:
            raise RuntimeError(MOVED_BLOCKS)

    return cut


def read_records(spark: SparkSession, path: str | Sequence[str], quote: str = '"', n_head: int = 0, n_tail: int = 0,
                 unit: str = "file") -> DataFrame:
    """``unit, line_no, lines, value``: the records between ``n_head`` header and ``n_tail``
    trailer lines, with the number of their first line and of their lines.

    Fields that hold a newline or a quote are quoted, and inner quotes are doubled, as
    :func:`~ledgerline.sinks.records.delimited_lines` writes them. A quote that never closes
    takes the rest of its unit into one record, which the check for malformed records names.
    Line ends inside a record stay as they are."""
    if not quote:
        raise ValueError("records over several lines need a quote character")
    source = raw_lines(spark, path, unit)
    columns = source.select("value", "unit", "_file", "_block")
    counted = stage(columns.mapInArrow(_counted(quote, n_head, n_tail), _BLOCK), "block-states")
    blocks = stage(_composed(counted, n_head, n_tail), "blocks")
    crossing = (F.col("_begins") == 1) | (F.col("_ends") == 1)
    placed = columns.join(broadcast_if_small(blocks.drop("unit")), ["_file", "_block"], "left")
    names = ["value", "unit", "_file", "_block", "_offset", "_lines", "_skip", "_drop", "_state", "_begins", "_open"]
    records = placed.select(*names).mapInArrow(_cut(quote, False), _PIECE).drop("part")
    if blocks.where(crossing).limit(1).count():
        pieces = placed.where(crossing | F.col("_offset").isNull()).select(*names).mapInArrow(_cut(quote, True), _PIECE)
        joined = pieces.groupBy("unit", "line_no").agg(
            F.sort_array(F.collect_list(F.struct("part", "value"))).alias("parts"), F.sum("lines").alias("lines"))
        records = records.unionByName(joined.select(
            "unit", "line_no", "lines", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")))
    return records.select("unit", "line_no", "lines", plain_line(F.col("value")).alias("value"))


def read_delimited_multiline(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = ",",
                             quote: str = '"', escape: str = "\\", n_head: int = 0, n_tail: int = 0,
                             unit: str = "file", keep: Sequence[str] = ()) -> DataFrame:
    """Records of files whose quoted fields may hold newlines, as text columns; ``keep`` may
    name ``unit``, ``line_no`` and ``lines``."""
    records = read_records(spark, path, quote, n_head, n_tail, unit)
    return read_delimited(records, columns, sep, quote, escape, keep, newlines=True)
