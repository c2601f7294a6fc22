"""Newest rows of each group of a stream, kept in Spark's state store.

Each task first reduces its new rows to the newest of every group, so a group that holds most
of the rows sends at most one page per task. The state of a group is its page; new rows are
merged into it, and the whole page is emitted whenever it has changed. No page that was
written before is read again, also not after a restart: the checkpoint has the state.

A group is open until the time in ``closes``, which is the same for all of its rows. Once the
watermark (the largest ``closes`` seen, less ``delay``) has passed it, its state is dropped, and
rows of it that come later are left out as a whole; they cannot make a part of a page.

Defined results: null is a group like any other; null sorts last in descending order and first
in ascending, as in Spark; rows with equal values in all of ``by`` stay in any order, so
``by`` should end in a key; a stream without rows emits nothing; a null in ``closes`` raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerline.streaming.arrivals import finished_numbers

HELD_ROWS = 200_000  # rows of many groups that a task holds before it sends them on


def newest_rows(stream: DataFrame, group: str, closes: str, by: Sequence[str], size: int, descending: bool = True,
                delay: str = "1 day") -> DataFrame:
    """The pages of the groups that changed in each micro-batch: columns of ``stream``, at most
    ``size`` rows per group by ``by``. Use it with output mode ``update``."""
    direction, nulls = ("descending", "at_end") if descending else ("ascending", "at_start")
    sort_by, held_rows, schema = list(by), HELD_ROWS, stream.schema

    # Nested, with their own imports: they are sent to the workers by value.
    def best(table):
        """The first ``size`` rows of each group, groups together."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.combine_chunks()
        codes = pc.dictionary_encode(table.column(group), null_encoding="encode").combine_chunks()
        codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
        names = [str(n) for n in range(len(sort_by) + 1)]
        ordered = pa.table([codes.indices, *[table.column(c) for c in sort_by]], names=names)
        order = pc.sort_indices(ordered, sort_keys=[("0", "ascending"), *[(n, direction) for n in names[1:]]],
                                null_placement=nulls).to_numpy()
        code = codes.indices.to_numpy(zero_copy_only=False)[order]
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        rank = np.arange(len(code)) - np.repeat(edge, np.diff(np.append(edge, len(code))))
        keep = rank < size
        table, code = table.take(pa.array(order[keep])), code[keep]
        return table, np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))

    def packed(table):
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def read(blob):
        import pyarrow as pa

        return pa.ipc.open_stream(blob).read_all()

    def reduce(batches):
        import pyarrow as pa

        def sent(table, edges):
            parts = [table.slice(a, b - a) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([p.column(group).slice(0, 1).combine_chunks() for p in parts]),
                pa.concat_arrays([p.column(closes).slice(0, 1).combine_chunks() for p in parts]),
                pa.array([packed(p) for p in parts], pa.binary())], names=["group", "closes", "rows"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held, edges = best(new if held is None else pa.concat_tables([held, new]))
            if held.num_rows > held_rows:
                yield sent(held, edges)
                held = None
        if held is not None:
            yield sent(held, edges)

    def merge(key, frames, state):
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        if state.hasTimedOut:
            state.remove()
            return
        blobs = [bytes(state.get[0])] if state.exists else []
        for frame in frames:
            blobs += frame["rows"].tolist()
        page, _ = best(pa.concat_tables([read(blob) for blob in blobs]))
        blob = packed(page)
        state.update((blob,))
        end = pc.max(page.column(closes).cast(pa.timestamp("ms"), safe=False)).cast(pa.int64()).as_py()
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"rows": [blob]})

    def unpacked(batches):
        for batch in batches:
            for blob in batch.column("rows").to_pylist():
                yield from read(blob).to_batches()

    told = F.raise_error(F.lit(f"{closes} is null: no end of its group is known")).cast("timestamp")
    ready = stream.withColumn(closes, F.coalesce(F.col(f"`{closes}`").cast("timestamp"), told))
    kind = T.StructType([T.StructField("group", schema[group].dataType), T.StructField("closes", T.TimestampType()),
                         T.StructField("rows", T.BinaryType())])
    pages = ready.mapInArrow(reduce, kind).withWatermark("closes", delay).groupBy("group").applyInPandasWithState(
        merge, "rows binary", "rows binary", "update", "EventTimeTimeout")
    return pages.mapInArrow(unpacked, ready.schema)


def write_pages(pages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the pages that changed to ``target/emitted=<batch>``; a batch that is run again
    overwrites its own folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/emitted={number}")

    return (pages.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def kept_page(spark: SparkSession, target: str, schema: T.StructType, group: str, value: object) -> DataFrame:
    """The page of one group that was emitted last, of the batches that are whole."""
    numbers = finished_numbers(spark, target, "emitted")
    if not numbers:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("emitted", T.LongType())])
    emitted = spark.read.schema(whole).parquet(target).filter(F.col("emitted") <= numbers[0])
    own = emitted.filter(F.col(f"`{group}`").eqNullSafe(F.lit(value)))
    last = own.agg(F.max("emitted")).first()[0]
    return own.filter(F.col("emitted") == F.lit(last)).drop("emitted")
