"""Files that arrive in a folder, and a page that is kept up to date with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def arriving_rows(spark: SparkSession, folder: str, schema: T.StructType, name_glob: str = "*",
                  files_per_batch: int | None = None) -> DataFrame:
    """Rows of Parquet files as they arrive in ``folder`` (or folders: a glob)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def arriving_lines(spark: SparkSession, folder: str, name_glob: str = "*") -> DataFrame:
    return spark.readStream.option("pathGlobFilter", name_glob).text(folder).select(
        "value", F.col("_metadata.file_path").alias("file")
    )


def ingest(stream: DataFrame, target: str, checkpoint: str,
           handle: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Process each new file once and write its rows below ``target``.

    Each batch overwrites a folder with its own number, so a batch that is run
    again after a failure leaves the same rows.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = handle(batch) if handle else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def refresh_page(stream: DataFrame, make_page: Callable[[DataFrame], DataFrame], target: str,
                 checkpoint: str) -> StreamingQuery:
    """Keep the latest page of a growing table at ``target/page=<batch>``.

    ``make_page`` reduces rows to a page and keeps their columns. The next page is
    made from the last page and the new rows only, so a refresh does not read the
    table again.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/page={number - 1}"))
        make_page(rows).write.mode("overwrite").parquet(f"{target}/page={number}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def finished_numbers(spark: SparkSession, target: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix>=<number>`` in ``target`` up to the last whole one, newest
    first. Batches are written one after another, so only the newest can be half-written; a
    whole one has a ``_SUCCESS`` file. No folder is listed but ``target``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(target)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    numbers = sorted((int(n.partition("=")[2]) for n in names if n.startswith(f"{prefix}=")), reverse=True)
    while numbers and not system.exists(path(f"{target}/{prefix}={numbers[0]}/_SUCCESS")):
        numbers.pop(0)
    return numbers


def latest_page(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The whole page written last; empty where none is."""
    numbers = finished_numbers(spark, target, "page")
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{target}/page={numbers[0]}")
