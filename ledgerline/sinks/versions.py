"""Parquet tables in versions, and merges that rewrite only the files they touch.

A table is a folder of data files and one list of files per version. The list holds the number
of rows and the bounds of the keys of each file, and is written as one file, so that a version
is there as a whole or not at all; readers take the newest one. Data files never change: a
merge adds files and a list, and whoever reads an older version goes on reading it. One writer
at a time may add a version; a second one that starts from the same version fails.

A merge looks at the bounds first, then reads only the key columns of the files whose bounds
meet the batch, to find those that hold a key of it. These are merged and written anew; all
other files keep their names. The names of the files pass through the driver, the rows do not.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerline.functions.lines import all_of
from ledgerline.operators.skew import key_presence_join
from ledgerline.session import stage
from ledgerline.sinks.tables import aligned, merge_and_load
from ledgerline.sources.framed import as_glob


def _version_folder(path: str, version: int) -> str:
    return f"{path}/versions/version={version}"


def _listed(spark: SparkSession, path: str) -> list[int]:
    """Versions whose list is complete, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    numbers = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [n for n in numbers if system.exists(done(f"{_version_folder(path, n)}/_SUCCESS"))]


def latest_version(spark: SparkSession, path: str) -> int:
    found = _listed(spark, path)
    if not found:
        raise ValueError(f"no version of a table at {path}")
    return found[-1]


def files_of(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``file, rows`` and, per key column, ``low_`` and ``high_`` of a version."""
    number = latest_version(spark, path) if version is None else version
    return spark.read.parquet(_version_folder(path, number))


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest if none is named."""
    names = [r["file"] for r in files_of(spark, path, version).select("file").collect()]
    schema = spark.read.parquet(f"{path}/schema").schema
    if not names:
        return spark.createDataFrame([], schema)
    return _opened(spark, names, schema)


def _opened(spark: SparkSession, names: Sequence[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*[as_glob(unquote(name)) for name in names])


def _bounds(keys: Sequence[str]) -> list[Column]:
    return [f(F.col(f"`{k}`")).alias(f"{name}_{k}") for k in keys for name, f in (("low", F.min), ("high", F.max))]


def _add_files(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Write new data files, in a folder of their own, and return their lines of the list."""
    spark, target = rows.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    rows.write.parquet(target)
    written = spark.read.schema(rows.schema).parquet(target)
    return written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *_bounds(keys))


def _publish(listed: DataFrame, path: str, version: int) -> None:
    # One file: it appears by one rename. A version that is there is an error, a folder that a
    # failed write has left is not.
    mode = "errorifexists" if version in _listed(listed.sparkSession, path) else "overwrite"
    listed.coalesce(1).write.mode(mode).parquet(_version_folder(path, version))


def create_table(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The first version of a table; ``keys`` are the columns whose bounds are kept."""
    spark = rows.sparkSession
    rows.limit(0).write.mode("errorifexists").parquet(f"{path}/schema")
    _publish(_add_files(rows, path, keys), path, 1)
    return read_version(spark, path, 1)


def _touched(spark: SparkSession, files: DataFrame, rows: DataFrame, keys: Sequence[str],
             schema: T.StructType) -> list[str]:
    """Files that hold a key of ``rows``, by bounds first and then by their key columns."""
    span = rows.agg(*_bounds(keys)).first().asDict()
    if any(v is None for v in span.values()):
        return []  # no row, or only rows without a key, which match nothing
    near = all_of([(F.col(f"`high_{k}`") >= F.lit(span[f"low_{k}"])) & (F.col(f"`low_{k}`") <= F.lit(span[f"high_{k}"]))
                   for k in keys])
    names = [r["file"] for r in files.where(near).select("file").collect()]
    if not names:
        return []
    stored = _opened(spark, names, schema).where(all_of([F.col(f"`{k}`").isNotNull() for k in keys]))
    held = stored.select(*[F.col(f"`{k}`") for k in keys], F.col("_metadata.file_path").alias("_file"))
    found = key_presence_join(held, rows.select(*[F.col(f"`{k}`") for k in keys]), keys, "left_semi")
    return [r["_file"] for r in found.select("_file").distinct().collect()]


def merge_touched_files(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`~ledgerline.sinks.tables.merge_and_load` into the newest version, as a new one;
    only files that hold a key of ``rows`` are written anew. Returns the new version."""
    keys, version = list(keys), latest_version(spark, path)
    files = files_of(spark, path, version)
    schema = spark.read.parquet(f"{path}/schema").schema
    nothing = spark.createDataFrame([], schema)
    rows = stage(aligned(nothing, rows), "merge-rows")
    names = _touched(spark, files, rows, keys, schema)
    target = _opened(spark, names, schema) if names else nothing
    added = _add_files(merge_and_load(target, rows, keys), path, keys)
    gone = spark.createDataFrame([(n,) for n in names], "file string")
    _publish(files.join(F.broadcast(gone), "file", "left_anti").unionByName(added), path, version + 1)
    return read_version(spark, path, version + 1)
