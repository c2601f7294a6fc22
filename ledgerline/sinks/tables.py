"""Table loads: truncate, append, merge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.functions.lines import all_of
from ledgerline.operators.skew import fits_broadcast, split_join
from ledgerline.session import stage
from ledgerline.sources.tables import JdbcTable

LOAD_TYPES = ("truncate_and_load", "append_load", "merge_and_load")


class DuplicateKeyError(ValueError):
    """Rows that must have one row per key repeat a key."""


def aligned(target: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the columns and types of ``target``."""
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target.schema.fields])


def clone_structure(target: DataFrame) -> DataFrame:
    """No rows, the columns of ``target``."""
    return target.limit(0)


def truncate_and_load(target: DataFrame, rows: DataFrame) -> DataFrame:
    return clone_structure(target).unionByName(aligned(target, rows))


def append_load(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(aligned(target, rows))


def merge_and_load(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched target rows take the non-key values of ``rows``; unmatched rows are
    added. With key columns only, nothing is updated.

    One aggregate checks that ``rows`` has one row per key and counts it. A small
    batch is broadcast and the target is not shuffled at all. For a large one the
    join is split where the target repeats a key often, and the keys of the target
    are combined to one row each before the anti join.
    """
    keys = list(keys)
    rows = aligned(target, rows)
    shape = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"), F.max("n").alias("most")
    ).first()
    if (shape["most"] or 0) > 1:
        raise DuplicateKeyError(f"the merged rows repeat a key of {keys} up to {shape['most']} times")
    small = fits_broadcast(rows, shape["rows"] or 0)
    others = [c for c in target.columns if c not in keys]
    if others:
        incoming = rows.select(*keys, F.struct(*others).alias("_new"), F.lit(True).alias("_hit"))
        joined = target.join(F.broadcast(incoming), keys, "left") if small else split_join(target, incoming, keys, "left")
        updated = joined.select(*[
            F.col(c) if c in keys
            else F.when(F.col("_hit"), F.col("_new").getField(c)).otherwise(F.col(c)).alias(c)
            for c in target.columns
        ])
    else:
        updated = target
    known = target.select(*keys)
    if small:
        known = known.join(F.broadcast(rows.select(*keys)), keys, "left_semi").distinct()
        inserted = rows.join(F.broadcast(known), keys, "left_anti")
    else:
        inserted = rows.join(known.distinct(), keys, "left_anti")
    return updated.unionByName(inserted.select(*target.columns))


def load_table(spark: SparkSession, path: str, rows: DataFrame, load_type: str,
               keys: Sequence[str] = ()) -> DataFrame:
    """Load ``rows`` into the Parquet table at ``path`` and return the table.

    A merge reads the table it replaces, so its result is staged in the shared
    folder first; the staged copy also survives a write that fails half way.
    """
    target = spark.read.parquet(path)
    if load_type == "append_load":
        aligned(target, rows).write.mode("append").parquet(path)
    elif load_type == "truncate_and_load":
        aligned(target, rows).write.mode("overwrite").parquet(path)
    elif load_type == "merge_and_load":
        stage(merge_and_load(target, rows, keys), "merge").write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"load type must be one of {LOAD_TYPES}, not {load_type!r}")
    return spark.read.parquet(path)


@dataclass(frozen=True)
class JdbcTarget:
    """A database table to load, written in parallel by ``connections`` tasks."""

    url: str
    table: str
    connections: int = 8
    batch_rows: int = 20_000
    properties: Mapping[str, str] = field(default_factory=dict)

    def options(self, load_type: str) -> dict[str, str]:
        options = {"url": self.url, "dbtable": self.table, "numPartitions": str(self.connections),
                   "batchsize": str(self.batch_rows), **self.properties}
        return options if load_type == "append_load" else {**options, "truncate": "true"}

    def load(self, rows: DataFrame, load_type: str, keys: Sequence[str] = ()) -> None:
        """Truncate keeps the table and its keys. A merge is made in Spark and staged,
        and then replaces the rows of the table."""
        if load_type not in LOAD_TYPES:
            raise ValueError(f"load type must be one of {LOAD_TYPES}, not {load_type!r}")
        if load_type == "merge_and_load":
            target = JdbcTable(self.url, self.table, properties=self.properties).read(rows.sparkSession)
            rows = stage(merge_and_load(target, rows, keys), "merge")
        mode = "append" if load_type == "append_load" else "overwrite"
        rows.write.format("jdbc").options(**self.options(load_type)).mode(mode).save()


def status_update(df: DataFrame, status: str, new_value: str, **equal: object) -> DataFrame:
    """Set ``status`` for the rows whose columns equal the given values."""
    chosen = all_of([F.col(name) == F.lit(value) for name, value in equal.items()])  # lit keeps a column as it is
    return df.withColumn(status, F.when(chosen, F.lit(new_value)).otherwise(F.col(status)))
