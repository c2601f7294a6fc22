"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Else each Column call notes its place in the Python source, which makes the
    # plans of wide tables slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "ledgerline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the jobs rely on.

    ``settings`` uses ``__`` for dots: ``spark__sql__shuffle__partitions="8"``.
    On a cluster pass those of :func:`sized_for` for the largest shuffle.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def sized_for(shuffled_bytes: int, partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Settings for ``build_session`` when about ``shuffled_bytes`` go through one shuffle.

    AQE joins small shuffle partitions but cannot split large ones outside a join,
    so the first number must fit the largest shuffle; the advisory size then sets
    how much a task takes.
    """
    partitions = max(-(-shuffled_bytes // partition_bytes), 200)
    return {
        "spark__sql__adaptive__coalescePartitions__initialPartitionNum": str(partitions),
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": str(partition_bytes),
    }


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    has none gets a temporary folder; a cluster without one is an error, because
    a folder of one machine is lost with that machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/ledgerline/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return it as a scan, so that later passes read the
    same rows and do not repeat the work that made them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
