"""Make this package importable on executors that do not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source, zipped, along with the application's tasks, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    # The driver reads this file once; executors fetch it from the driver.
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp()}/{package.name}-source", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
