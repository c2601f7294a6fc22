"""A user step, named in a job as ``suite.steps.tag_segment``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tag_segment(df: DataFrame, segment: str) -> DataFrame:
    return df.select("c_custkey", F.upper("c_name").alias("c_name"),
                     (F.col("c_mktsegment") == segment).alias("in_segment"))
