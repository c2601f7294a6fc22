"""The comparison report: one folder of rows per section."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.functions.rowtext import cell_text, key_text
from ledgerline.operators import compare as cmp
from ledgerline.operators.copies import differing_rows
from ledgerline.operators.quality import side_by_side
from ledgerline.operators.skew import fits_broadcast, key_presence_join
from ledgerline.session import stage

META, SUMMARY, PASSED, MISMATCHES, DUPLICATES = (
    "meta_info", "summary", "pass_record_summary", "mismatches", "duplicate_keys"
)

MISMATCH_COLUMNS = "column_name string, concatenated_keys string, left_value string, right_value string, absent_flag boolean"


def passed_sample(left: DataFrame, differing: DataFrame, keys: Sequence[str], rows: int = 10) -> DataFrame:
    """The first rows of ``left`` without a difference, one line per cell; both sides
    hold the same values there. Against many differences the first keys are found
    alone, and only their rows are fetched."""
    differing = differing.select(*keys)
    small = fits_broadcast(differing, differing.count())
    if small:
        passed = key_presence_join(left, differing, keys, "left_anti", small)
    else:
        free = key_presence_join(left.select(*keys).distinct(), differing, keys, "left_anti", unique=True)
        passed = key_presence_join(left, free.orderBy(*keys).limit(rows), keys, "left_semi", small=True)
    passed = passed.orderBy(*keys).limit(rows)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), cell_text(left, c).alias("value")) for c in left.columns])
    return passed.select(key_text(left, keys).alias("concatenated_keys"), F.explode(cells).alias("cell")).select(
        "cell.column_name", "concatenated_keys",
        F.col("cell.value").alias("left_value"), F.col("cell.value").alias("right_value"),
    )


def compare_report(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
                   meta: Mapping[str, str] | None = None, unique_keys: bool = False) -> dict[str, DataFrame]:
    """Sections of the report.

    Every section is made from the rows that differ, which are staged, and from
    plain row counts of the two tables. Where keys repeat, copies are compared one by one.
    """
    keys = list(keys)
    columns = list(columns or cmp.common_columns(left, right))
    columns = [*keys, *[c for c in columns if c not in keys]]
    left, right = cmp.same_types(left, right, columns)
    noted = cmp.align_differing(left, right, keys, columns, unique_keys)
    differing = noted.filter(F.col("status") != cmp.SAME) if unique_keys else differing_rows(left, right, noted, keys, columns)
    repeated = noted.filter((F.col("left_rows") > 1) | (F.col("right_rows") > 1))

    changed = differing.agg(F.count_if(F.col("status") == cmp.CHANGED).alias("changed"))
    summary = stage(cmp.summarise_differences(differing, left, right, keys, columns), "summary")
    shared = summary.agg((F.max("total_left") - F.max("extra_in_left")).alias("shared"))
    overall = [("OverallCommonCount", F.col("shared") - F.col("changed")),
               ("OverallCombinedMismatchCount", F.col("changed"))]
    counted = side_by_side(changed, shared).select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("config_name"), value.cast("string").alias("config_value"))
        for name, value in overall
    ])).alias("row")).select("row.*")
    given = left.sparkSession.createDataFrame(
        [(str(k), str(v)) for k, v in (meta or {}).items()], "config_name string, config_value string"
    )
    return {
        META: given.unionByName(counted),
        SUMMARY: cmp.flagged_summary(summary),
        PASSED: passed_sample(left, differing, keys),
        MISMATCHES: cmp.flagged_cells(cmp.difference_union(differing, keys)),
        DUPLICATES: repeated.select(key_text(noted, keys).alias("concatenated_keys"), "left_rows", "right_rows"),
    }


def write_report(sections: Mapping[str, DataFrame], path: str) -> str:
    """Write the sections; mismatches get one folder per column."""
    for name, rows in sections.items():
        writer = rows.write.partitionBy("column_name") if name == MISMATCHES else rows.write
        writer.parquet(f"{path}/{name}")
    return path


def read_report(spark: SparkSession, path: str, section: str) -> DataFrame:
    """One section; without any difference the mismatches have no file to take the
    columns from, so those are named."""
    reader = spark.read.schema(MISMATCH_COLUMNS) if section == MISMATCHES else spark.read
    return reader.parquet(f"{path}/{section}")
