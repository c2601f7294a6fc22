"""Tables, query results, sketches, JSON posts and date series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class JdbcTable:
    """A database table read in parallel: bounds on a number or date column, or
    one predicate per task where the values of one column are too uneven."""

    url: str
    table: str
    column: str | None = None
    lower: str | None = None
    upper: str | None = None
    partitions: int = 1
    predicates: Sequence[str] = ()
    fetch_rows: int = 10_000
    properties: Mapping[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        options = {"url": self.url, "dbtable": self.table, "fetchsize": str(self.fetch_rows), **self.properties}
        if self.column:
            if self.lower is None or self.upper is None:
                raise ValueError("a partition column needs its lower and upper bound")
            options |= {"partitionColumn": self.column, "lowerBound": str(self.lower),
                        "upperBound": str(self.upper), "numPartitions": str(self.partitions)}
        return options

    def read(self, spark: SparkSession) -> DataFrame:
        if self.predicates:
            rest = {"fetchsize": str(self.fetch_rows), **self.properties}
            return spark.read.jdbc(self.url, self.table, predicates=list(self.predicates), properties=rest)
        return spark.read.format("jdbc").options(**self.options()).load()


def extract_table(spark: SparkSession, source: JdbcTable | str) -> DataFrame:
    """A whole table: JDBC, a Parquet path or a catalog name."""
    if isinstance(source, JdbcTable):
        return source.read(spark)
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def extract_query(spark: SparkSession, query: str, views: Mapping[str, DataFrame] | None = None,
                  url: str | None = None, properties: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a SQL query, in a database when ``url`` is given, else over Spark
    views; ``views`` are passed by name and not registered in the session."""
    if url:
        return (spark.read.format("jdbc").option("url", url).option("query", query)
                .options(**(properties or {})).load())
    return spark.sql(query, **(views or {}))


def scan_sketch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("concatenated_keys", "hash_value")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


POST = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
])


def one_line(text: Column) -> Column:
    """Each newline becomes a blank."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def posts(json_text: DataFrame, column: str = "value", schema: T.StructType = POST) -> DataFrame:
    """JSON objects (one per row) to rows, newlines in ``body`` turned to blanks."""
    rows = json_text.select(F.from_json(column, schema).alias("row")).select("row.*")
    return rows.withColumn("body", one_line(F.col("body"))) if "body" in rows.columns else rows


def read_posts(spark: SparkSession, path: str, schema: T.StructType = POST) -> DataFrame:
    """Files that hold a JSON list each."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.withColumn("body", one_line(F.col("body")))


def date_series(bounds: DataFrame, first: str = "first_day", last: str = "last_day",
                name: str = "day") -> DataFrame:
    """All days from ``first`` to ``last`` of each row, both included."""
    days = F.sequence(F.to_date(first), F.to_date(last), F.expr("interval 1 day"))
    return bounds.select(F.explode(days).alias(name))
