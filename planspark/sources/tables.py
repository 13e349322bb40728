"""Relational tables: tasks, users, drawings, results (parquet or JDBC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_COLUMNS = (
    "task_id string, user_id string, task_name string, task_type string, status string,"
    " create_time string, process_time string, drawing_name string"
)
USER_COLUMNS = "user_id string, user_name string, password string, create_time string"
DRAWING_COLUMNS = "file_id string, file_name string, file_hash string, user_id string, create_time string"
RESULT_COLUMNS = "task_id string, kind string, content string"


def conform(df: DataFrame, columns: str) -> DataFrame:
    """Give a table the named columns; missing ones become null, types stay as read."""
    names = [c.split()[0] for c in columns.split(", ")]
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def read_parquet(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(columns).parquet(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric key; filters are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for name, value in {"partitionColumn": key, "lowerBound": low, "upperBound": high, "numPartitions": parts, **options}.items():
        reader = reader.option(name, value)
    return reader.load()
