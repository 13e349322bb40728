"""Dictionary texts: key/value lines, catalogue sections, layer files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planspark.operators.ordering import carried_header


def keyed_lines(
    lines: DataFrame,
    keys: Sequence[str],
    pos: str,
    section_mark: str = "、",
    section_part: int = 2,
    key_mark: str = ": ",
    value_mark: str = ", ",
) -> DataFrame:
    """(keys, pos, section, key, values) of the lines that hold ``key_mark``.

    A line with ``section_mark`` starts a section, named by its
    ``section_part``-th part.
    """
    line = F.col("line")
    header = F.when(F.contains(line, F.lit(section_mark)), F.trim(F.split_part(line, F.lit(section_mark), F.lit(section_part))))
    rows = carried_header(lines, keys, [F.col(pos)], header, "section").where(F.contains(line, F.lit(key_mark)))
    tail = F.substr(line, F.locate(key_mark, line) + F.lit(len(key_mark)))
    return rows.select(
        *keys, pos, "section",
        F.split_part(line, F.lit(key_mark), F.lit(1)).alias("key"),
        F.split(tail, value_mark).alias("values"),
    )


def read_catalogue(spark, path: str) -> DataFrame:
    """Sections 'N、name' followed by 'key: v1, v2' lines, one dictionary per file."""
    lines = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")
    )
    return keyed_lines(lines.withColumn("line", F.trim("line")), ["file"], "pos")


def read_layer_classes(spark, path: str) -> DataFrame:
    """(file, rank, group, class): lines 'group：class、class'."""
    lines = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")
    )
    line = F.trim("line")
    return lines.where(F.contains(line, F.lit("："))).select(
        "file",
        F.split_part(line, F.lit("："), F.lit(1)).alias("group"),
        F.posexplode(F.split(F.split_part(line, F.lit("："), F.lit(2)), "、")).alias("rank", "class"),
    )
