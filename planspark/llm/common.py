"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white space characters, as a set for ``btrim``/``translate`` and as a regex class.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def smallest_hashes(df: DataFrame, id: str, rows: int, slack: int = 4) -> DataFrame:
    """The ``rows`` rows with the smallest hashes of ``id``, a sample that is the same on every run.

    Rows are counted first, and only hashes in the range that holds ``slack``
    times the rows wanted take part in the sort, so what meets in one task is
    bounded by the sample and not by the number of partitions.
    """
    share = min(1.0, slack * rows / max(1, df.count()))
    low = F.shiftrightunsigned(F.xxhash64(id), 32) < F.lit(int(share * 2**32))
    return df.where(low).orderBy(F.shiftrightunsigned(F.xxhash64(id), 32), id).limit(rows)


def in_rows_of(docs: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``found`` (one row per key) to every row of ``docs``; null keys meet each other.

    ``found`` names its keys as ``docs`` does; its other columns must not clash.
    """
    other = found.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    on = None
    for k in keys:
        one = docs[k].eqNullSafe(other[f"_on_{k}"])
        on = one if on is None else on & one
    return docs.join(other, on, "left").drop(*[f"_on_{k}" for k in keys])
