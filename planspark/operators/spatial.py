"""Grid-bucketed spatial joins.

A theta join over geometry becomes an equi-join on (keys, cell): each box is
listed once per grid cell that it covers, and the exact test runs on pairs
that share a cell. A pair is emitted only in the cell that holds the lower
corner of the common part of both boxes, so no ``distinct`` is needed and the
cells of one crowded drawing spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.session import shuffled

BOX = ("x1", "y1", "x2", "y2")


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def cells(df: DataFrame, size: float, margin: float = 0.0, box: Sequence[str] = BOX) -> DataFrame:
    """One row per grid cell that the box, grown by ``margin``, covers."""
    x1, y1, x2, y2 = (F.col(c) for c in box)
    return df.withColumn(
        "__cx", F.explode(F.sequence(_cell(x1 - margin, size), _cell(x2 + margin, size)))
    ).withColumn(
        "__cy", F.explode(F.sequence(_cell(y1 - margin, size), _cell(y2 + margin, size)))
    )


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*[c if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def box_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    size: float,
    margin: float = 0.0,
    where: Column | None = None,
) -> DataFrame:
    """Pairs of boxes that come within ``margin`` on both axes.

    Columns other than ``keys`` get the prefixes ``a_`` and ``b_``; ``where``
    is a further condition on those names. Both sides carry x1, y1, x2, y2.
    """
    a = cells(prefixed(left, "a_", keys), size, margin, [f"a_{c}" for c in BOX])
    b = cells(prefixed(right, "b_", keys), size, 0.0, [f"b_{c}" for c in BOX])
    on = [*keys, "__cx", "__cy"]
    near = (
        (F.col("a_x1") - margin <= F.col("b_x2"))
        & (F.col("a_x2") + margin >= F.col("b_x1"))
        & (F.col("a_y1") - margin <= F.col("b_y2"))
        & (F.col("a_y2") + margin >= F.col("b_y1"))
    )
    owner = (
        F.col("__cx") == _cell(F.greatest(F.col("a_x1") - margin, F.col("b_x1")), size)
    ) & (F.col("__cy") == _cell(F.greatest(F.col("a_y1") - margin, F.col("b_y1")), size))
    test = near & owner if where is None else near & owner & where
    return a.join(shuffled(b), on).where(test).drop("__cx", "__cy")


def _key_hits(pairs: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    return pairs.select(*keys, *[F.col(f"a_{i}").alias(i) for i in ids])


def box_semi(left, right, keys, ids, size, margin=0.0, where=None) -> DataFrame:
    """Rows of ``left`` (identified by ``keys`` and ``ids``) that have a partner."""
    pairs = box_pairs(left, right, keys, size, margin, where)
    return left.join(shuffled(_key_hits(pairs, keys, ids)), [*keys, *ids], "left_semi")


def box_anti(left, right, keys, ids, size, margin=0.0, where=None) -> DataFrame:
    """Rows of ``left`` (identified by ``keys`` and ``ids``) without a partner."""
    pairs = box_pairs(left, right, keys, size, margin, where)
    return left.join(shuffled(_key_hits(pairs, keys, ids)), [*keys, *ids], "left_anti")


def point_box(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """A point table seen as boxes without extent."""
    return df.withColumns({"x1": F.col(x), "y1": F.col(y), "x2": F.col(x), "y2": F.col(y)})
