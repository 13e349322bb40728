"""Numbering and running folds that survive a group of any size.

A window over one key sorts the whole key in one task. That is right where a
key's rows are few by nature (a pixel row, a node's edges, a page's boxes);
such callers leave ``bounded`` true. Orders without a key, and keys that may
hold any number of rows (a drawing, an owner of tasks), go another way at
every size: the rows are range-partitioned in (keys, order), each range is
numbered on its own, and the per-range totals, a table with one row per (key,
range), are carried forward. Both ways give the same result; which one runs is
stated by the caller and never depends on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planspark.session import cut, shuffled

_CHUNK = "__chunk"


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition by (keys, order) and name each row's range in ``__chunk``.

    The ranges are written out before use: their limits come from a sample,
    so a recomputed range could differ from the one already counted.
    """
    columns = [F.col(k) for k in keys] + list(order)
    ranged = df.repartitionByRange(*columns).withColumn(_CHUNK, F.spark_partition_id())
    return cut(ranged)


def _window(keys: Sequence[str], order: Sequence[Column], chunk: bool):
    parts = [*keys, _CHUNK] if chunk else list(keys)
    base = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    return base.orderBy(*order)


def _carry(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], fold) -> DataFrame:
    """Per (key, chunk): the fold of the aggregates of all earlier chunks."""
    per_chunk = df.groupBy(*keys, _CHUNK).agg(*[c.alias(n) for n, c in aggregates.items()])
    base = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = base.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(
        *keys, _CHUNK, *[fold(F.col(n)).over(earlier).alias(f"__carry_{n}") for n in aggregates]
    )


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rn",
    bounded: bool | None = None,
) -> DataFrame:
    """Add ``name``: 1, 2, ... within ``keys`` in ``order`` (a total order).

    ``bounded``: the rows of a key are few by nature; by default so if there is a key.
    """
    if bounded or (bounded is None and keys):
        return df.withColumn(name, F.row_number().over(_window(keys, order, False)).cast("long"))
    rows = chunked(df, keys, order)
    carry = _carry(rows, keys, {"n": F.count(F.lit(1))}, F.sum)
    local = rows.withColumn(name, F.row_number().over(_window(keys, order, True)))
    return (
        local.join(shuffled(carry), [*keys, _CHUNK])
        .withColumn(name, (F.col(name) + F.coalesce("__carry_n", F.lit(0))).cast("long"))
        .drop("__carry_n", _CHUNK)
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    lo: str,
    hi: str,
    tiebreak: Sequence[str] = (),
    name: str = "island",
    bounded: bool | None = None,
) -> DataFrame:
    """Number the groups of intervals that touch or overlap within ``keys``.

    A new island starts where ``lo`` is beyond the largest ``hi`` seen so far.
    """
    order = [F.col(lo), F.col(hi), *[F.col(c) for c in tiebreak]]
    large = not (keys if bounded is None else bounded)
    rows = chunked(df, keys, order) if large else df
    window = _window(keys, order, large)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__reach", F.max(hi).over(before))
    if large:
        carry = _carry(rows, keys, {"reach": F.max(hi)}, F.max)
        rows = rows.join(shuffled(carry), [*keys, _CHUNK]).withColumn(
            "__reach", F.greatest("__reach", "__carry_reach")
        )
    starts = F.when(F.col("__reach") >= F.col(lo), 0).otherwise(1)
    rows = rows.withColumn("__start", starts)
    # equal intervals may come in any order, so the one that starts goes first
    counted = _window(keys, [*order, F.col("__start").desc()], large)
    rows = rows.withColumn(
        name, F.sum("__start").over(counted.rowsBetween(Window.unboundedPreceding, 0))
    )
    if large:
        carry = _carry(rows.drop("__carry_reach"), keys, {"island": F.sum("__start")}, F.sum)
        rows = rows.join(shuffled(carry), [*keys, _CHUNK]).withColumn(
            name, F.col(name) + F.coalesce("__carry_island", F.lit(0))
        )
    return rows.drop("__reach", "__start", "__carry_reach", "__carry_island", _CHUNK)


def carried_header(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    bounded: bool | None = None,
) -> DataFrame:
    """Carry the latest non-null ``value`` down the rows of each group."""
    df = df.withColumn("__value", value)
    large = not (keys if bounded is None else bounded)
    rows = chunked(df, keys, order) if large else df
    upto = _window(keys, order, large).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.last("__value", ignorenulls=True).over(upto))
    if large:
        latest = F.max_by(
            "__value", F.when(F.col("__value").isNotNull(), F.struct(*order))
        )
        carry = _carry(rows, keys, {"value": latest}, lambda c: F.last(c, ignorenulls=True))
        rows = rows.join(shuffled(carry), [*keys, _CHUNK]).withColumn(
            name, F.coalesce(F.col(name), F.col("__carry_value"))
        )
    return rows.drop("__value", "__carry_value", _CHUNK)
