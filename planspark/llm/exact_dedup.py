"""Exact deduplication by progressive refinement (operator 1).

Texts are equal when identical after deleting the six ASCII white space
characters. One scan keeps narrow rows only: length of the normalised text,
hash of its prefix, code points of the original. Lengths held once are done;
of the others, those alone with their prefix hash are done; only rows that
survive both steps are read and hashed in full. Texts themselves are never
shuffled: a second scan meets the surviving (length, prefix) groups through a
bitmap of fixed size, and only digests of rows that it lets through move on.

Cases: null counts as empty; of equal texts the one with the most code points
stays, then the smallest doc_id (null last); of repeated rows with one doc_id
one is kept and the others are marked as dropped; empty texts are equal to
each other; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.llm.common import SPACE
from planspark.session import cut

PREFIX_CHARS = 64
#: Rows of the bitmap; each holds 32,768 bits. 512 rows are 2 MB, whatever the input.
BITMAP_ROWS = 512
BITS = 32_768


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def signatures(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``points``, ``size``, ``prefix`` and the normalised text ``clean``."""
    return docs.select(
        F.col(id).alias("doc_id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
        normalised(F.col(text)).alias("clean"),
    ).select(
        "doc_id",
        "points",
        F.length("clean").alias("size"),
        F.xxhash64(F.substring("clean", 1, PREFIX_CHARS)).alias("prefix"),
        "clean",
    )


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``.

    Beside them the refinement keys ``points``, ``size``, ``prefix`` and the
    full ``digest``, null where a row was told apart before its full hash.
    """
    keys = ["doc_id", "points", "size", "prefix"]
    # repeated rows travel as one with a count
    seen = signatures(docs, id, text)
    rows = cut(seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")))

    # first by length, then by prefix within the lengths that are left
    lengths = rows.groupBy("size").agg(F.sum("copies").alias("n")).where("n > 1").select("size")
    groups = cut(
        rows.groupBy("size", "prefix")
        .agg(F.sum("copies").alias("n"))
        .where("n > 1")
        .join(lengths, "size", "left_semi")
        .select("size", "prefix")
    )
    bit = F.pmod(F.xxhash64("size", "prefix"), F.lit(BITMAP_ROWS * BITS))
    bitmap = (
        groups.select(bit.alias("bit"))
        .select(F.expr(f"bit div {BITS}").alias("map_row"), F.expr(f"bit % {BITS}").alias("at"))
        .groupBy("map_row")
        .agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
    )

    # full digests, computed only where the bitmap has the group
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    full = cut(
        seen.withColumn("bit", bit)
        .withColumn("map_row", F.expr(f"bit div {BITS}"))
        .withColumn("at", F.expr(f"bit % {BITS}"))
        .join(F.broadcast(bitmap), "map_row")
        .where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1)
        .select(*keys, F.sha2(F.col("clean").cast("binary"), 256).alias("digest"))
        .join(groups, ["size", "prefix"], "left_semi")
        .groupBy(*keys, "digest")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    # the row with the most code points stays, then the smallest id, null last
    rank = F.struct(
        (-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("keep_id")
    )
    # written out, so that the join below is one of two plain shuffles, whose large partitions Spark splits
    best = cut(
        full.groupBy("size", "prefix", "digest").agg(F.min(rank).alias("best"), F.sum("copies").alias("group_size"))
    )
    stays = F.col("doc_id").eqNullSafe(F.col("best.keep_id")) & (F.col("points") == -F.col("best.less"))
    judged = full.join(best, ["size", "prefix", "digest"]).select(
        *keys,
        "digest",
        F.col("best.keep_id").alias("keep_id"),
        "group_size",
        stays.alias("stays"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    alone = rows.join(groups, ["size", "prefix"], "left_anti").select(
        *keys,
        F.lit(None).cast("string").alias("digest"),
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    return alone.unionByName(judged.withColumn("kept", F.col("stays") & (F.col("copy") == 1)).drop("stays", "copy"))
