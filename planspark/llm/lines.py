"""Line deduplication across documents (operator 10, native).

Digests of the line keys are range-partitioned with document and position as
secondary sort keys, so a very common line spreads over as many partitions as
its rows fill. Each partition streams the first document of each of its
digests; a digest that runs on into later partitions is carried there in a
table of one row per partition. Lines of any other document than the first
are dropped. The result holds run-length coded keep bitmaps per document, not
texts: the runs of dropped lines as (start, length).

Cases: a null or empty text is one empty line; keys below ``MIN_POINTS`` code
points never go; a document keeps all lines of a key whose first document it
is; documents are told apart by id, null ids together are the last document;
repeated rows get the same bitmap; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planspark.llm.common import SPACE, ascii_lower, in_rows_of
from planspark.session import cut

MIN_POINTS = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def keep_bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text", min_points: int = MIN_POINTS) -> DataFrame:
    """``doc_id``, ``text_key`` and ``drop_runs`` of every document that loses lines.

    ``text_key`` is ``text_key_of`` of the text; it tells apart different
    texts under one id.
    """
    lines = (
        docs.select(
            F.col(id).alias("doc_id"), text_key_of(F.col(text)).alias("text_key"), F.posexplode(lines_of(F.col(text))).alias("pos", "line")
        )
        .select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_points)
        .select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("digest"), "doc_id", "text_key", "pos")
    )
    order = [F.col("digest"), F.col("doc_id").asc_nulls_last(), F.col("pos")]
    # stored before and after the range shuffle: its sampling would run the scan twice,
    # and the number of a partition must not change once it is taken
    ranged = cut(cut(lines).repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(
        "part", F.spark_partition_id()
    )
    stream = Window.partitionBy("part", "digest").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    document = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"))
    local = ranged.withColumn("document", document).withColumn("first", F.first("document").over(stream))
    carried = (
        local.groupBy("part")
        .agg(F.max(F.struct("digest", "first")).alias("last"))
        .groupBy(F.col("last.digest").alias("digest"))
        .agg(F.min("last.first").alias("carried"))
    )
    dropped = (
        local.join(F.broadcast(carried), "digest", "left")
        .where(F.col("document") != F.least("first", F.coalesce("carried", "first")))
        .select("doc_id", "text_key", "pos")
        .distinct()
    )
    row = Window.partitionBy("doc_id", "text_key").orderBy("pos")
    return (
        dropped.withColumn("run", F.col("pos") - F.row_number().over(row))
        .groupBy("doc_id", "text_key", "run")
        .agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("length"))
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("drop_runs"))
    )


def text_key_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def kept_text(lines: Column, runs: Column) -> Column:
    """The lines outside the dropped runs, joined; without runs the text as it is."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(lines, s["a"] + 1, s["b"] - s["a"]))), "\n")


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_points: int = MIN_POINTS) -> DataFrame:
    """``docs`` with the columns ``_lines``, ``_runs`` and ``_kept`` (the text without dropped lines)."""
    runs = keep_bitmaps(docs, id, text, min_points).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key"), F.col("drop_runs").alias("_runs")
    )
    keyed = docs.withColumn("_id", F.col(id)).withColumn("_text_key", text_key_of(F.col(text)))
    none = F.array().cast("array<struct<start:int,length:int>>")
    return (
        in_rows_of(keyed, runs, ["_id", "_text_key"])
        .withColumn("_runs", F.coalesce("_runs", none))
        .withColumn("_lines", lines_of(F.col(text)))
        .withColumn(
            "_kept",
            F.when(F.size("_runs") == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(kept_text(F.col("_lines"), F.col("_runs"))),
        )
        .drop("_id", "_text_key")
    )
