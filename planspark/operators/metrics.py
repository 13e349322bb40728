"""Counts, reports and error statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEGEND_FAILED = "Get legend failed."
VIEWPORT_FAILED = "Get viewport failed."


def label_counts(boxes: DataFrame, file: str, cls: str) -> DataFrame:
    """Per class: boxes and distinct files."""
    per_file = boxes.groupBy(cls, file).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(cls).agg(F.sum("n").alias("boxes"), F.count(F.lit(1)).alias("files"))


def log_status_counts(log: DataFrame, column: str = "line") -> DataFrame:
    c = F.col(column)
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c.endswith("finish")).alias("valid"),
        F.count_if(c.endswith(LEGEND_FAILED)).alias("legend_err"),
        F.count_if(c.endswith(VIEWPORT_FAILED)).alias("vp_err"),
    )


def area_diff_stats(rooms: DataFrame, measured: str = "measured", drawn: str = "drawn") -> DataFrame:
    gap = F.abs(F.col(measured) - F.col(drawn))
    return rooms.agg(
        F.avg(gap).alias("mean_diff"),
        F.avg(gap / F.col(measured) * 100).alias("mean_pct"),
        F.sum(gap).alias("total_diff"),
        (F.sum(gap) / F.sum(measured)).alias("ratio"),
    )


def confusion_counts(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(rows: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    matrix = rows.groupBy(F.col(truth).alias("truth")).pivot(predicted, list(classes)).count()
    return matrix.fillna(0)


def classification_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support from confusion counts (truth, predicted, n).

    Rows: each class, then 'accuracy' (in f1), 'macro avg' and 'weighted avg'.
    The counts have one row per class pair, so everything after them is small.
    """
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    t = counts.groupBy(F.col("truth").cast("string").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(hit).alias("tp")
    )
    p = counts.groupBy(F.col("predicted").cast("string").alias("label")).agg(F.sum("n").alias("named"))
    both = t.join(p, "label", "full_outer").fillna(0, ["support", "tp", "named"])
    precision = F.when(F.col("named") > 0, F.col("tp") / F.col("named")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = both.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1",
        F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0),
    )
    names = ["label", "precision", "recall", "f1", "support"]
    scores = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))
    weighted = per.agg(
        *[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores],
        F.sum("support").alias("support"),
    )
    nothing = F.lit(None).cast("double")
    accuracy = per.agg(
        nothing.alias("precision"), nothing.alias("recall"),
        (F.sum("tp") / F.sum("support")).alias("f1"), F.sum("support").alias("support"),
    )
    out = per.select(*names)
    for label, rows in (("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(rows.withColumn("label", F.lit(label)).select(*names))
    return out


def mismatches(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    return rows.where(~F.col(expected).eqNullSafe(F.col(predicted)))


def mismatch_totals(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col(expected).eqNullSafe(F.col(predicted))).alias("errors"),
    )
