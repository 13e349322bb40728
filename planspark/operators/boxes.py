"""Detection boxes: IoU pairs, suppression, detection scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.functions import geometry as G
from planspark.operators.rects import A, B
from planspark.operators.rounds import greedy_dropped
from planspark.operators.spatial import BOX, box_pairs

# Overlap thresholds.
NMS_OVERLAP = 0.3
REPEAT_OVERLAP = 0.8
DETECTED_OVERLAP = 0.5


def iou_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float, where: Column | None = None) -> DataFrame:
    """Pairs of boxes that meet, with ``iou``."""
    return box_pairs(left, right, keys, cell, where=where).withColumn("iou", G.rect_iou(A, B))


def _suppress(boxes: DataFrame, keys: Sequence[str], order: Sequence[str], iou: Column, threshold: float, cell: float, margin: float = 0) -> DataFrame:
    """Keep boxes in ``order`` (descending structs first are not used: smaller comes first)."""
    keys = list(keys)
    rank = F.struct(*order)
    # a copy of a box is always dropped by the first of the copies
    first = boxes.groupBy(*keys, *BOX).agg(F.min(rank).alias("rank"))
    earlier = F.col("a_rank") < F.col("b_rank")
    pairs = box_pairs(first, first, keys, cell, margin, where=earlier).where(iou > threshold)
    lost = greedy_dropped(pairs.select(*keys, F.col("a_rank").alias("win"), F.col("b_rank").alias("lose")), keys)
    kept = first.join(lost.withColumnRenamed("lose", "rank"), [*keys, "rank"], "left_anti")
    return kept.select(*keys, *BOX, "rank.*")


def pixel_iou(a: G.Box, b: G.Box) -> Column:
    """IoU of pixel boxes that include both borders."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1)
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1)
    size_a = (a[2] - a[0] + 1) * (a[3] - a[1] + 1)
    size_b = (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
    return w * h / (size_a + size_b - w * h)


def nms(boxes: DataFrame, keys: Sequence[str], threshold: float = NMS_OVERLAP, cell: float = 128) -> DataFrame:
    """Non-maximum suppression by ``score``, ties by ``id``. Returns keys, box, score, id."""
    ranked = boxes.withColumn("__neg", -F.col("score"))
    kept = _suppress(ranked, keys, ["__neg", "id"], pixel_iou(A, B), threshold, cell, margin=1)
    return kept.withColumn("score", -F.col("__neg")).drop("__neg")


def label_dedupe(boxes: DataFrame, keys: Sequence[str], threshold: float = REPEAT_OVERLAP, cell: float = 0.1) -> DataFrame:
    """Drop boxes that repeat an earlier kept one (by ``box_no``). Returns keys, box, box_no."""
    return _suppress(boxes, keys, ["box_no"], G.rect_iou(A, B), threshold, cell)


def best_iou(side: DataFrame, other: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Every box of ``side`` (keys, id) with its best IoU against ``other``; 0 when it meets none."""
    keys = list(keys)
    best = iou_pairs(side, other, keys, cell).groupBy(*keys, F.col("a_id").alias("id")).agg(F.max("iou").alias("best"))
    return side.select(*keys, "id").join(best, [*keys, "id"], "left").fillna(0.0, ["best"])


def detection_missed(truth: DataFrame, found: DataFrame, image: str, cls: str, threshold: float = DETECTED_OVERLAP, cell: float = 128) -> DataFrame:
    """Per image: truth boxes and how many have no same-class detection above the threshold.

    When one side of an image is empty, all boxes of the other side count.
    """
    keys = [image, cls]
    missed = best_iou(truth, found, keys, cell).groupBy(image).agg(
        F.count(F.lit(1)).alias("truth"), F.count_if(F.col("best") <= threshold).alias("open")
    )
    counts = found.groupBy(image).agg(F.count(F.lit(1)).alias("found"))
    both = missed.join(counts, image, "full_outer").fillna(0, ["truth", "open", "found"])
    one_empty = (F.col("truth") == 0) | (F.col("found") == 0)
    return both.select(
        image, "truth", F.when(one_empty, F.greatest("truth", "found")).otherwise(F.col("open")).alias("missed")
    )


def detection_accuracy(missed: DataFrame) -> DataFrame:
    return missed.agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("missed") > 0).alias("images_with_misses"),
        F.sum("truth").alias("boxes"), F.sum("missed").alias("missed"),
        (1 - F.sum("missed") / F.sum("truth")).alias("accuracy"),
    )


def instance_pr(truth: DataFrame, found: DataFrame, keys: Sequence[str], by: Sequence[str], thresholds: Sequence[float] = (0.5,), standard: bool = False, cell: float = 128) -> DataFrame:
    """Precision and recall per group and threshold from best IoUs on both sides.

    By default hits of both sides are added into one true-positive count;
    ``standard`` uses the hits among predictions for precision and among the
    truth for recall.
    """
    by = list(by)
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    t = best_iou(truth, found, keys, cell).select(*by, "best", grid, F.lit(0).alias("side"))
    p = best_iou(found, truth, keys, cell).select(*by, "best", grid, F.lit(1).alias("side"))
    hit = F.col("best") >= F.col("threshold")
    sums = t.union(p).groupBy(*by, "threshold").agg(
        F.count_if(hit & (F.col("side") == 0)).alias("hit_t"), F.count_if(hit & (F.col("side") == 1)).alias("hit_p"),
        F.count_if(~hit & (F.col("side") == 0)).alias("fn"), F.count_if(~hit & (F.col("side") == 1)).alias("fp"),
    )
    tp_p = F.col("hit_p") if standard else F.col("hit_t") + F.col("hit_p")
    tp_r = F.col("hit_t") if standard else F.col("hit_t") + F.col("hit_p")

    def share(a: Column, b: Column) -> Column:
        return F.when(a + b > 0, a / (a + b)).otherwise(0.0)

    return sums.select(*by, "threshold", share(tp_p, F.col("fp")).alias("precision"), share(tp_r, F.col("fn")).alias("recall"))


def instance_ap(truth: DataFrame, found: DataFrame, keys: Sequence[str], by: Sequence[str], thresholds: Sequence[float] = (0.5, 0.75), **options) -> DataFrame:
    """Precision at several thresholds."""
    return instance_pr(truth, found, keys, by, thresholds, **options).select(*by, "threshold", F.col("precision").alias("ap"))


def boundary_f1(truth: DataFrame, found: DataFrame, keys: Sequence[str], by: Sequence[str], reach: float = 5, cell: float = 128) -> DataFrame:
    """F1 over all truth x prediction pairs whose distance is below ``reach``.

    Pairs in reach are true positives, other pairs of the same image and class
    are false negatives, predictions not literally in the truth are false
    positives. The number of pairs is a product of counts; only near pairs are
    joined.
    """
    keys, by = list(keys), list(by)
    near = box_pairs(truth, found, keys, cell, margin=reach, where=G.rect_distance(A, B) < reach)
    tp = near.groupBy(*by).agg(F.count(F.lit(1)).alias("tp"))
    nt = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("nt"))
    np_ = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("np"))
    total = nt.join(np_, keys, "full_outer").fillna(0, ["nt", "np"]).groupBy(*by).agg(F.sum(F.col("nt") * F.col("np")).alias("pairs"))
    literal = truth.select(*keys, *BOX).distinct()
    fp = found.join(literal, [*keys, *BOX], "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("fp"))
    s = total.join(tp, by, "left").join(fp, by, "left").fillna(0, ["tp", "fp"])
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("pairs") > 0, F.col("tp") / F.col("pairs")).otherwise(0.0)
    return s.select(*by, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("boundary_f1"))
