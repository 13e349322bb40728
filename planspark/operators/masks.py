"""Masks as runs: (image, y, x0, x1) with inclusive ends, never one row per pixel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planspark.functions import geometry as G
from planspark.operators.local import spread
from planspark.operators.ordering import islands
from planspark.operators.planar import common_small, rle_small
from planspark.operators.rounds import components
from planspark.operators.segments import pixels
from planspark.session import cut, shuffled

#: Rounding of positions in the exact overlay.
EPS = 1e-9
#: Points of a ring whose pairs are worked on whole, and pairs of edges looked at together.
RING_POINTS, OVERLAY_STEP = 256, 1 << 18
#: Pixel rows of a ring that are filled together.
FILL_STRIP = 128
#: Crossings this far apart in a pixel row are not taken for each other.
APART = 1e-6
#: Pixels of a mask whose run ends are ordered together.
RLE_CHUNK = 1 << 18
EDGE = ("x1", "y1", "x2", "y2")


def union_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disjoint maximal runs per row: overlapping and adjoining runs become one."""
    row = [*keys, "y"]
    # dealt out by pixel row once, for the fold of equal starts and the numbering; a stated number of parts is
    # never put together again, so a task does not hold as many rows as fit the advisory size when packed
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longest = runs.select(*row, "x0", "x1").repartition(parts, *row).groupBy(*row, "x0").agg((F.max("x1") + 1).alias("end"))
    grouped = islands(longest, row, "x0", "end")
    return grouped.groupBy(*row, "island").agg(F.min("x0").alias("x0"), (F.max("end") - 1).alias("x1")).drop("island")


def polygon_to_runs(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scanline fill of rings given as edges (keys name one ring): keys, y, x0, x1.

    A pixel row crosses each edge at y with the lower end included; sorted
    crossings are paired. Pixels from ceil to floor of a pair are filled.
    Edges are sent by strips of pixel rows, never by single ones.
    """
    keys, strip = list(keys), FILL_STRIP
    # the pixel rows of an edge, last one excluded
    first, end = F.ceil(F.least("y1", "y2")).cast("long"), F.ceil(F.greatest("y1", "y2")).cast("long")
    spans = edges.where("y1 <> y2").select(*keys, *EDGE, first.alias("a"), end.alias("b")).where("a < b")
    listed = spans.select(*keys, *EDGE, "a", "b", F.explode(F.sequence(F.floor(F.col("a") / strip), F.floor((F.col("b") - 1) / strip))).alias("s"))
    edge = F.struct(F.greatest("a", F.col("s") * strip).alias("a"), F.least("b", (F.col("s") + 1) * strip).alias("b"), *EDGE)
    strips = listed.groupBy(*keys, "s").agg(F.collect_list(edge).alias("es"))

    # between two neighbouring ends of edges all pixel rows cross the same edges
    def slabs(ends):
        return F.zip_with(F.slice(ends, 1, F.size(ends) - 1), F.slice(ends, 2, F.size(ends) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    ends = F.array_sort(F.array_distinct(F.concat("es.a", "es.b")))
    parts = strips.select(*keys, "es", F.inline(G.bound(ends, slabs)))
    at = lambda e, y: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
    p, q = F.col("p"), F.col("q")

    # pairs of crossings that lie apart in the first and in the last pixel row do so in between
    def mixed(xs):
        def near(i):
            last = [F.get(xs, i + k)["l"] for k in (-2, -1, 0, 1)]
            apart = (F.get(xs, i)["f"] - F.get(xs, i - 1)["f"] > APART) & (F.least(*last[2:]) - F.greatest(*last[:2]) > APART)
            return (i > 0) & (i % 2 == 0) & ~F.coalesce(apart, F.lit(False))

        return F.exists(F.sequence(F.lit(0), F.size(xs) - 1), near)

    crossing = F.filter("es", lambda e: (e["a"] <= p) & (e["b"] >= q))
    met = parts.select(*keys, "p", "q", crossing.alias("es")).where(F.size("es") > 0)
    order = F.sort_array(F.transform("es", lambda e: F.struct(at(e, p).alias("f"), at(e, q - 1).alias("l"))))
    single = F.transform(F.sequence(p, q - 1), lambda y: F.struct(y.alias("p"), (y + 1).alias("q")))
    whole = F.array(F.struct("p", "q"))
    pieces = met.select(*keys, "es", F.inline(F.when(F.size("es") < 3, whole).when(G.bound(order, mixed), single).otherwise(whole)))

    def pairs(xs):
        return F.transform(F.sequence(F.lit(0), F.size(xs) - 1, F.lit(2)), lambda i: F.struct(F.get(xs, i)["e"].alias("e"), F.get(xs, i + 1)["e"].alias("f")))

    sides = G.bound(F.sort_array(F.transform("es", lambda e: F.struct(at(e, p).alias("x"), e.alias("e")))), pairs)
    flat = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ef" for c in EDGE]
    paired = pieces.select(*keys, "p", "q", F.inline(sides)).select(*keys, "p", "q", *flat)
    rows = paired.select(*keys, *[f"{side}_{c}" for side in "ef" for c in EDGE], F.explode(F.sequence(p, q - 1)).alias("y"))
    one, two = (at({c: F.col(f"{side}_{c}") for c in EDGE}, F.col("y")) for side in "ef")
    filled = rows.select(*keys, "y", F.ceil(F.least(one, two)).cast("long").alias("x0"), F.floor(F.greatest(one, two)).cast("long").alias("x1"))
    return filled.where("x0 <= x1")


def overlap_pixels(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str], strip: int = 64) -> DataFrame:
    """(by, n): pixels that are in both masks; each side has disjoint runs.

    Runs are listed per strip of columns they touch, so a long row is spread.
    """
    keys, by = list(keys), list(by)

    def strips(df: DataFrame, p: str) -> DataFrame:
        cut_at = F.explode(F.sequence(F.floor(F.col("x0") / strip), F.floor(F.col("x1") / strip))).alias("s")
        s = df.select(*keys, "y", "x0", "x1", cut_at)
        return s.select(*keys, "y", "s", F.greatest(F.col("x0"), F.col("s") * strip).alias(f"{p}0"), F.least(F.col("x1"), F.col("s") * strip + strip - 1).alias(f"{p}1"))

    both = strips(left, "l").join(shuffled(strips(right, "r")), [*keys, "y", "s"])
    width = F.least("l1", "r1") - F.greatest("l0", "r0") + 1
    return both.where(width > 0).groupBy(*by).agg(F.sum(width).alias("n"))


def size(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))


def pixel_metrics(truth: DataFrame, found: DataFrame, keys: Sequence[str], pixels: int) -> DataFrame:
    """Per key: accuracy, recall, precision, f1 and IoU of two masks of ``pixels`` pixels."""
    keys = list(keys)
    t, p = size(truth, keys).withColumnRenamed("n", "t"), size(found, keys).withColumnRenamed("n", "p")
    both = overlap_pixels(truth, found, keys, keys).withColumnRenamed("n", "tp")
    c = t.join(shuffled(p), keys, "full_outer").join(shuffled(both), keys, "left").fillna(0, ["t", "p", "tp"])
    tp, fp, fn = F.col("tp"), F.col("p") - F.col("tp"), F.col("t") - F.col("tp")

    def share(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    return c.select(
        *keys, ((pixels - fp - fn) / F.lit(pixels)).alias("accuracy"), share(tp, tp + fn).alias("recall"), share(tp, tp + fp).alias("precision"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp + fn).alias("iou"),
    )


def pixel_metrics_by_class(truth: DataFrame, found: DataFrame, image: str, cls: str, pixels: int) -> DataFrame:
    """(cls, iou, precision, recall) over all images; class 0 is the background.

    Runs of different classes of one side do not overlap. The background is
    what no class covers, so its counts follow from the others.
    """
    ct, cp = size(truth, [cls]).withColumnRenamed("n", "t"), size(found, [cls]).withColumnRenamed("n", "p")
    both = overlap_pixels(truth, found, [image, cls], [cls]).withColumnRenamed("n", "tp")
    per = ct.join(shuffled(cp), cls, "full_outer").join(shuffled(both), cls, "left").fillna(0, ["t", "p", "tp"])
    whole_t, whole_p = union_runs(truth, [image]), union_runs(found, [image])
    images = truth.select(image).union(found.select(image)).distinct().agg((F.count(F.lit(1)) * pixels).alias("all"))
    at = size(whole_t, []).withColumnRenamed("n", "t")
    ap = size(whole_p, []).withColumnRenamed("n", "p")
    common = overlap_pixels(whole_t, whole_p, [image], []).withColumnRenamed("n", "c")
    one = images.join(F.broadcast(at)).join(F.broadcast(ap)).join(F.broadcast(common))
    ground = one.select(
        F.lit(0).alias(cls), (F.col("all") - F.col("t")).alias("t"), (F.col("all") - F.col("p")).alias("p"),
        (F.col("all") - F.col("t") - F.col("p") + F.col("c")).alias("tp"),
    )
    rows = per.select(cls, "t", "p", "tp").union(ground)
    union = F.col("t") + F.col("p") - F.col("tp")
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select(cls, zero(F.col("tp"), union).alias("iou"), zero(F.col("tp"), F.col("p")).alias("precision"), zero(F.col("tp"), F.col("t")).alias("recall"))


def boundary_runs(runs: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Pixels next to a mask in the row-major flattened image: one-pixel runs.

    Only left and right neighbours count; the pixel after the end of a row is
    the first of the next one. Runs are disjoint and maximal.
    """
    flat = runs.select(*keys, (F.col("y") * width + F.col("x0")).alias("a"), (F.col("y") * width + F.col("x1")).alias("b"))
    near = flat.select(*keys, F.explode(F.array(F.col("a") - 1, F.col("b") + 1)).alias("p")).where(F.col("p").between(0, width * height - 1)).distinct()
    pixel = near.select(*keys, F.floor(F.col("p") / width).alias("y"), (F.col("p") % width).alias("x"))
    inside = pixel.withColumnsRenamed({"x": "x0"}).withColumn("x1", F.col("x0"))
    return _outside(inside, runs, keys)


def _outside(pixels: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    from planspark.operators.spatial import box_anti

    boxes = runs.select(*keys, F.col("x0").alias("x1"), F.col("y").alias("y1"), F.col("x1").alias("x2"), F.col("y").alias("y2"))
    spots = pixels.select(*keys, F.col("x0").alias("x1"), F.col("y").alias("y1"), F.col("x0").alias("x2"), F.col("y").alias("y2"), F.struct("x0", "y").alias("id"))
    free = box_anti(spots, boxes, keys, ["id"], 64)
    return free.select(*keys, F.col("y1").alias("y"), F.col("x1").alias("x0"), F.col("x2").alias("x1"))


def boundary_f1(truth: DataFrame, found: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """2 I / (U + I) of the two masks' boundary pixels."""
    keys = list(keys)
    t, p = boundary_runs(truth, keys, width, height), boundary_runs(found, keys, width, height)
    both = t.intersect(p).groupBy(*keys).agg(F.count(F.lit(1)).alias("i"))
    nt = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("nt"))
    np_ = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("np"))
    s = nt.join(shuffled(np_), keys, "full_outer").join(shuffled(both), keys, "left").fillna(0, ["nt", "np", "i"])
    return s.select(*keys, F.when(F.col("nt") + F.col("np") > 0, 2 * F.col("i") / (F.col("nt") + F.col("np"))).otherwise(0.0).alias("boundary_f1"))


def area_bbox(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, area, x, y, w, h) of masks with at least one pixel."""
    s = runs.groupBy(*keys).agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x"), F.min("y").alias("y"),
        (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
    )
    return s.where("area >= 1")


def column_rle(runs: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Column-major run lengths as rows (keys, start, zeros, ones): ``ones`` set pixels after ``zeros`` clear ones.

    Clear pixels after the last run are width * height minus its end. Only
    pixels with no set pixel before them in this order, and those with none
    after them, are listed; each of the first kind opens the run that the next
    of the second kind closes. Masks of at most ``RLE_CHUNK`` pixels are listed whole by tasks.
    """
    keys = list(keys)
    settled = rle_small(runs, keys, height, RLE_CHUNK)
    if settled is None:
        return _rle_by_joins(runs, keys, height)
    small, large = settled
    return small if large is None else small.unionByName(_rle_by_joins(large, keys, height))


def _rle_by_joins(runs: DataFrame, keys: list[str], height: int) -> DataFrame:
    """``column_rle`` by joins alone."""
    # the pixel before the top of a column is the bottom of the column to its left, and the other way round
    above = runs.select(*keys, (F.col("y") + 1).alias("y"), "x0", "x1").where(F.col("y") < height).unionByName(
        runs.where(F.col("y") == height - 1).select(*keys, F.lit(0).cast("long").alias("y"), (F.col("x0") + 1).alias("x0"), (F.col("x1") + 1).alias("x1"))
    )
    below = runs.select(*keys, (F.col("y") - 1).alias("y"), "x0", "x1").where("y >= 0").unionByName(
        runs.where("y = 0").select(*keys, F.lit(height - 1).cast("long").alias("y"), (F.col("x0") - 1).alias("x0"), (F.col("x1") - 1).alias("x1"))
    )
    at = F.col("x") * height + F.col("y")
    first = _uncovered(runs, above, keys).select(*keys, at.alias("at"), F.lit(True).alias("starts"))
    last = _uncovered(runs, below, keys).select(*keys, (at + 1).alias("at"), F.lit(False).alias("starts"))
    chunk = [*keys, "chunk"]
    # starts and ends take turns, so each needs only its neighbours; chunks of a mask hand on their outermost ends
    place = F.coalesce(F.floor(F.col("at") / RLE_CHUNK), F.lit(-1))  # runs without a row have ends without a place
    ends = first.unionByName(last).withColumn("chunk", place).repartition(*chunk)
    end = F.when(~F.col("starts"), F.col("at"))
    outer = ends.groupBy(*chunk).agg(F.min(end).alias("low"), F.max(end).alias("high"))
    mask = Window.partitionBy(*keys).orderBy("chunk")
    handed = outer.select(
        *chunk, F.last("high", True).over(mask.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("low", True).over(mask.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    own = Window.partitionBy(*chunk).orderBy("at")
    turns = ends.withColumns({"prev": F.lag("at").over(own), "next": F.lead("at").over(own)}).where("starts")
    return turns.join(shuffled(handed), chunk).select(
        *keys, F.col("at").alias("start"), (F.col("at") - F.coalesce("prev", "before", F.lit(0))).alias("zeros"),
        (F.coalesce("next", "after") - F.col("at")).alias("ones"),
    )


def _uncovered(runs: DataFrame, others: DataFrame, keys: Sequence[str], strip: int = 64) -> DataFrame:
    """(keys, y, x): pixels of ``runs`` outside ``others``; both have disjoint runs, met by strips of columns."""

    def listed(df: DataFrame, p: str) -> DataFrame:
        s = F.explode(F.sequence(F.floor(F.col("x0") / strip), F.floor(F.col("x1") / strip))).alias("s")
        cut_runs = df.select(*keys, "y", "x0", "x1", s)
        return cut_runs.select(
            *keys, "y", "s", F.greatest("x0", F.col("s") * strip).alias(f"{p}0"), F.least("x1", F.col("s") * strip + strip - 1).alias(f"{p}1")
        )

    row = [*keys, "y", "s"]
    hidden = listed(others, "o").groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("o0", "o1"))).alias("os"))
    both = listed(runs, "r").join(shuffled(hidden), row, "left").withColumn("os", F.coalesce("os", F.array().cast("array<struct<o0:bigint,o1:bigint>>")))
    # a strip holds few runs: the gaps between the others, cut to the run
    starts = F.concat(F.array(F.col("r0")), F.transform("os", lambda o: o["o1"] + 1))
    stops = F.concat(F.transform("os", lambda o: o["o0"] - 1), F.array(F.col("r1")))
    gaps = F.zip_with(starts, stops, lambda a, b: F.struct(F.greatest(a, F.col("r0")).alias("a"), F.least(b, F.col("r1")).alias("b")))
    gap = both.select(*keys, "y", F.explode(F.filter(gaps, lambda g: g["a"] <= g["b"])).alias("g"))
    return gap.select(*keys, "y", F.explode(F.sequence("g.a", "g.b")).alias("x"))


def run_components(runs: DataFrame, keys: Sequence[str], min_area: int = 10) -> DataFrame:
    """(keys, comp, area) of 4-connected regions larger than ``min_area``.

    Runs of adjoining rows that share a column are linked.
    """
    keys = list(keys)
    strip = 64
    named = runs.withColumn("id", F.struct("y", "x0"))
    cut_at = F.explode(F.sequence(F.floor(F.col("x0") / strip), F.floor(F.col("x1") / strip))).alias("s")
    above = runs.select(*keys, F.col("y").alias("ay"), (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), cut_at)
    below = runs.select(*keys, "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), cut_at)
    # of the strips that both runs are in, the first one counts
    meet = (F.col("a0") <= F.col("b1")) & (F.col("a1") >= F.col("b0")) & (F.floor(F.greatest("a0", "b0") / strip) == F.col("s"))
    links = above.join(shuffled(below), [*keys, "y", "s"]).where(meet).select(
        *keys, F.struct(F.col("ay").alias("y"), F.col("a0").alias("x0")).alias("a"), F.struct(F.col("y"), F.col("b0").alias("x0")).alias("b")
    )
    grouped = components(named, links, keys)
    return grouped.groupBy(*keys, "comp").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).where(F.col("area") > min_area)


def seg_mask_ratio(segments: DataFrame, runs: DataFrame, keys: Sequence[str], least: float = 0.5) -> DataFrame:
    """(keys, id, ratio): segments with more than ``least`` of their pixels in the mask.

    Runs are disjoint. Pixels and runs meet per (image, row, strip of columns).
    """
    keys, strip = list(keys), 64
    px = pixels(segments, [*keys, "id"]).withColumn("s", F.floor(F.col("x") / strip))
    spread = runs.select(*keys, "y", F.col("x0"), F.col("x1"), F.explode(F.sequence(F.floor(F.col("x0") / strip), F.floor(F.col("x1") / strip))).alias("s"))
    hits = px.join(shuffled(spread), [*keys, "y", "s"]).where("x BETWEEN x0 AND x1").groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("hits"))
    total = segments.select(*keys, "id", (F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) + 1).alias("total"))
    ratio = total.join(shuffled(hits), [*keys, "id"]).select(*keys, "id", (F.col("hits") / F.col("total")).alias("ratio"))
    return ratio.where(F.col("ratio") > least)


def _common_by_joins(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, c): common pixels of pairs of masks, met row by row."""
    x = left.select(*keys, "a", "y", F.col("x0").alias("l0"), F.col("x1").alias("l1")).join(shuffled(pairs), [*keys, "a"])
    both = x.join(shuffled(right.select(*keys, "b", "y", F.col("x0").alias("r0"), F.col("x1").alias("r1"))), [*keys, "b", "y"])
    width = F.least("l1", "r1") - F.greatest("l0", "r0") + 1
    return both.where(width > 0).groupBy(*keys, "a", "b").agg(F.sum(width).alias("c"))


def polygon_iou(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IoU of ring pairs (keys, a, b) from the filled runs of both sides; rings that never meet have 0."""
    keys = list(keys)
    la = size(left, [*keys, "a"]).withColumnRenamed("n", "na")
    lb = size(right, [*keys, "b"]).withColumnRenamed("n", "nb")
    settled = common_small(pairs, left, right, keys)
    if settled is None:
        common = _common_by_joins(pairs, left, right, keys)
    else:
        common, others = settled
        if others is not None:
            some = [df.join(shuffled(others), keys, "left_semi") for df in (pairs, left, right)]
            common = common.unionByName(_common_by_joins(*some, keys))
    s = pairs.join(shuffled(common), [*keys, "a", "b"], "left").join(shuffled(la), [*keys, "a"], "left").join(shuffled(lb), [*keys, "b"], "left").fillna(0, ["c", "na", "nb"])
    union = F.col("na") + F.col("nb") - F.col("c")
    return s.select(*keys, "a", "b", F.when(union > 0, F.col("c") / union).otherwise(0.0).alias("iou"))


def _ring_sides(many: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ring and ends of each edge, counter-clockwise, and the rings' areas; ring i has the next ``many[i]`` points."""
    start, ring, to = np.cumsum(many) - many, np.repeat(np.arange(len(many)), many), np.arange(len(x)) + 1
    to[(start + many - 1)[many > 0]] = start[many > 0]
    area = np.bincount(ring, x * y[to] - x[to] * y, len(many)) / 2
    ends = np.stack([x, y, x[to], y[to]])
    back = (area < 0)[ring]
    ends[:, back] = ends[[2, 3, 0, 1]][:, back]
    real = (ends[0] != ends[2]) | (ends[1] != ends[3])
    return ring[real], ends[:, real], np.abs(area)


def _overlaps(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Common area and IoU of pairs of rings; a side is the rings' numbers of points, and x and y of all of them.

    The steps of ``_overlay_by_edges`` for many pairs at a time.
    """
    n = len(one[0])
    (ra, ea, area_a), (rb, eb, area_b) = _ring_sides(*one), _ring_sides(*two)
    side = np.r_[2 * ra, 2 * rb + 1]
    order = np.argsort(side, kind="stable")
    side, ends = side[order], np.concatenate([ea, eb], axis=1)[:, order]
    count = np.bincount(side, minlength=2 * n)
    start = np.cumsum(count) - count

    def against(sides):
        times = count[sides ^ 1]
        return np.repeat(np.arange(len(sides)), times), spread(start[sides ^ 1], times)

    mine, other = against(side)
    (x1, y1, x2, y2), (ox1, oy1, ox2, oy2) = ends[:, mine], ends[:, other]
    dx, dy, ox, oy, gx, gy = x2 - x1, y2 - y1, ox2 - ox1, oy2 - oy1, ox1 - x1, oy1 - y1
    turn, size = dx * oy - dy * ox, dx * dx + dy * dy
    near = (np.minimum(x1, x2) <= np.maximum(ox1, ox2) + EPS) & (np.maximum(x1, x2) >= np.minimum(ox1, ox2) - EPS)
    near &= (np.minimum(y1, y2) <= np.maximum(oy1, oy2) + EPS) & (np.maximum(y1, y2) >= np.minimum(oy1, oy2) - EPS)
    slanted = np.abs(turn) > EPS
    safe = np.where(slanted, turn, 1.0)
    u = (gx * dy - gy * dx) / safe
    cross = near & slanted & (u >= -EPS) & (u <= 1 + EPS)
    lies = near & ~slanted & (np.abs(gx * dy - gy * dx) <= EPS * np.sqrt(size))
    t = [((gx * oy - gy * ox) / safe)[cross], ((gx * dx + gy * dy) / size)[lies], (((ox2 - x1) * dx + (oy2 - y1) * dy) / size)[lies]]
    at, t = np.concatenate([mine[cross], mine[lies], mine[lies]]), np.concatenate(t)
    within, each = (t > 0) & (t < 1), np.arange(len(side))
    at, t = np.concatenate([at[within], each, each]), np.concatenate([t[within], np.zeros(len(each)), np.ones(len(each))])
    order = np.lexsort((t, at))
    at, t = at[order], t[order]
    piece = np.flatnonzero((at[1:] == at[:-1]) & (t[1:] != t[:-1]))
    own, p, q = at[piece], t[piece], t[piece + 1]
    x1, y1, x2, y2 = ends[:, own]
    dx, dy, half = x2 - x1, y2 - y1, (p + q) / 2
    part = (x1 + dx * p) * (y1 + dy * q) - (x1 + dx * q) * (y1 + dy * p)
    mine, other = against(side[own])
    mx, my, (ox1, oy1, ox2, oy2) = (x1 + dx * half)[mine], (y1 + dy * half)[mine], ends[:, other]
    ox, oy, fx, fy = ox2 - ox1, oy2 - oy1, mx - ox1, my - oy1
    crosses = ((oy1 > my) != (oy2 > my)) & (mx < ox1 + fy * ox / np.where(oy != 0, oy, 1.0))
    length = np.sqrt(ox * ox + oy * oy)
    along = (fx * ox + fy * oy) / (length * length)
    on = (np.abs(fx * oy - fy * ox) <= EPS * np.maximum(length, 1.0) * 10) & (along >= -EPS) & (along <= 1 + EPS)
    alike = on & (dx[mine] * ox + dy[mine] * oy > 0)
    inside, lying, same = (np.bincount(mine[c], minlength=len(own)) for c in (crosses, on, alike))
    counts = np.where(lying > 0, (side[own] % 2 == 0) & (same > 0), inside % 2 == 1)
    common = np.maximum(np.bincount(side[own] // 2, np.where(counts, part, 0.0), n) / 2, 0.0)
    union = area_a + area_b - common
    return common, np.where(union > 0, common / np.where(union > 0, union, 1.0), 0.0)


def overlay_iou(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b, common, iou): exact overlap of pairs of simple rings, without pixels.

    ``pairs`` has keys, a, b; ``left`` keys, a, ring and ``right`` keys, b, ring.
    The border of the common part is made of the pieces of each ring inside
    the other one, so every edge is cut where the other ring's edges meet it,
    the middle of each piece tells whether it counts, and the area is the sum
    over these pieces. Of borders that lie on each other in the same direction
    the left one counts. Rings of no area have 0.

    Pairs of rings of at most ``RING_POINTS`` points are worked on as they
    come, many at a time. Pairs with a larger ring, one that is listed twice
    or one with a number missing are taken apart into rows of edges.
    """
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    keys = list(keys)
    met = pairs.select(*keys, "a", "b").distinct()

    def points(rings: DataFrame, owner: str) -> DataFrame:
        small = lambda c: F.when(F.size("ring") <= RING_POINTS, F.col("ring")[c].cast("array<double>"))
        listed = rings.groupBy(*keys, owner).agg(F.count(F.lit(1)).alias("n"), *[F.any_value(small(c)).alias(c) for c in "xy"])
        return listed.select(*keys, owner, *[F.when(F.col("n") == 1, F.col(c)).alias(owner + c) for c in "xy"])

    laid = met.join(shuffled(points(left, "a")), [*keys, "a"]).join(shuffled(points(right, "b")), [*keys, "b"])
    laid = laid.select(*keys, "a", "b", "ax", "ay", "bx", "by")
    schema = StructType([*met.schema.fields, StructField("common", DoubleType()), StructField("iou", DoubleType()), StructField("open", BooleanType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists = [batch.column(c) for c in ("ax", "ay", "bx", "by")]
            whole = ~np.logical_or.reduce([a.is_null().to_numpy(zero_copy_only=False) for a in lists])
            many = [pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) for a in lists]
            start = [np.cumsum(m) - m for m in many]
            values = [a.flatten().to_numpy(zero_copy_only=False).astype(float) for a in lists]
            for m, v in zip(many, values):
                whole[np.repeat(np.arange(len(m)), m)[~np.isfinite(v)]] = False
            common, iou = np.zeros(len(whole)), np.zeros(len(whole))
            rows = np.flatnonzero(whole)
            block = np.cumsum(many[0][rows] * many[2][rows] + 1) // OVERLAY_STEP
            for part in np.split(rows, np.flatnonzero(block[1:] != block[:-1]) + 1):
                if len(part):
                    x, y, z, w = (v[spread(s[part], m[part])] for s, m, v in zip(start, many, values))
                    common[part], iou[part] = _overlaps((many[0][part], x, y), (many[2][part], z, w))
            arrays = [batch.column(c) for c in met_columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(common), pa.array(iou), pa.array(~whole)], names=[*met_columns, "common", "iou", "open"])

    met_columns = [*keys, "a", "b"]
    rows = cut(laid.mapInArrow(run, schema))
    done, rest = rows.where("NOT open").drop("open"), rows.where("open").select(*met_columns)
    return done if rest.isEmpty() else done.unionByName(_overlay_by_edges(rest, left, right, keys))


def _overlay_by_edges(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``overlay_iou`` with one row per edge and piece, for rings of any size."""
    def sided(rings: DataFrame, owner: str) -> DataFrame:
        plain = F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
        turned = F.when(G.ring_signed_area(plain) < 0, F.reverse(plain)).otherwise(plain)
        return rings.select(*keys, owner, turned.alias("ring"))

    one, two = cut(sided(left, "a")), cut(sided(right, "b"))
    met = pairs.select(*keys, "a", "b").distinct()
    edge = [F.col(f"e.{c}").alias(c) for c in ("i", "x1", "y1", "x2", "y2")]
    group = [*keys, "a", "b", "left"]

    def edges(rings: DataFrame, owner: str, own: bool) -> DataFrame:
        return met.join(shuffled(rings), [*keys, owner]).select(*keys, "a", "b", F.lit(own).alias("left"), F.explode(G.ring_edges(F.col("ring"))).alias("e")).select(*group, *edge)

    mine = edges(one, "a", True).unionByName(edges(two, "b", False)).where("x1 <> x2 OR y1 <> y2")
    mine = cut(mine)
    other = mine.select(*keys, "a", "b", (~F.col("left")).alias("left"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ox, oy = F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    gx, gy = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    turn, size = dx * oy - dy * ox, dx * dx + dy * dy
    t, u = (gx * oy - gy * ox) / turn, (gx * dy - gy * dx) / turn
    near = (
        (F.least("x1", "x2") <= F.greatest("ox1", "ox2") + EPS) & (F.greatest("x1", "x2") >= F.least("ox1", "ox2") - EPS)
        & (F.least("y1", "y2") <= F.greatest("oy1", "oy2") + EPS) & (F.greatest("y1", "y2") >= F.least("oy1", "oy2") - EPS)
    )
    slack = EPS * F.sqrt(size)
    ends = F.array((gx * dx + gy * dy) / size, ((F.col("ox2") - F.col("x1")) * dx + (F.col("oy2") - F.col("y1")) * dy) / size)
    stops = F.when(F.abs(turn) > EPS, F.when(u.between(-EPS, 1 + EPS), F.array(t))).when(F.abs(gx * dy - gy * dx) <= slack, ends)
    own = [*group, "i", "x1", "y1", "x2", "y2"]
    hits = mine.join(shuffled(other), group).where(near).select(*own, F.explode(stops).alias("t")).where((F.col("t") > 0) & (F.col("t") < 1))
    both = mine.select(*own, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")).unionByName(hits)
    cuts = both.groupBy(*own).agg(F.array_sort(F.collect_set("t")).alias("ts"))
    spans = F.zip_with(F.slice("ts", 1, F.size("ts") - 1), F.slice("ts", 2, F.size("ts") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    place = lambda s: ((F.col("x1") + dx * s), (F.col("y1") + dy * s))
    pieces = cuts.select(*own, F.explode(spans).alias("s"))
    (px, py), (qx, qy), (mx, my) = place(F.col("s.p")), place(F.col("s.q")), place((F.col("s.p") + F.col("s.q")) / 2)
    pieces = cut(pieces.select(*group, "i", F.col("s.p").alias("p"), dx.alias("dx"), dy.alias("dy"), (px * qy - qx * py).alias("cross"), mx.alias("mx"), my.alias("my")))
    # the middle of a piece against the other ring: crossings of a ray to the right, and edges that it lies on
    fx, fy = F.col("mx") - F.col("ox1"), F.col("my") - F.col("oy1")
    crosses = ((F.col("oy1") > F.col("my")) != (F.col("oy2") > F.col("my"))) & (F.col("mx") < F.col("ox1") + fy * ox / F.when(oy != 0, oy))
    length = F.sqrt(ox * ox + oy * oy)
    along = (fx * ox + fy * oy) / (length * length)
    on = (F.abs(fx * oy - fy * ox) <= EPS * F.greatest(length, F.lit(1.0)) * 10) & along.between(-EPS, 1 + EPS)
    same = F.col("dx") * ox + F.col("dy") * oy > 0
    tested = pieces.join(shuffled(other), group).groupBy(*group, "i", "p", "cross").agg(
        (F.count_if(crosses) % 2 == 1).alias("inside"), F.count_if(on).alias("on"), F.count_if(on & same).alias("alike")
    )
    counts = F.when(F.col("on") > 0, F.col("left") & (F.col("alike") > 0)).otherwise(F.col("inside"))
    common = tested.where(counts).groupBy(*keys, "a", "b").agg((F.sum("cross") / 2).alias("common"))
    areas = [r.select(*keys, o, G.ring_area(F.col("ring")).alias(f"area_{o}")) for r, o in ((one, "a"), (two, "b"))]
    whole = met.join(shuffled(common), [*keys, "a", "b"], "left").join(shuffled(areas[0]), [*keys, "a"]).join(shuffled(areas[1]), [*keys, "b"])
    share = F.greatest(F.coalesce("common", F.lit(0.0)), F.lit(0.0))
    union = F.col("area_a") + F.col("area_b") - share
    return whole.select(*keys, "a", "b", share.alias("common"), F.when(union > 0, share / union).otherwise(0.0).alias("iou"))
