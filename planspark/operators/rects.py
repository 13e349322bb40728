"""Axis-parallel rectangles: containment and overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planspark.functions import geometry as G
from planspark.operators.planar import closed_small
from planspark.operators.spatial import BOX, box_anti, box_pairs
from planspark.session import cut, shuffled

A = G.cols("a_x1 a_y1 a_x2 a_y2")
B = G.cols("b_x1 b_y1 b_x2 b_y2")


def one_of_each(rects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (the smallest id) per distinct rectangle."""
    return rects.groupBy(*keys, *BOX).agg(F.min("id").alias("id"))


def drop_contained(rects: DataFrame, keys: Sequence[str], cell: float = 256) -> DataFrame:
    """Rectangles that lie in no other one; of equal ones the first stays.

    Containment is transitive, so a single anti-join is exact. Equal
    rectangles are folded before the join.
    """
    unique = one_of_each(rects, keys)
    bigger = F.col("a_id") != F.col("b_id")
    return box_anti(unique, unique, keys, ["id"], cell, where=bigger & G.rect_inside(A, B))


def _bounds():
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]


def close_boxes(rects: DataFrame, keys: Sequence[str], gap: float | None = None, cell: float = 256) -> DataFrame:
    """Join boxes into their common bounds until no two of them meet.

    Two boxes meet when their interiors overlap or, with ``gap``, when they
    are within ``gap`` on both axes. Any order of joining ends in the same
    set. A round has two steps. Boxes that obviously meet, because they share
    an inner lattice point or start in one lattice cell, are joined by a plain
    aggregate, so crowds never form pairs. Then every box joins the neighbour
    that comes first in an order drawn anew each round; that leaves a fraction
    of the boxes, so the number of rounds grows with the logarithm.
    Returns keys, box and the smallest id of each group. Groups of few boxes
    are closed by tasks and take no rounds.
    """
    keys = list(keys)
    settled = closed_small(rects, keys, gap) if keys else None
    if settled is None:
        return _close_by_rounds(rects, keys, gap, cell)
    small, large = settled
    rows = cut(small)
    done, rest = rows.where("NOT open").drop("open"), rows.where("open").drop("open")
    rest = rest if large is None else rest.unionByName(large.select(*rest.columns))
    return done if rest.isEmpty() else done.unionByName(_close_by_rounds(rest, keys, gap, cell).select(*done.columns))


def _close_by_rounds(rects: DataFrame, keys: list[str], gap: float | None, cell: float) -> DataFrame:
    """``close_boxes`` by rounds alone."""
    boxes = rects.select(*keys, "id", *BOX)
    if gap is None:
        step = 8
        px, py = (F.floor(F.col(c) / step + 1) * step for c in ("x1", "y1"))
        inner = (px < F.col("x2")) & (py < F.col("y2"))
        meet = G.rects_overlap(A, B)
        margin = 0
    else:
        step = max(gap, 1)
        px, py = (F.floor(F.col(c) / step) for c in ("x1", "y1"))
        inner = F.lit(True)
        gx, gy = G.axis_gaps(A, B)
        meet = (gx <= gap) & (gy <= gap)
        margin = gap
    boxes, turn = boxes.withColumn("moved", F.lit(True)), 0
    while True:
        spot = F.when(inner, F.struct(px.alias("a"), py.alias("b"), F.lit(None).cast("long").alias("c"))).otherwise(
            F.struct(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("id").alias("c"))
        )
        moved = F.max("moved") | (F.count(F.lit(1)) > 1)
        crowd = boxes.groupBy(*keys, spot.alias("spot")).agg(*_bounds(), F.min("id").alias("id"), moved.alias("moved"))
        state = cut(crowd.select(*keys, "id", *BOX, "moved"))
        fresh = state.where("moved")
        if fresh.isEmpty():
            return state.drop("moved")
        # boxes that stayed as they were cannot meet: one side of a pair is fresh
        turn += 1
        near = box_pairs(fresh, state, keys, cell, margin, where=(F.col("a_id") != F.col("b_id")) & meet)
        both = near.select(*keys, F.explode(F.array(F.struct("a_id", "b_id"), F.struct(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id")))).alias("p"))
        draw = F.struct(F.xxhash64(F.col("p.b_id"), F.lit(turn)).alias("h"), F.col("p.b_id").alias("b"))
        hook = both.groupBy(*keys, F.col("p.a_id").alias("id")).agg(F.min(draw).alias("m"))
        own = F.xxhash64(F.col("id"), F.lit(turn))
        head = F.when(F.col("m.h") < own, F.col("m.b")).otherwise(F.col("id"))
        hooked = state.join(shuffled(hook), [*keys, "id"], "left").withColumn("head", head)
        boxes = hooked.groupBy(*keys, "head").agg(
            *_bounds(), F.min("id").alias("__id"), (F.max(F.col("head") != F.col("id")) | (F.count(F.lit(1)) > 1)).alias("moved")
        ).select(*keys, F.col("__id").alias("id"), *BOX, "moved")


def merge_overlapping(rects: DataFrame, keys: Sequence[str], cell: float = 256) -> DataFrame:
    """Replace overlapping rectangles by their common bounds until none overlap."""
    return close_boxes(rects, keys, None, cell)
