"""Doors from door lines and door arcs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planspark.functions import geometry as G
from planspark.operators.local import by_size, plain, settled_doors
from planspark.operators.ordering import ranked
from planspark.operators.rects import A, B, drop_contained, merge_overlapping
from planspark.operators.spatial import BOX, box_pairs
from planspark.session import cut, discard, shuffled, stored

# Pixels.
DOOR_LENGTH = (50, 150)
DOOR_WIDTH = 15
ARC_GAP = 5
SLIDE_GAP = 10

S = G.cols("x1 y1 x2 y2")


def door_line_pairs(
    lines: DataFrame, keys: Sequence[str], length: tuple[int, int] = DOOR_LENGTH, width: int = DOOR_WIDTH
) -> DataFrame:
    """Thin rectangles between parallel door lines of identical extent.

    Returns each distinct rectangle once: (keys, otype, x1, y1, x2, y2), otype
    0 along x and 1 along y. Equal lines are folded first, so a line drawn many
    times costs one row; two of them give a rectangle without thickness.
    """
    keys = list(keys)
    way = G.seg_orientation(S, 1)
    flat = way == "h"
    line = F.struct(
        F.when(flat, 0).otherwise(1).cast("long").alias("otype"),
        F.when(flat, F.least("x1", "x2")).otherwise(F.least("y1", "y2")).alias("lo"),
        F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest("y1", "y2")).alias("hi"),
        F.when(flat, F.col("y1")).otherwise(F.col("x1")).alias("off"),
    )
    # left out while listing: a filter would compute the ends of the lines once more for each of its terms
    fits = way.isin("h", "v") & G.seg_length(S).between(*length)
    along = lines.select(*keys, F.inline(F.when(fits, F.array(line))))
    group = [*keys, "otype", "lo", "hi"]
    unique = along.groupBy(*group, "off").agg(F.count(F.lit(1)).alias("n"))
    slot = F.floor(F.col("off") / (width + 1))
    low = unique.select(*group, F.col("off").alias("o1"), "n", F.explode(F.array(slot, slot + 1)).alias("slot"))
    # both sides count the copies, so that Spark folds the lines once
    high = unique.select(*group, F.col("off").alias("o2"), F.col("n").alias("m"), slot.alias("slot"))
    near = (F.col("o2") > F.col("o1")) & (F.col("o2") - F.col("o1") <= width)
    twice = (F.col("o2") == F.col("o1")) & (F.col("n") > 1) & (F.col("m") > 1)
    pairs = low.join(shuffled(high), [*group, "slot"]).where(near | twice)
    flat = F.col("otype") == 0
    return pairs.select(
        *keys,
        "otype",
        F.when(flat, F.col("lo")).otherwise(F.col("o1")).alias("x1"),
        F.when(flat, F.col("o1")).otherwise(F.col("lo")).alias("y1"),
        F.when(flat, F.col("hi")).otherwise(F.col("o2")).alias("x2"),
        F.when(flat, F.col("o2")).otherwise(F.col("hi")).alias("y2"),
    )


def door_rects(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Door leaves of a drawing: pairs, without contained ones, overlaps merged, numbered."""
    typed = [*keys, "otype"]
    pairs = door_line_pairs(lines, keys)
    order = [F.col("otype"), F.col("y1"), F.col("x1"), F.col("x2"), F.col("y2")]
    numbered = cut(ranked(pairs, keys, order, "id", bounded=False))
    return merge_overlapping(drop_contained(numbered, typed), typed)


def arc_matches(rects: DataFrame, arcs: DataFrame, keys: Sequence[str], gap: int = ARC_GAP, cell: float = 256) -> DataFrame:
    """Each door leaf with its first arc (by id) within ``gap`` on both axes, if any."""
    keys = list(keys)
    pairs = box_pairs(rects, arcs, keys, cell, margin=gap)
    arc = F.struct(*[F.col(f"b_{c}").alias(c) for c in ("id", "x1", "y1", "x2", "y2", "px1", "py1", "px2", "py2")])
    first = pairs.groupBy(*keys, F.col("a_id").alias("id")).agg(F.min_by(arc, F.col("b_id")).alias("arc"))
    return rects.join(shuffled(first), [*keys, "id"], "left")


def closed_position(matched: DataFrame) -> DataFrame:
    """Where a hinged leaf stands when shut.

    The common bounds of leaf and arc are replaced by a strip of the leaf's
    width at the side to which the arc leads away from the leaf.
    """
    rect = S
    arc = [F.col(f"arc.{c}") for c in ("x1", "y1", "x2", "y2")]
    ends = [(F.col("arc.px1"), F.col("arc.py1")), (F.col("arc.px2"), F.col("arc.py2"))]
    far_first = G.point_rect_distance(*ends[0], rect) > G.point_rect_distance(*ends[1], rect)
    step_x = F.when(far_first, ends[0][0] - ends[1][0]).otherwise(ends[1][0] - ends[0][0])
    step_y = F.when(far_first, ends[0][1] - ends[1][1]).otherwise(ends[1][1] - ends[0][1])
    x1, y1 = F.least(rect[0], arc[0]), F.least(rect[1], arc[1])
    x2, y2 = F.greatest(rect[2], arc[2]), F.greatest(rect[3], arc[3])
    flat = F.col("otype") == 0
    wide, high = rect[3] - rect[1], rect[2] - rect[0]
    back_x, back_y = step_x < 0, step_y < 0
    return matched.withColumns(
        {
            "c_x1": F.when(~flat, x1).when(back_x, x1 - wide).otherwise(x2),
            "c_x2": F.when(~flat, x2).when(back_x, x1).otherwise(x2 + wide),
            "c_y1": F.when(flat, y1).when(back_y, y1 - high).otherwise(y2),
            "c_y2": F.when(flat, y2).when(back_y, y1).otherwise(y2 + high),
        }
    )


def door_arc_match(rects: DataFrame, arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaves with ``arc_id`` and their closed position; null for sliding candidates."""
    rest = [c for c in rects.columns]
    closed = closed_position(arc_matches(rects, arcs, keys))
    shut = [F.when(F.col("arc").isNotNull(), F.col(c)).alias(c) for c in ("c_x1", "c_y1", "c_x2", "c_y2")]
    return closed.select(*rest, F.col("arc.id").alias("arc_id"), *shut)


def door_arc_match_bbox(rects: DataFrame, arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Common bounds of every matched leaf and its arc, overlapping ones merged."""
    found = arc_matches(rects, arcs, keys).where("arc IS NOT NULL")
    bounds = found.select(
        *keys, "id",
        F.least("x1", "arc.x1").alias("x1"), F.least("y1", "arc.y1").alias("y1"),
        F.greatest("x2", "arc.x2").alias("x2"), F.greatest("y2", "arc.y2").alias("y2"),
    )
    return merge_overlapping(bounds, keys)


# --- double doors ----------------------------------------------------------------


def shares_edge(a: G.Box, b: G.Box):
    """One side of a lies on the line of the facing side of b, without common area."""
    gx, gy = G.axis_gaps(a, b)
    side = ((a[0] == b[2]) | (a[2] == b[0])) & (gy <= 0)
    level = ((a[1] == b[3]) | (a[3] == b[1])) & (gx <= 0)
    return (side | level) & ~((gx < 0) & (gy < 0))


def greedy_matching(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disjoint pairs (a < b) that a pass in (a, b) order would take.

    A pair is taken once it is the smallest open pair at both of its ends;
    pairs of taken ends are closed and the rounds go on with the rest.
    """
    keys = list(keys)
    open_pairs = cut(pairs.select(*keys, "a", "b").distinct())
    taken: list[DataFrame] = []
    while not open_pairs.isEmpty():
        ends = open_pairs.select(*keys, F.explode(F.array("a", "b")).alias("end"), F.struct("a", "b").alias("p"))
        first = ends.groupBy(*keys, "end").agg(F.min("p").alias("p"))
        best = cut(
            first.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(*keys, "p.a", "p.b")
        )
        taken.append(best)
        used = best.select(*keys, F.explode(F.array("a", "b")).alias("end"))
        open_pairs = cut(
            open_pairs.join(shuffled(used.withColumnRenamed("end", "a")), [*keys, "a"], "left_anti").join(
                shuffled(used.withColumnRenamed("end", "b")), [*keys, "b"], "left_anti"
            ).select(*keys, "a", "b")
        )
    out = open_pairs
    for part in taken:
        out = out.union(part)
    return out


def double_door_merge(arcs: DataFrame, keys: Sequence[str], cell: float = 128) -> DataFrame:
    """(keys, id, kind, x1..y2): 'double' for merged pairs (id of the first), 'single' for the rest."""
    keys = list(keys)
    rects = arcs.select(*keys, "id", "x1", "y1", "x2", "y2")
    touching = box_pairs(rects, rects, keys, cell, where=(F.col("a_id") < F.col("b_id")) & shares_edge(A, B))
    pairs = greedy_matching(touching.select(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b")), keys)
    partner = pairs.select(*keys, F.explode(F.array(F.struct("a", F.col("a").alias("id")), F.struct("a", F.col("b").alias("id")))).alias("m"))
    member = partner.select(*keys, "m.id", F.col("m.a").alias("__first"))
    grouped = rects.join(shuffled(member), [*keys, "id"], "left").withColumn("__head", F.coalesce("__first", "id"))
    return grouped.groupBy(*keys, F.col("__head").alias("id")).agg(
        F.when(F.count(F.lit(1)) > 1, "double").otherwise("single").alias("kind"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )


# --- sliding doors ---------------------------------------------------------------


_GROWN = ("gx1", "gy1", "gx2", "gy2")


def slide_door_merge(rects: DataFrame, keys: Sequence[str], gap: int = SLIDE_GAP, cell: float = 256) -> DataFrame:
    """Sliding doors: leaves of one type grown, in id order, by near leaves that are not parallel twins.

    A leaf that grows by nothing is no door. The result is that of a loop that
    lets the leaves lead in id order, each taking its first free near leaf of
    a larger id until none is left. Here all leaves lead at once, and a round
    is a grid join: a leader takes its next leaf, also from a larger leader,
    and the smallest of several takers gets it. Whoever loses a leaf, is taken
    itself, or stands near a leaf that a smaller leader gave back, begins anew
    in the next round. Smaller leaders never wait for larger ones, so what is
    left when nobody moves is what the loop gives. Once a leader's bounds are
    larger than any leaf of its drawing no leaf can be a twin of it, the order
    does not matter, and it takes all near leaves in one round.

    State is one row per leaf in one table that each round writes; no large
    group meets in a row or a task. Groups of few leaves take the loop itself,
    in chunks of many groups (``operators/local.py``), and no rounds.
    """
    keys = list(keys)
    own = rects.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("id", *BOX)])
    # leaves without a key, a number or a side are near nothing
    own = own.where(" AND ".join(f"`{c}` IS NOT NULL" for c in own.columns))
    if not all(plain(own.schema[k].dataType) for k in keys):
        return _slide_rounds(own, keys, gap, cell)
    small, large = by_size(own, keys)
    settled = cut(settled_doors(small, keys, gap))
    doors, rest = settled.where("NOT open").drop("open"), settled.where("open").drop("open")
    rest = rest if large is None else rest.unionByName(large)
    return doors if rest.isEmpty() else doors.unionByName(_slide_rounds(rest, keys, gap, cell))


def _slide_rounds(own: DataFrame, keys: list[str], gap: int, cell: float) -> DataFrame:
    """``slide_door_merge`` by rounds alone; ``own`` has keys, id and box."""
    box = list(BOX)
    largest = own.groupBy(*keys).agg(F.max(F.expr("x2 - x1")).alias("mw"), F.max(F.expr("y2 - y1")).alias("mh"))
    state = stored(
        own.join(shuffled(largest), keys).withColumns({
            "owner": F.lit(None).cast("long"), **{g: F.col(c) for g, c in zip(_GROWN, box)},
            "taken": F.lit(0).cast("long"), "active": F.lit(True), "again": F.lit(False),
        })
    )
    while True:
        todo = state.agg(F.count_if("again").alias("again"), F.count_if(F.col("active") & F.col("owner").isNull()).alias("active")).first()
        if not todo["again"] and not todo["active"]:
            break
        for step in [_begin_anew, _take_next] if todo["again"] else [_take_next]:
            # written as a table: a checkpoint would hand the constraints of all rounds on to the next plan
            state, before = step(state, keys, gap, cell), state
            discard(before)
    return state.where("owner IS NULL AND taken > 0").select(*keys, "id", *[F.col(g).alias(c) for g, c in zip(_GROWN, box)])


def _leading(state: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return state.where("owner IS NULL AND NOT again").select(*keys, "id", *more, *[F.col(g).alias(c) for g, c in zip(_GROWN, BOX)])


def _begin_anew(state: DataFrame, keys: list[str], gap: int, cell: float) -> DataFrame:
    """Leaders marked ``again`` give their leaves back; larger leaders near these are marked in turn."""
    losers = state.where("again").select(*keys, F.col("id").alias("owner"))
    back = state.join(shuffled(losers), [*keys, "owner"]).select(*keys, "id", "owner", *BOX)
    near = box_pairs(_leading(state, keys), back, keys, cell, margin=gap, where=F.col("a_id") > F.col("b_owner"))
    marked = near.select(*keys, F.col("a_id").alias("id"), F.lit(True).alias("__marked")).distinct()
    freed = back.select(*keys, "id", F.lit(True).alias("__freed"))
    both = state.join(shuffled(freed), [*keys, "id"], "left").join(shuffled(marked), [*keys, "id"], "left")
    fresh = F.col("again") | F.col("__freed").isNotNull()
    return stored(
        both.withColumns({
            "owner": F.when(F.col("__freed").isNull(), F.col("owner")),
            **{g: F.when(fresh, F.col(c)).otherwise(F.col(g)) for g, c in zip(_GROWN, BOX)},
            "taken": F.when(fresh, F.lit(0).cast("long")).otherwise(F.col("taken")),
            "active": F.col("active") | fresh,
            "again": F.col("__marked").isNotNull(),
        }).drop("__freed", "__marked")
    )


def _take_next(state: DataFrame, keys: list[str], gap: int, cell: float) -> DataFrame:
    """Every active leader takes its next leaf, or all of them where their order cannot matter."""
    a, b = A, B
    twin = ((a[0] == b[0]) & (a[2] == b[2])) | ((a[1] == b[1]) & (a[3] == b[3]))
    wide = ((a[2] - a[0]) > F.col("a_mw")) & ((a[3] - a[1]) > F.col("a_mh"))
    open_to = F.col("b_owner").isNull() | (F.col("b_owner") > F.col("a_id"))
    leaders = _leading(state.where("active"), keys, "mw", "mh")
    leaves = state.select(*keys, "id", "owner", *BOX)
    found = box_pairs(leaders, leaves, keys, cell, margin=gap, where=(F.col("a_id") < F.col("b_id")) & open_to & ~twin)
    leaf = F.struct(F.col("b_id").alias("id"), F.col("b_owner").alias("owner"), *[F.col(f"b_{c}").alias(c) for c in BOX])
    found = found.select(*keys, F.col("a_id").alias("leader"), F.when(wide, F.col("b_id")).alias("each"), leaf.alias("leaf"))
    # one leaf per leader, or each of them
    asked = stored(found.groupBy(*keys, "leader", "each").agg(F.min("leaf").alias("leaf")).drop("each"))
    won = asked.groupBy(*keys, "leaf").agg(F.min("leader").alias("new"))
    gains = won.groupBy(*keys, F.col("new").alias("id")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("leaf.x1").alias("__x1"), F.min("leaf.y1").alias("__y1"),
        F.max("leaf.x2").alias("__x2"), F.max("leaf.y2").alias("__y2"),
    )
    moved = won.select(*keys, F.col("leaf.id").alias("id"), F.col("new").alias("__new"))
    busy = asked.select(*keys, F.col("leader").alias("id"), F.lit(True).alias("__busy")).distinct()
    robbed = won.where("leaf.owner IS NOT NULL").select(*keys, F.col("leaf.owner").alias("id"), F.lit(True).alias("__robbed")).distinct()
    joined = state
    for part in (moved, gains, busy, robbed):
        joined = joined.join(shuffled(part), [*keys, "id"], "left")
    grown = {g: (F.least if g in ("gx1", "gy1") else F.greatest)(F.col(g), F.col(f"__{g[1:]}")) for g in _GROWN}
    was_leader = F.col("__new").isNotNull() & ((F.col("taken") > 0) | F.col("__n").isNotNull())
    out = joined.withColumns({
        **grown,
        "taken": F.col("taken") + F.coalesce("__n", F.lit(0)),
        "active": F.col("active") & F.col("__busy").isNotNull(),
        "again": F.col("again") | F.col("__robbed").isNotNull() | was_leader,
        "owner": F.coalesce("__new", "owner"),
    }).drop("__n", "__x1", "__y1", "__x2", "__y2", "__new", "__busy", "__robbed")
    out = stored(out)
    discard(asked)
    return out


# --- the door job -------------------------------------------------------------------


def doors_classify(lines: DataFrame, arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, kind, x1..y2): single, double, slide doors and closed positions of hinged leaves."""
    keys = list(keys)
    leaves = cut(door_arc_match(door_rects(lines, keys), arcs, keys))
    slides = slide_door_merge(leaves.where("arc_id IS NULL").select(*keys, "otype", "id", "x1", "y1", "x2", "y2"), [*keys, "otype"])
    box = ["x1", "y1", "x2", "y2"]
    closed = leaves.where("arc_id IS NOT NULL").select(
        *keys, F.lit("closed").alias("kind"), *[F.col(f"c_{c}").alias(c) for c in box]
    )
    return (
        double_door_merge(arcs, keys).select(*keys, "kind", *box)
        .unionByName(slides.select(*keys, F.lit("slide").alias("kind"), *box))
        .unionByName(closed)
    )
