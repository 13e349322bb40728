"""Closed regions of a planar line set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planspark.functions import geometry as G
from planspark.operators.ordering import ranked
from planspark.operators.planar import border_links_small, ends_known, fans_small, few, loop_links_small, points_small, whole, with_loose
from planspark.operators.rounds import cycle_labels
from planspark.operators.segments import SEG, merge_collinear, split_all, unique_edges
from planspark.operators.spatial import box_pairs, point_box
from planspark.session import cut, shuffled, stored

# Fixed value: faces are looked for within tiles of this many pixels first.
TILE = 4096


def node_boundaries(rings: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """All ring edges as one noded edge set: merged along the axes, split, each edge once."""
    edges = rings.select(*keys, F.inline(G.ring_edges(F.col(ring)))).drop("i")
    whole = edges.select(*keys, *[F.rint(c).cast("long").alias(c) for c in SEG])
    return split_all(merge_collinear(whole, keys), keys)


def half_edges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both directions of every edge with ``id`` and the ``nxt`` edge of its face.

    Around each node the outgoing edges are ranked by angle. After arriving
    at a node the walk leaves by the edge that precedes the way back, so faces
    are walked counter-clockwise and outer borders clockwise.
    """
    keys = list(keys)
    both = edges.select(*keys, *SEG).union(edges.select(*keys, "x2", "y2", "x1", "y1")).dropna(subset=[*keys, "x1", "y1"])
    angle = F.atan2((F.col("y2") - F.col("y1")).cast("double"), (F.col("x2") - F.col("x1")).cast("double"))
    node = Window.partitionBy(*keys, "x1", "y1")
    turn = node.orderBy("angle", "x2", "y2")
    leaves = F.struct(*SEG)
    # whoever comes back along an edge leaves by the one before it, and from the first by the last
    before = F.coalesce(F.lag(leaves).over(turn), F.max_by(leaves, F.struct("angle", "x2", "y2")).over(node))
    back = F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return both.withColumn("angle", angle).select(*keys, back.alias("id"), before.alias("nxt"))


def _tile(edge: str) -> list[Column]:
    """The tile of ``TILE`` pixels that an edge begins in."""
    return [F.floor(F.col(f"{edge}.{c}") / TILE) for c in ("x1", "y1")]


def face_edges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Directed edges with their ``face`` (its smallest edge) and position ``pos``."""
    keys = list(keys)
    return _walked(cycle_labels(half_edges(edges, keys), keys, _tile("id")), keys)


def face_table(directed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per face: signed area (positive inside, negative for outer borders), length, edges, bounds."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    step = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2)))
    return directed.groupBy(*keys, "face").agg(
        (F.sum(cross) / 2).alias("area"), F.sum(step).alias("perimeter"), F.count(F.lit(1)).alias("edges"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x1").alias("x2"), F.max("y1").alias("y2"),
    )


def face_rings(directed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, face, ring): the vertices of each face in order."""
    point = F.struct("pos", F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y"))
    ring = F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return directed.groupBy(*keys, "face").agg(ring.alias("ring"))


def planar_faces(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Directed edges of the closed regions of a noded edge set.

    An edge with the same face on both sides closes nothing: it hangs loose or
    only connects two closed parts. All of these are found by one labelling
    and left out of the second, which is only made where there are any.
    Drawings with few edges are walked by tasks, others by joins.
    """
    keys = list(keys)
    if not whole(edges, keys):
        return _faces_by_joins(edges, keys)
    proper = (F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))
    small, large = few(edges.select(*keys, *SEG), keys, ends_known() & proper)
    walked = _walked(cycle_labels(fans_small(small, keys), keys), keys)
    marked = with_loose(walked, keys)
    if not marked.where("loose").isEmpty():
        walked = _walked(cycle_labels(fans_small(marked.where("NOT loose"), keys), keys), keys)
    return walked if large is None else walked.unionByName(_faces_by_joins(large, keys))


def _walked(labelled: DataFrame, keys: list[str]) -> DataFrame:
    return labelled.select(*keys, F.col("cycle").alias("face"), "pos", "id.*")


def _faces_by_joins(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``planar_faces`` by joins alone."""
    walked = cut(face_edges(cut(unique_edges(edges, keys)), keys))
    ahead = F.struct("x1", "y1") <= F.struct("x2", "y2")
    way = [F.when(ahead, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in zip(SEG, [*SEG[2:], *SEG[:2]])]
    sides = walked.select(*keys, "face", *way).groupBy(*keys, *SEG).agg(
        F.count(F.lit(1)).alias("n"), F.min("face").alias("one"), F.max("face").alias("other")
    )
    both = cut(sides.select(*keys, *SEG, (F.expr("n > 1") & (F.col("one") == F.col("other"))).alias("loose")))
    if both.where("loose").isEmpty():
        return walked
    return cut(face_edges(both.where("NOT loose").drop("loose"), keys))


def points_in_rings(points: DataFrame, edges: DataFrame, keys: Sequence[str], owner: str, cell: float = 64, border: bool = False) -> DataFrame:
    """Points inside rings given as edges: (keys, point columns, owner).

    A ray to the right is counted per ring from (point, edge) pairs. Edges are
    listed by the strips of y that they touch and points meet those of their
    own strip only, so neither a large ring nor a crowded drawing sits in one
    row or task. The boundary counts only with ``border``. Drawings with few
    points and edges are settled by tasks instead.
    """
    keys = list(keys)
    settled = points_small(points, edges, keys, owner, border)
    if settled is None:
        return _points_by_joins(points, edges, keys, owner, cell, border)
    found, points, edges = settled
    return found if points is None else found.unionByName(_points_by_joins(points, edges, keys, owner, cell, border))


def _points_by_joins(points: DataFrame, edges: DataFrame, keys: list[str], owner: str, cell: float, border: bool) -> DataFrame:
    """``points_in_rings`` by joins alone."""
    low, high = F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2"))
    area = edges.groupBy(*keys, owner).agg(
        low.alias("x1"), F.min(F.least("y1", "y2")).alias("y1"), high.alias("x2"), F.max(F.greatest("y1", "y2")).alias("y2")
    )
    near = box_pairs(point_box(points), area, keys, cell)
    rest = [c for c in points.columns if c not in keys]
    cand = near.select(*keys, *[F.col(f"a_{c}").alias(c) for c in rest], F.col(f"b_{owner}").alias(owner))
    strip = lambda v: F.floor(v / F.lit(cell)).cast("long")
    listed = edges.select(
        *keys, owner, *[F.col(c).alias(f"e_{c}") for c in SEG],
        F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))).alias("__strip"),
    )
    pairs = cand.withColumn("__strip", strip(F.col("y"))).join(shuffled(listed), [*keys, owner, "__strip"])
    x, y = F.col("x"), F.col("y")
    ex1, ey1, ex2, ey2 = G.cols("e_x1 e_y1 e_x2 e_y2")
    rise = ey2 - ey1
    side = ex1 + (y - ey1) * (ex2 - ex1) / F.when(rise != 0, rise)
    crosses = ((ey1 > y) != (ey2 > y)) & (x < side)
    cross = (ex2 - ex1) * (y - ey1) - rise * (x - ex1)
    on = (cross == 0) & x.between(F.least(ex1, ex2), F.greatest(ex1, ex2)) & y.between(F.least(ey1, ey2), F.greatest(ey1, ey2))
    tested = pairs.groupBy(*keys, *rest, owner).agg((F.count_if(crosses) % 2).alias("__odd"), F.count_if(on).alias("__on"))
    inside = (F.col("__odd") == 1) | (F.col("__on") > 0) if border else (F.col("__odd") == 1) & (F.col("__on") == 0)
    return tested.where(inside).drop("__odd", "__on")


def in_face_points(points: DataFrame, directed: DataFrame, keys: Sequence[str], cell: float = 64) -> DataFrame:
    """Points strictly inside faces (outer borders left out)."""
    keys = list(keys)
    faces = face_table(directed, keys).where("area > 0").select(*keys, "face")
    return points_in_rings(points, directed, keys, "face", cell).join(shuffled(faces), [*keys, "face"], "left_semi")


def hole_homes(directed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, hole, face, area, perimeter): outer borders lying in a face, given to the smallest such face."""
    keys = list(keys)
    table = face_table(directed, keys)
    outer = table.where("area < 0").select(
        *keys, F.col("face").alias("hole"), "area", "perimeter", F.col("face.x1").alias("x"), F.col("face.y1").alias("y")
    )
    inside = in_face_points(outer, directed, keys)
    size = table.select(*keys, "face", F.col("area").alias("face_area"))
    return inside.join(shuffled(size), [*keys, "face"]).groupBy(*keys, "hole").agg(
        F.min_by("face", "face_area").alias("face"), F.first("area").alias("area"), F.first("perimeter").alias("perimeter")
    )


def hole_sums(directed: DataFrame, keys: Sequence[str], homes: DataFrame | None = None) -> DataFrame:
    """(keys, face, hole_area, hole_length) of the outer borders in each face; ``homes`` as made by ``hole_homes``."""
    homes = hole_homes(directed, keys) if homes is None else homes
    return homes.groupBy(*keys, "face").agg(F.sum(-F.col("area")).alias("hole_area"), F.sum("perimeter").alias("hole_length"))


def block_rings(directed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closed walks cut at repeated vertices: (keys, block, pos, x1..y2).

    Between two visits of a vertex the walk is a closed loop, and loops are
    nested, never crossed. So the edge that arrives for a visit is linked to
    the one that left at the visit before; the cycles of the new links are
    the loops.
    """
    keys = list(keys)
    # a directed edge is in one walk, so it names its loop within the drawing
    if whole(directed, keys):
        small, large = loop_links_small(directed, keys)
        loops = cycle_labels(small, keys)
        if large is not None:
            loops = loops.unionByName(cycle_labels(stored(_loop_links(large, keys)), keys, _tile("id")))
    else:
        loops = cycle_labels(stored(_loop_links(directed, keys)), keys, _tile("id"))
    return loops.select(*keys, F.col("cycle").alias("block"), "pos", "id.*")


def _loop_links(directed: DataFrame, keys: list[str]) -> DataFrame:
    """The links of ``block_rings`` by joins alone."""
    walk = [*keys, "face"]
    node = [*walk, "x1", "y1"]
    visits = ranked(directed.select(*walk, "pos", *SEG), node, [F.col("pos")], "visit")
    size = directed.groupBy(*walk).agg(F.count(F.lit(1)).alias("n"))
    fan = visits.groupBy(*node).agg(F.max("visit").alias("visits"))
    left = visits.join(shuffled(fan), node).join(shuffled(size), walk)
    leave = left.select(*node, F.col("visit"), F.struct(*SEG).alias("nxt"))
    before = F.when(F.col("visit") == 1, F.col("visits")).otherwise(F.col("visit") - 1)
    arrive = left.select(*node, F.pmod(F.col("pos") - 1, F.col("n")).alias("pos"), before.alias("visit"))
    edge = directed.select(*walk, "pos", F.struct(*SEG).alias("id"))
    return arrive.join(shuffled(leave), [*node, "visit"]).join(shuffled(edge), [*walk, "pos"]).select(*keys, "id", "nxt")


def inner_points(directed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One point strictly inside each face, next to its first horizontal-most edge.

    The point lies a quarter pixel to the left of the middle of the face's
    longest edge; edges have whole-number ends, so no other edge is closer
    unless the face is thinner than that.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = F.sqrt((dx * dx + dy * dy).cast("double"))
    spot = F.struct(
        (-size).alias("s"), F.col("pos"),
        ((F.col("x1") + F.col("x2")) / 2 - dy / size / 4).alias("x"),
        ((F.col("y1") + F.col("y2")) / 2 + dx / size / 4).alias("y"),
    )
    return directed.groupBy(*keys, "face").agg(F.min(spot).alias("p")).select(*keys, "face", "p.x", "p.y")


def merged_borders(directed: DataFrame, kept: DataFrame, keys: Sequence[str], owner: Sequence[str] = ()) -> DataFrame:
    """Directed edges around the faces in ``kept`` (keys, owner, face): those whose other side has not the same owner."""
    group = [*keys, *owner]
    mine = directed.join(shuffled(kept.select(*group, "face")), [*keys, "face"]).select(*group, *SEG)
    back = mine.select(*group, F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return mine.join(shuffled(back), [*group, *SEG], "left_anti")


def border_rings(borders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, loop, ring): the closed loops of directed borders; holes run the other way round.

    Around a node, borders that leave and arrive take turns, and the one that
    leaves before an arriving one bounds the same part, so parts that touch in
    a node stay apart.
    """
    keys = list(keys)
    if whole(borders, keys):
        small, large = border_links_small(borders, keys)
        walked = cycle_labels(small, keys)
        if large is not None:
            walked = walked.unionByName(cycle_labels(stored(_border_links(large, keys)), keys, _tile("id")))
    else:
        walked = cycle_labels(stored(_border_links(borders, keys)), keys, _tile("id"))
    point = F.struct("pos", F.col("id.x1").cast("double").alias("x"), F.col("id.y1").cast("double").alias("y"))
    ring = F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return walked.groupBy(*keys, F.col("cycle").alias("loop")).agg(ring.alias("ring"))


def _border_links(borders: DataFrame, keys: list[str]) -> DataFrame:
    """The links of ``border_rings`` by joins alone."""
    node = [*keys, "nx", "ny"]
    out = borders.select(*keys, F.col("x1").alias("nx"), F.col("y1").alias("ny"), F.col("x2").alias("fx"), F.col("y2").alias("fy"), F.lit(True).alias("leaves"), F.struct(*SEG).alias("e"))
    back = borders.select(*keys, F.col("x2").alias("nx"), F.col("y2").alias("ny"), F.col("x1").alias("fx"), F.col("y1").alias("fy"), F.lit(False).alias("leaves"), F.struct(*SEG).alias("e"))
    angle = F.atan2((F.col("fy") - F.col("ny")).cast("double"), (F.col("fx") - F.col("nx")).cast("double"))
    fan = ranked(out.unionByName(back).withColumn("angle", angle), node, [F.col("angle"), F.col("leaves")], "turn", bounded=True)
    size = fan.groupBy(*node).agg(F.max("turn").alias("last"))
    arrive = fan.where("NOT leaves").join(shuffled(size), node).select(
        *node, F.col("e").alias("id"), F.when(F.col("turn") == 1, F.col("last")).otherwise(F.col("turn") - 1).alias("turn")
    )
    leave = fan.where("leaves").select(*node, "turn", F.col("e").alias("nxt"))
    return arrive.join(shuffled(leave), [*node, "turn"]).select(*keys, "id", "nxt")


def region_rings(
    directed: DataFrame, kept: DataFrame, keys: Sequence[str], owner: Sequence[str], homes: DataFrame | None = None
) -> DataFrame:
    """(keys, owner, rings): the borders of the faces of each owner, merged; outer rings run counter-clockwise, holes clockwise.

    ``homes`` names the blocks that stand free in a face; their outer borders are borders of that face's owner too.
    """
    named = {o: f"__owner{k}" for k, o in enumerate(owner)}  # whatever the owner is called
    kept = kept.select(*keys, "face", *[F.col(o).alias(n) for o, n in named.items()])
    if homes is not None:
        free = homes.select(*keys, "face", "hole").join(shuffled(kept), [*keys, "face"]).drop("face").withColumnRenamed("hole", "face")
        kept = kept.unionByName(free)
    group = [*keys, *named.values()]
    loops = border_rings(cut(merged_borders(directed, kept, keys, list(named.values()))), group)
    sums = loops.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("loop", "ring"))), lambda r: r["ring"]).alias("rings"))
    return sums.withColumnsRenamed({n: o for o, n in named.items()})
