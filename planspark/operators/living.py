"""The living room split along its reflex corners, and the borders of merged faces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.functions import geometry as G
from planspark.functions import text as T
from planspark.operators import faces as P
from planspark.operators import rooms as R
from planspark.operators.ordering import ranked
from planspark.operators.segments import SEG
from planspark.session import cut, shuffled

# Longest cut and the first row and column that a cut may reach, in pixels; the function that is split.
CUT_LENGTH, CUT_EDGE = 300, 1
LIVING = "living"
TOLERANCE = 1e-6


def reflex_rays(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rays into each ring from its reflex corners: keys, ray, at (vertex), flat, sign, x, y.

    ``rings`` run counter-clockwise. From a corner one ray goes on along the
    edge that arrives, one back along the edge that leaves; edges off the axes send none.
    """
    ring, n = F.col("ring"), F.size("ring")

    def of_corner(p: Column, i: Column) -> Column:
        before, after = F.get(ring, F.pmod(i - 1, n)), F.get(ring, (i + 1) % n)
        steps = ((p["x"] - before["x"], p["y"] - before["y"]), (p["x"] - after["x"], p["y"] - after["y"]))
        (ax, ay), (bx, by) = steps
        reflex = ax * -by - ay * -bx < 0
        rays = [
            F.when(
                reflex & ((dx == 0) != (dy == 0)),
                F.struct((i * 2 + k).alias("ray"), i.alias("at"), (dy == 0).alias("flat"), F.signum(dx + dy).alias("sign"), p["x"].alias("x"), p["y"].alias("y")),
            )
            for k, (dx, dy) in enumerate(steps)
        ]
        return F.array_compact(F.array(*rays))

    return rings.select(*keys, F.inline(F.flatten(F.transform(ring, of_corner))))


def ray_hits(rays: DataFrame, edges: DataFrame, keys: Sequence[str], length: float = CUT_LENGTH, edge: float = CUT_EDGE, cell: float = 64) -> DataFrame:
    """The nearest point of the ring that each ray meets: ray columns, ``edge`` (its number), ``hx``, ``hy``.

    Rays meet the edges in the strip of their own row or column only.
    """
    keys = list(keys)
    strip = lambda v: F.floor(v / F.lit(cell)).cast("long")
    x1, y1, x2, y2 = G.cols("x1 y1 x2 y2")

    def listed(flat: bool) -> DataFrame:
        low, high = (F.least(y1, y2), F.greatest(y1, y2)) if flat else (F.least(x1, x2), F.greatest(x1, x2))
        return edges.select(*keys, F.lit(flat).alias("flat"), F.explode(F.sequence(strip(low), strip(high))).alias("strip"), "i", *SEG)

    shot = rays.withColumn("strip", strip(F.when(F.col("flat"), F.col("y")).otherwise(F.col("x"))))
    pairs = shot.join(shuffled(listed(True).unionByName(listed(False))), [*keys, "flat", "strip"])
    # along the ray (u) and across it (v)
    u0, v0 = (F.when(F.col("flat"), a).otherwise(b) for a, b in ((F.col("x"), F.col("y")), (F.col("y"), F.col("x"))))
    u1, v1, u2, v2 = (F.when(F.col("flat"), a).otherwise(b) for a, b in ((x1, y1), (y1, x1), (x2, y2), (y2, x2)))
    through = F.array(u1 + (v0 - v1) * (u2 - u1) / F.when(v1 != v2, v2 - v1))
    spots = F.when((v1 == v2) & (v1 == v0), F.array(u1, u2)).when((v1 != v2) & v0.between(F.least(v1, v2), F.greatest(v1, v2)), through)
    met = pairs.withColumn("u", F.explode(spots)).withColumn("far", (F.col("u") - u0) * F.col("sign"))
    fits = (F.col("far") > TOLERANCE) & (F.col("far") <= length) & ((F.col("sign") > 0) | (F.col("u") >= edge))
    ray = [*keys, "ray", "at", "flat", "x", "y"]
    near = met.where(fits).groupBy(*ray).agg(F.min(F.struct("far", F.col("i").alias("edge"), "u")).alias("h"))
    return near.select(
        *ray, "h.edge", F.when(F.col("flat"), F.col("h.u")).otherwise(F.col("x")).alias("hx"),
        F.when(F.col("flat"), F.col("y")).otherwise(F.col("h.u")).alias("hy"),
    )


def cut_parts(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, part, ring, area): the smaller side of every cut from a reflex corner, without those inside others.

    ``rings`` has one simple ring per key. A cut runs inside the ring from a
    corner to an edge, so its sides are the two ways around the ring.
    """
    keys = list(keys)
    point = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    plain = F.transform("ring", point)
    turned = F.when(G.ring_signed_area(plain) < 0, F.reverse(plain)).otherwise(plain)
    ccw = cut(rings.select(*keys, turned.alias("ring")))
    hits = ray_hits(reflex_rays(ccw, keys), R.ring_edge_table(ccw.withColumn("__o", F.lit(0)), keys, "__o").drop("__o"), keys)
    met = hits.join(shuffled(ccw), keys)
    n, i, j = F.size("ring"), F.col("at"), F.col("edge")
    hit = F.array(F.struct(F.col("hx").alias("x"), F.col("hy").alias("y")))

    def run(a: Column, b: Column) -> Column:
        """The vertices from number a on to number b, around the end if need be."""
        wrapped = F.concat(F.slice("ring", a + 1, n - a), F.slice("ring", F.lit(1), b + 1))
        return F.when(b >= a, F.slice("ring", a + 1, F.greatest(b - a + 1, F.lit(0)))).otherwise(wrapped)

    sides = met.select(
        *keys, F.col("ray").alias("part"), F.concat(run(i, j), hit).alias("one"), F.concat(hit, run((j + 1) % n, i)).alias("two")
    ).withColumns({"a": G.ring_area(F.col("one")), "b": G.ring_area(F.col("two"))})
    smaller = sides.select(*keys, "part", F.when(F.col("a") < F.col("b"), F.col("one")).otherwise(F.col("two")).alias("ring"), F.least("a", "b").alias("area"))
    parts = cut(smaller.where(F.col("area") > 0))
    return parts.join(shuffled(R.drop_contained_rings(parts, keys, "part")), [*keys, "part"], "left_semi")


def without_parts(rings: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is left of each ring outside its parts: (keys, rings, area, perimeter), whole pixels."""
    keys = list(keys)
    both = rings.select(*keys, F.lit(-1).cast("long").alias("part"), F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("ring"))
    both = cut(both.join(shuffled(parts.select(*keys).distinct()), keys, "left_semi").unionByName(parts.select(*keys, F.col("part").cast("long").alias("part"), "ring")))
    directed = P.planar_faces(P.node_boundaries(both, keys), keys)
    positive = P.face_table(directed, keys).where("area > 0").select(*keys, "face")
    spots = P.inner_points(directed.join(shuffled(positive), [*keys, "face"], "left_semi"), keys)
    over = P.points_in_rings(spots, R.ring_edge_table(both, keys, "part"), keys, "part")
    kept = over.groupBy(*keys, "face").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low = -1 AND high = -1")
    borders = cut(P.merged_borders(directed, kept, keys))
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    step = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2.0)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2.0)))
    sums = borders.groupBy(*keys).agg((F.sum(cross) / 2).alias("area"), F.sum(step).alias("perimeter"))
    loops = P.border_rings(borders, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("loop", "ring"))), lambda r: r["ring"]).alias("rings"))
    return sums.join(shuffled(loops), keys)


def living_room_split(rooms: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rooms of each drawing after its first living room is split: keys, room_id, label_id, functions, rings, area, perimeter.

    ``rooms`` has keys, room_id and ring, ``labels`` keys, room_id, id, text, x, y
    of the labels inside rooms. A part cut off at a reflex corner becomes a room
    of each label strictly inside it and leaves the living room; the rest stays
    ``living``, with its first living label. Ids are given anew: rooms not
    split in their order, then the parts, then the rest. Areas are in square
    metres, lengths in metres. A drawing without a living room keeps its rooms.
    """
    keys = list(keys)
    marked = cut(labels.withColumn("functions", T.room_functions(F.col("text"))))
    living = marked.where(F.array_contains("functions", LIVING))
    chosen = cut(living.groupBy(*keys).agg(F.min(F.struct("room_id", "id")).alias("c")).select(*keys, F.col("c.room_id").alias("room_id"), F.col("c.id").alias("first")))
    split = cut(rooms.join(shuffled(chosen.select(*keys, "room_id")), [*keys, "room_id"], "left_semi").select(*keys, "ring"))
    own = marked.join(shuffled(chosen.select(*keys, "room_id")), [*keys, "room_id"], "left_semi").select(*keys, "id", "functions", "x", "y")
    parts = cut(cut_parts(split, keys))
    named = cut(P.points_in_rings(own, R.ring_edge_table(parts, keys, "part"), keys, "part"))
    used = cut(parts.join(shuffled(named), [*keys, "part"], "left_semi"))
    whole = lambda df: df.withColumns({"area": G.ring_area(F.col("ring")), "perimeter": G.ring_perimeter(F.col("ring"))})
    none = F.lit(None).cast("long")
    one = F.array("ring")

    def shaped(df: DataFrame, group: int, first: Column, second: Column, label: Column, functions: Column, rings: Column) -> DataFrame:
        ring = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
        order = F.struct(F.lit(group).alias("g"), first.cast("long").alias("a"), second.cast("long").alias("b"))
        return df.select(*keys, order.alias("order"), label.alias("label_id"), functions.alias("functions"), ring.alias("rings"), "area", "perimeter")

    of_room = marked.groupBy(*keys, "room_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "functions"))), lambda r: r["functions"]))).alias("f"))
    others = rooms.join(shuffled(chosen.select(*keys, "room_id")), [*keys, "room_id"], "left_anti").join(shuffled(of_room), [*keys, "room_id"], "left")
    made = used.select(*keys, "part", "ring").join(shuffled(named), [*keys, "part"])
    rest = without_parts(split, used, keys).join(shuffled(chosen), keys)
    intact = split.join(shuffled(used.select(*keys).distinct()), keys, "left_anti").join(shuffled(chosen), keys)
    no_function = F.array().cast("array<string>")
    every = (
        shaped(whole(others), 0, F.col("room_id"), F.lit(0), none, F.coalesce("f", no_function), one)
        .unionByName(shaped(whole(made), 1, F.col("part"), F.col("id"), F.col("id").cast("long"), F.col("functions"), one))
        .unionByName(shaped(rest, 2, F.lit(0), F.lit(0), F.col("first").cast("long"), F.array(F.lit(LIVING)), F.col("rings")))
        .unionByName(shaped(whole(intact), 2, F.lit(0), F.lit(0), F.col("first").cast("long"), F.array(F.lit(LIVING)), one))
    )
    numbered = ranked(cut(every), keys, [F.col("order")], "room_id", bounded=False)
    return numbered.select(
        *keys, "room_id", "label_id", "functions", "rings", (F.col("area") / R.PX2_PER_M2).alias("area"), (F.col("perimeter") / R.PX_PER_M).alias("perimeter")
    )
