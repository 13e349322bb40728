"""Filters on closed cycles: rectangles among faces, sliding doors from them, subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from planspark.functions import geometry as G
from planspark.operators import faces as P
from planspark.operators.doors import slide_door_merge
from planspark.operators.local import by_size, plain, settled_sets
from planspark.operators.ordering import ranked
from planspark.operators.segments import merge_collinear, split_all
from planspark.session import cut, shuffled

# Long side between these pixels and short side below that make a door leaf.
LEAF_LONG = (50, 150)
LEAF_SHORT = 15
#: Points and rings of a group that a task settles whole.
GROUP_POINTS = 1 << 13


def four_point_cycles(directed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner faces with exactly four points: keys, face, area, x1..y2."""
    table = P.face_table(directed, keys).where("area > 0 AND edges = 4")
    return table.select(*keys, "face", "area", "x1", "y1", "x2", "y2")


def rect_cycles(directed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner faces that lie on their bounds: keys, face, area, x1..y2.

    A closed region is its bounding rectangle when it is as large as that.
    """
    table = P.face_table(directed, keys).where("area > 0 AND area = (x2 - x1) * (y2 - y1)")
    return table.select(*keys, "face", "area", "x1", "y1", "x2", "y2")


def cycles_to_rects(cycles: DataFrame, keys: Sequence[str], long: tuple[int, int] = LEAF_LONG, short: int = LEAF_SHORT) -> DataFrame:
    """Rectangular cycles of a door leaf's size: keys, otype (0 along x, 1 along y), x1..y2."""
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size, thin = F.greatest(wide, high), F.least(wide, high)
    fits = (size > long[0]) & (size < long[1]) & (thin < short)
    otype = F.when(wide > high, 0).otherwise(1).cast("long").alias("otype")
    return cycles.where(fits).select(*keys, otype, *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])


def slide_doors_by_cycles(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sliding doors from the rectangles that door lines enclose: keys, otype, id, x1..y2.

    Lines are merged and split, their faces taken, and the rectangles of a
    leaf's size merged as other leaves are.
    """
    keys = list(keys)
    directed = P.planar_faces(split_all(merge_collinear(lines, keys), keys), keys)
    leaves = cut(cycles_to_rects(rect_cycles(directed, keys), keys))
    order = [F.col(c) for c in ("otype", "y1", "x1", "x2", "y2")]
    numbered = cut(ranked(leaves, keys, order, "id", bounded=False))
    return slide_door_merge(numbered, [*keys, "otype"])


def drop_subset_cycles(rings: DataFrame, keys: Sequence[str], owner: str = "id", ring: str = "ring") -> DataFrame:
    """(keys, owner) of the cycles whose points are not all points of another one.

    Of cycles with the same points the largest stays, then the first. A cycle
    meets only the cycles through its rarest point, so a point that many
    cycles share makes no pairs.
    """
    keys = list(keys)
    spots = F.array_sort(F.array_distinct(F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    base = rings.select(*keys, F.col(owner).alias("id"), ring)
    flat = base.schema[ring].dataType.elementType
    if not all(plain(base.schema[k].dataType) for k in [*keys, "id"]) or any(flat[c].dataType != DoubleType() for c in "xy"):
        return _drop_by_joins(base.select(*keys, "id", spots.alias("spots"), G.ring_area(F.col(ring)).alias("size")), keys).withColumnRenamed("id", owner)
    small, large = by_size(base, keys, F.coalesce(F.size(ring), F.lit(0)) + 1, GROUP_POINTS)
    sets = lambda df: df.select(*keys, "id", spots.alias("spots"), G.ring_area(F.col(ring)).alias("size"))
    settled = cut(settled_sets(sets(small), keys))
    kept, rest = settled.where("NOT open").select(*keys, "id"), settled.where("open").drop("open")
    rest = rest if large is None else rest.unionByName(sets(large))
    out = kept if rest.isEmpty() else kept.unionByName(_drop_by_joins(rest, keys))
    return out.withColumnRenamed("id", owner)


def _drop_by_joins(base: DataFrame, keys: list[str]) -> DataFrame:
    """``drop_subset_cycles`` by joins alone; ``base`` has keys, id, spots (distinct, sorted) and size."""
    through = base.select(*keys, "id", "size", "spots", F.explode("spots").alias("spot"))
    use = through.groupBy(*keys, "spot").agg(F.count(F.lit(1)).alias("uses"))
    rarest = through.join(shuffled(use), [*keys, "spot"]).groupBy(*keys, "id").agg(
        F.min_by(F.struct("spot", "spots", "size"), F.struct("uses", "spot")).alias("r")
    )
    one = rarest.select(*keys, F.col("id").alias("a"), F.col("r.spot").alias("spot"), F.col("r.spots").alias("sa"), F.col("r.size").alias("na"))
    other = through.select(*keys, F.col("id").alias("b"), "spot", F.col("spots").alias("sb"), F.col("size").alias("nb"))
    inside = F.size(F.array_except("sa", "sb")) == 0
    equal = F.size("sa") == F.size("sb")
    loses = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    gone = one.join(shuffled(other), [*keys, "spot"]).where((F.col("a") != F.col("b")) & inside & (~equal | loses))
    return base.select(*keys, "id").join(shuffled(gone.select(*keys, F.col("a").alias("id"))), [*keys, "id"], "left_anti")
