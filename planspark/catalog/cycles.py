"""Cycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark.catalog.bindings import cte, view
from planspark.catalog.doors import slide_sql
from planspark.catalog.registry import query
from planspark.catalog.scalars import HEX_SQL, hex_rings
from planspark.operators import cycles as C
from planspark.operators import faces as P
from planspark.operators import segments as S

K = ["dwg_id"]
BOX = ["x1", "y1", "x2", "y2"]


def leaf_lines(spark, d):
    """The outlines of the door leaves as single lines."""
    x1, y1, x2, y2 = (F.col(c) for c in BOX)
    sides = F.array(*[
        F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), e.alias("y2"))
        for a, b, c, e in ((x1, y1, x2, y1), (x1, y2, x2, y2), (x1, y1, x1, y2), (x2, y1, x2, y2))
    ])
    place = ["dwg_id", F.floor(F.col("x1") / 400).alias("slot"), "y1"]
    first = view(spark, d, "leaves").groupBy(*place).agg(F.min(F.struct("id", "x1", "x2", "y2")).alias("f"))
    return first.select("dwg_id", "y1", "f.x1", "f.x2", "f.y2").select("dwg_id", F.inline(sides))


def leaf_faces(spark, d):
    return P.planar_faces(S.split_all(S.merge_collinear(leaf_lines(spark, d), K), K), K)


_LEAVES = f"""WITH RECURSIVE {cte('leaves')}, lv AS (SELECT * FROM leaves QUALIFY row_number() OVER (PARTITION BY dwg_id, floor(x1 / 400), y1 ORDER BY id, x1, x2) = 1)"""


@query(
    "cycles_4",
    _LEAVES + """ SELECT dwg_id, x1, y1, x2, y2 FROM lv a WHERE NOT EXISTS (SELECT 1 FROM lv b WHERE b.dwg_id = a.dwg_id AND b.id <> a.id
      AND b.x1 <= a.x2 AND b.x2 >= a.x1 AND b.y1 <= a.y2 AND b.y2 >= a.y1)""",
)
def cycles_4(spark, d):
    """Leaves alone are cycles of four points; of two that slide past each other both have more."""
    return C.four_point_cycles(leaf_faces(spark, d), K).select("dwg_id", *BOX)


@query("rect_cycles", _LEAVES + " SELECT dwg_id, x1, y1, x2, y2, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS area FROM lv")
def rect_cycles(spark, d):
    return C.rect_cycles(leaf_faces(spark, d), K).select("dwg_id", *BOX, F.col("area").cast("double").alias("area"))


_FITS = "lr AS (SELECT dwg_id, CAST(0 AS BIGINT) AS otype, x1, y1, x2, y2 FROM lv WHERE x2 - x1 > 50 AND x2 - x1 < 150)"


@query("cycles_to_rects", f"{_LEAVES}, {_FITS} SELECT * FROM lr")
def cycles_to_rects(spark, d):
    return C.cycles_to_rects(C.rect_cycles(leaf_faces(spark, d), K), K)


@query(
    "slide_doors_by_cycles",
    f"""{_LEAVES}, {_FITS}, ln AS (SELECT *, row_number() OVER (PARTITION BY dwg_id ORDER BY otype, y1, x1, x2, y2) AS id FROM lr), {slide_sql('ln')}
    SELECT * FROM slides""",
)
def slide_doors_by_cycles(spark, d):
    return C.slide_doors_by_cycles(leaf_lines(spark, d), K)


# Rings to choose from: every hexagon, every third without one corner, every third with its corners in another order.
_RINGS = f"""WITH {HEX_SQL}, rv AS (SELECT dwg_id, id * 2 AS id, i, x, y FROM verts
      UNION ALL SELECT dwg_id, id * 2 + 1, i, x, y FROM verts WHERE id % 3 = 0 AND i <> 4
      UNION ALL SELECT dwg_id, id * 2 + 1, (i * 5) % 6, x, y FROM verts WHERE id % 3 = 1),
    e AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY id ORDER BY i), first_value(x) OVER (PARTITION BY id ORDER BY i)) AS nx,
      coalesce(lead(y) OVER (PARTITION BY id ORDER BY i), first_value(y) OVER (PARTITION BY id ORDER BY i)) AS ny FROM rv),
    a AS (SELECT dwg_id, id, abs(sum(x * ny - nx * y)) / 2 AS area, list_sort(list(DISTINCT (x, y))) AS ps FROM e GROUP BY 1, 2)"""


@query(
    "cycle_drop_subset",
    _RINGS + """ SELECT dwg_id, id FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.dwg_id = a.dwg_id AND b.id <> a.id AND list_has_all(b.ps, a.ps)
      AND (len(b.ps) > len(a.ps) OR b.area > a.area OR (b.area = a.area AND b.id < a.id)))""",
)
def cycle_drop_subset(spark, d):
    hexes = hex_rings(spark, d).select("dwg_id", "id", "ring")
    at = lambda i: F.get("ring", F.lit(i))
    less = hexes.where("id % 3 = 0").select("dwg_id", (F.col("id") * 2 + 1).alias("id"), F.array(*[at(i) for i in (0, 1, 2, 3, 5)]).alias("ring"))
    turned = hexes.where("id % 3 = 1").select("dwg_id", (F.col("id") * 2 + 1).alias("id"), F.array(*[at(i * 5 % 6) for i in range(6)]).alias("ring"))
    rings = hexes.select("dwg_id", (F.col("id") * 2).alias("id"), "ring").unionByName(less).unionByName(turned)
    return C.drop_subset_cycles(rings, K)
