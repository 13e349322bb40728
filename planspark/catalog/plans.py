"""Wall, room and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark.catalog.bindings import cte, view
from planspark.catalog.lines import SPLIT_SQL, segments
from planspark.catalog.registry import query
from planspark.catalog.scalars import HEX_SQL, hex_rings, r6
from planspark.functions import geometry as G
from planspark.operators import faces as P
from planspark.operators import living as L
from planspark.operators import rooms as R
from planspark.session import cut

K = ["dwg_id"]
BOX = ["x1", "y1", "x2", "y2"]


@query("wall_outlines")
def wall_outlines(spark, d):
    outlines = R.wall_outlines(segments(spark, d), K)
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return outlines.groupBy("dwg_id", "block").agg(
        (F.abs(F.sum(cross)) / 2).alias("area"), F.count(F.lit(1)).alias("vertices")
    ).select("dwg_id", "area", "vertices")


@query(
    "polygon_drop_contained",
    f"""WITH {cte('hexagons')} SELECT a.dwg_id, a.id FROM hexagons a WHERE NOT EXISTS (SELECT 1 FROM hexagons b WHERE b.dwg_id = a.dwg_id
    AND b.id <> a.id AND a.ox >= b.ox AND a.oy >= b.oy AND a.ox + a.w <= b.ox + b.w AND a.oy + a.h <= b.oy + b.h
    AND (a.ox + a.w <= b.ox + b.cx OR a.oy + a.cy <= b.oy + b.cy) AND (a.ox + a.cx <= b.ox + b.cx OR a.oy + a.h <= b.oy + b.cy)
    AND (a.w * a.cy + a.cx * (a.h - a.cy) < b.w * b.cy + b.cx * (b.h - b.cy) OR a.id > b.id))""",
)
def polygon_drop_contained(spark, d):
    return R.drop_contained_rings(hex_rings(spark, d).select("dwg_id", "id", "ring"), K)


@query(
    "node_boundaries",
    f"""WITH {HEX_SQL}, segments AS (SELECT dwg_id, CAST(round_even(x1, 0) AS BIGINT) AS x1, CAST(round_even(y1, 0) AS BIGINT) AS y1,
      CAST(round_even(x2, 0) AS BIGINT) AS x2, CAST(round_even(y2, 0) AS BIGINT) AS y2 FROM hex_edges), {SPLIT_SQL} SELECT dwg_id, x1, y1, x2, y2 FROM sp""",
)
def node_boundaries(spark, d):
    return P.node_boundaries(hex_rings(spark, d).select("dwg_id", "ring"), K).select("dwg_id", *BOX)


@query("rooms")
def rooms(spark, d):
    rings = hex_rings(spark, d).select("dwg_id", F.col("id").alias("poly_id"), "ring")
    found = R.rooms(rings, view(spark, d, "texts"), K)
    return found.select("dwg_id", "room_id", r6(F.col("area")).alias("area"), r6(F.col("perimeter")).alias("perimeter"),
                        F.array_join("function", "-").alias("function"))


_IN_HEX = """ins AS (SELECT t.dwg_id, h.id AS room, t.id, t.text, t.x, t.y FROM texts t JOIN hexagons h ON h.dwg_id = t.dwg_id AND t.x > ox AND t.y > oy
    AND ((t.x < ox + w AND t.y < oy + cy) OR (t.x < ox + cx AND t.y < oy + h)))"""


@query(
    "room_label_join",
    f"""WITH {cte('texts', 'hexagons')}, {_IN_HEX} SELECT dwg_id, room, id, text FROM ins""",
)
def room_label_join(spark, d):
    edges = R.ring_edge_table(hex_rings(spark, d).withColumnRenamed("id", "room"), K, "room")
    labels = view(spark, d, "texts").select("dwg_id", "id", "text", "x", "y")
    return P.points_in_rings(labels, edges, K, "room").select("dwg_id", "room", "id", "text")


@query(
    "faces_unlabelled",
    f"""WITH {cte('texts', 'hexagons')}, {_IN_HEX} SELECT dwg_id, id FROM texts t WHERE NOT EXISTS (SELECT 1 FROM ins WHERE ins.id = t.id)""",
)
def faces_unlabelled(spark, d):
    """Inner points that no polygon covers, here with label positions as the points."""
    edges = R.ring_edge_table(hex_rings(spark, d).withColumnRenamed("id", "room"), K, "room")
    labels = view(spark, d, "texts").select("dwg_id", "id", "x", "y")
    covered = P.points_in_rings(labels, edges, K, "room")
    return labels.join(covered, ["dwg_id", "id"], "left_anti").select("dwg_id", "id")


def _labels_in_rooms(spark, d):
    edges = R.ring_edge_table(hex_rings(spark, d).withColumnRenamed("id", "room"), K, "room")
    labels = view(spark, d, "texts").select("dwg_id", "id", "x", "y")
    return P.points_in_rings(labels, edges, K, "room")


_GRID = f"""WITH RECURSIVE {cte('texts', 'hexagons')}, {_IN_HEX}, rm AS (SELECT DISTINCT h.* FROM hexagons h JOIN ins ON ins.room = h.id),
  gx AS (SELECT rm.*, ox + 2 * unnest(range(CAST(floor(w / 2) AS BIGINT) + 1)) AS px FROM rm),
  gy AS (SELECT gx.*, oy + 2 * unnest(range(CAST(floor(h / 2) AS BIGINT) + 1)) AS py FROM gx),
  cl AS (SELECT * FROM gy WHERE px > ox AND py > oy AND ((px < ox + w AND py < oy + cy) OR (px < ox + cx AND py < oy + h))),
  nr AS (SELECT cl.dwg_id, cl.id AS room, px, py, arg_min(ins.id, (pow(px - ins.x, 2) + pow(py - ins.y, 2), ins.id)) AS label_id
    FROM cl JOIN ins ON ins.room = cl.id GROUP BY 1, 2, 3, 4) """


def _labelled_rings(spark, d):
    labels = cut(_labels_in_rooms(spark, d))
    ring = hex_rings(spark, d).select("dwg_id", F.col("id").alias("room"), "ring")
    return ring.join(labels.select("dwg_id", "room").distinct(), ["dwg_id", "room"], "left_semi"), labels


@query(
    "nearest_label",
    _GRID + """SELECT dwg_id, room, CAST(py AS DOUBLE) AS y, label_id, count(*) AS points, CAST(sum(px) AS DOUBLE) AS x_sum, CAST(min(px) AS DOUBLE) AS x_min
    FROM nr GROUP BY 1, 2, 3, 4""",
)
def nearest_label(spark, d):
    """The points of a 2 px grid and their nearest labels, summed up by grid row."""
    ring, labels = _labelled_rings(spark, d)
    near = R.nearest_label(R.grid_points(R.with_labels(ring, labels, ["dwg_id", "room"]), ["dwg_id", "room"], 2), labels, ["dwg_id", "room"])
    return near.groupBy("dwg_id", "room", "y", "label_id").agg(
        F.count(F.lit(1)).alias("points"), F.sum("x").alias("x_sum"), F.min("x").alias("x_min")
    )


@query("label_grid_split", _GRID + "SELECT dwg_id, room, label_id, count(*) AS cells, round(count(*) * 4 / 1e4, 6) AS area FROM nr GROUP BY 1, 2, 3")
def label_grid_split(spark, d):
    out = R.label_grid_split(*_labelled_rings(spark, d), ["dwg_id", "room"])
    return out.select("dwg_id", "room", "label_id", "cells", r6(F.col("area")).alias("area"))


_SIDE = "(bs[k].x - lx) * {p}.x + (bs[k].y - ly) * {p}.y - (bs[k].x * bs[k].x + bs[k].y * bs[k].y - lx * lx - ly * ly) / 2"
_P, _Q = (_SIDE.format(p=p) for p in ("p", "poly[(i % len(poly)) + 1]"))


@query(
    "label_voronoi_split",
    f"""WITH RECURSIVE {HEX_SQL}, {cte('texts')}, {_IN_HEX}, sp AS (SELECT dwg_id, room, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, min(id) AS id FROM ins GROUP BY ALL),
    rg AS (SELECT id AS room, list({{'x': x, 'y': y}} ORDER BY i) AS ring FROM verts GROUP BY 1),
    st AS (SELECT a.dwg_id, a.room, a.id AS label_id, a.x AS lx, a.y AS ly, coalesce(list({{'x': b.x, 'y': b.y}} ORDER BY b.id) FILTER (b.id IS NOT NULL), []) AS bs
      FROM sp a LEFT JOIN sp b ON b.room = a.room AND b.id <> a.id GROUP BY ALL),
    cp AS (SELECT st.*, 1 AS k, ring AS poly FROM st JOIN rg USING (room)
      UNION ALL SELECT dwg_id, room, label_id, lx, ly, bs, k + 1, flatten(list_transform(poly, lambda p, i: list_filter([
        CASE WHEN {_P} <= 0 THEN p END,
        CASE WHEN ({_P} < 0 AND {_Q} > 0) OR ({_P} > 0 AND {_Q} < 0) THEN
          {{'x': p.x + ({_P}) / (({_P}) - ({_Q})) * (poly[(i % len(poly)) + 1].x - p.x), 'y': p.y + ({_P}) / (({_P}) - ({_Q})) * (poly[(i % len(poly)) + 1].y - p.y)}} END],
        lambda c: c IS NOT NULL))) FROM cp WHERE k <= len(bs)),
    en AS (SELECT dwg_id, room, label_id, poly FROM cp WHERE k = len(bs) + 1 AND len(poly) > 2)
    SELECT dwg_id, room, label_id, round(abs(list_sum(list_transform(poly, lambda p, i: p.x * poly[(i % len(poly)) + 1].y - poly[(i % len(poly)) + 1].x * p.y))) / 2, 6) AS area_px FROM en""",
)
def label_voronoi_split(spark, d):
    """Rings of the regions nearest to each label, here with their areas."""
    out = R.label_voronoi_split(*_labelled_rings(spark, d), ["dwg_id", "room"])
    return out.select("dwg_id", "room", "label_id", r6(G.ring_area(F.col("ring"))).alias("area_px"))


def _living_sql() -> str:
    from planspark.functions import dictionaries as D

    living = " OR ".join(f"contains(text, '{w}')" for w in D.ROOM_WORDS["living"])
    # the hexagons are boxes without one corner: one cut to the left and one down, each side a box or the smaller L
    return f"""WITH {cte('texts', 'hexagons')}, {_IN_HEX}, lv AS (SELECT dwg_id, min((room, id)) AS c FROM ins WHERE {living} GROUP BY 1),
    sp AS (SELECT h.*, c[2] AS first, w * cy + cx * (h.h - cy) AS total FROM lv JOIN hexagons h ON h.id = c[1]),
    pt AS (SELECT *, 6 AS part, ox AS a1, CASE WHEN low THEN oy ELSE oy + cy END AS b1, CASE WHEN low THEN ox + w ELSE ox + cx END AS a2, CASE WHEN low THEN oy + cy ELSE oy + h END AS b2
        FROM (SELECT *, w * cy <= cx * (h - cy) AS low FROM sp WHERE ox >= 1)
      UNION ALL SELECT *, 7, CASE WHEN low THEN ox ELSE ox + cx END, oy, CASE WHEN low THEN ox + cx ELSE ox + w END, CASE WHEN low THEN oy + h ELSE oy + cy END
        FROM (SELECT *, cx * h < (w - cx) * cy AS low FROM sp WHERE oy >= 1)),
    kp AS (SELECT * FROM pt p WHERE NOT EXISTS (SELECT 1 FROM pt q WHERE q.id = p.id AND q.part <> p.part AND q.a1 <= p.a1 AND q.b1 <= p.b1 AND q.a2 >= p.a2 AND q.b2 >= p.b2)),
    nm AS (SELECT kp.dwg_id, part, ins.id AS label_id, a1, b1, a2, b2 FROM kp JOIN ins ON ins.room = kp.id AND x > a1 AND x < a2 AND y > b1 AND y < b2),
    us AS (SELECT dwg_id, count(DISTINCT part) AS n, min(part) AS part FROM nm GROUP BY 1),
    rest AS (SELECT sp.dwg_id, first, CASE WHEN n IS NULL THEN total WHEN n = 2 THEN total - (SELECT sum((a2 - a1) * (b2 - b1)) FROM kp WHERE kp.id = sp.id) + CASE WHEN EXISTS
        (SELECT 1 FROM kp p JOIN kp q ON q.id = p.id AND p.part = 6 AND q.part = 7 AND p.a1 < q.a2 AND q.a1 < p.a2 AND p.b1 < q.b2 AND q.b1 < p.b2 WHERE p.id = sp.id) THEN cx * cy ELSE 0 END
      ELSE total - (SELECT (a2 - a1) * (b2 - b1) FROM kp WHERE kp.id = sp.id AND kp.part = us.part) END AS area FROM sp LEFT JOIN us USING (dwg_id)),
    al AS (SELECT dwg_id, 0 AS g, id AS o1, 0 AS o2, NULL::BIGINT AS label_id, w * cy + cx * (h - cy) AS area FROM hexagons h WHERE NOT EXISTS (SELECT 1 FROM lv WHERE lv.c[1] = h.id)
      UNION ALL SELECT dwg_id, 1, part, label_id, label_id, (a2 - a1) * (b2 - b1) FROM nm UNION ALL SELECT dwg_id, 2, 0, 0, first, area FROM rest)
    SELECT dwg_id, row_number() OVER (PARTITION BY dwg_id ORDER BY g, o1, o2) AS room_id, label_id, round(area / 1e4, 6) AS area FROM al"""


@query("living_room_split", _living_sql())
def living_room_split(spark, d):
    labels = view(spark, d, "texts").select("dwg_id", "id", "text", "x", "y").join(
        _labels_in_rooms(spark, d).select("dwg_id", "id", F.col("room").alias("room_id")), ["dwg_id", "id"]
    )
    rooms = hex_rings(spark, d).select("dwg_id", F.col("id").alias("room_id"), "ring")
    out = L.living_room_split(rooms, labels, K)
    return out.select("dwg_id", "room_id", "label_id", r6(F.col("area")).alias("area"))


@query("label_guillotine_split")
def label_guillotine_split(spark, d):
    ring, labels = _labelled_rings(spark, d)
    return R.label_guillotine_split(ring, labels, ["dwg_id", "room"])


@query(
    "polygons_subtract_earlier",
    f"""WITH {cte('hexagons')}, xs AS (SELECT dwg_id, unnest([ox, ox + cx, ox + w]) AS x FROM hexagons), ys AS (SELECT dwg_id, unnest([oy, oy + cy, oy + h]) AS y FROM hexagons),
    xi AS (SELECT dwg_id, x AS x1, lead(x) OVER (PARTITION BY dwg_id ORDER BY x) AS x2 FROM (SELECT DISTINCT * FROM xs)),
    yi AS (SELECT dwg_id, y AS y1, lead(y) OVER (PARTITION BY dwg_id ORDER BY y) AS y2 FROM (SELECT DISTINCT * FROM ys)),
    fc AS (SELECT xi.dwg_id, x1, y1, (x2 - x1) * (y2 - y1) AS area, min(id) AS id FROM xi JOIN yi ON yi.dwg_id = xi.dwg_id AND x2 IS NOT NULL AND y2 IS NOT NULL
      JOIN hexagons h ON h.dwg_id = xi.dwg_id AND x1 >= ox AND y1 >= oy AND ((x2 <= ox + w AND y2 <= oy + cy) OR (x2 <= ox + cx AND y2 <= oy + h)) GROUP BY 1, 2, 3, 4)
    SELECT dwg_id, id, CAST(sum(area) AS DOUBLE) AS area FROM fc GROUP BY 1, 2""",
)
def polygons_subtract_earlier(spark, d):
    rings = hex_rings(spark, d).select("dwg_id", "id", "ring")
    return R.subtract_earlier(rings, K, with_rings=False).select("dwg_id", "id", r6(F.col("area")).alias("area"))


# an L-shaped wall is two boxes
_DW = f"""WITH {cte('door_rects', 'hexagons')}, wl AS (SELECT dwg_id, ox AS x1, oy AS y1, ox + w AS x2, oy + cy AS y2 FROM hexagons
    UNION ALL SELECT dwg_id, ox, oy, ox + cx, oy + h FROM hexagons) """


def _walls(spark, d):
    return hex_rings(spark, d).select("dwg_id", "id", "ring")


@query(
    "door_wall_touch",
    _DW + "SELECT dwg_id, id FROM door_rects r WHERE EXISTS (SELECT 1 FROM wl a WHERE a.dwg_id = r.dwg_id AND a.x1 <= r.x2 AND a.x2 >= r.x1 AND a.y1 <= r.y2 AND a.y2 >= r.y1)",
)
def door_wall_touch(spark, d):
    return R.door_wall_touch(view(spark, d, "door_rects"), _walls(spark, d), K).select("dwg_id", "id")


def _snap_sql(shifts: str, limit: str) -> str:
    return _DW + f""", tr AS MATERIALIZED (SELECT dwg_id, id, x2 - x1 > y2 - y1 AS flat, {limit} AS lim, sh.turn, x1 + CASE WHEN x2 - x1 > y2 - y1 THEN 0 ELSE sh.s END AS x1,
      x2 + CASE WHEN x2 - x1 > y2 - y1 THEN 0 ELSE sh.s END AS x2, y1 + CASE WHEN x2 - x1 > y2 - y1 THEN sh.s ELSE 0 END AS y1,
      y2 + CASE WHEN x2 - x1 > y2 - y1 THEN sh.s ELSE 0 END AS y2 FROM door_rects, ({shifts}) sh),
    m AS (SELECT tr.dwg_id, tr.id, turn, lim, CASE WHEN flat THEN tr.x1 - a.x2 ELSE tr.y1 - a.y2 END AS back,
      CASE WHEN flat THEN a.x1 - tr.x2 ELSE a.y1 - tr.y2 END AS ahead FROM tr JOIN wl a ON a.dwg_id = tr.dwg_id
      WHERE CASE WHEN flat THEN a.y1 <= tr.y2 AND a.y2 >= tr.y1 ELSE a.x1 <= tr.x2 AND a.x2 >= tr.x1 END),
    ok AS (SELECT dwg_id, id, turn, min(greatest(back, 0)) FILTER (WHERE ahead <= 0 AND back <= lim) AS lo,
      min(greatest(ahead, 0)) FILTER (WHERE back <= 0 AND ahead <= lim) AS hi FROM m
      WHERE greatest(back, ahead) <= lim GROUP BY 1, 2, 3),
    f AS MATERIALIZED (SELECT dwg_id, id, arg_min({{'t': turn, 'lo': lo, 'hi': hi}}, turn) AS b FROM ok GROUP BY 1, 2),
    g AS (SELECT tr.*, coalesce(b.lo, lim) AS lo, coalesce(b.hi, lim) AS hi FROM tr JOIN f ON f.dwg_id = tr.dwg_id AND f.id = tr.id AND f.b.t = tr.turn)
    SELECT dwg_id, id, x1 - CASE WHEN flat THEN lo ELSE 0 END AS x1, y1 - CASE WHEN flat THEN 0 ELSE lo END AS y1,
      x2 + CASE WHEN flat THEN hi ELSE 0 END AS x2, y2 + CASE WHEN flat THEN 0 ELSE hi END AS y2 FROM g
    UNION ALL SELECT dwg_id, id, x1, y1, x2, y2 FROM door_rects ANTI JOIN f USING (dwg_id, id)"""


@query("door_wall_extend", _snap_sql("SELECT * FROM (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2), (5, -3), (6, 3), (7, -4), (8, 4), (9, -5), (10, 5)) t(turn, s)", "5"))
def door_wall_extend(spark, d):
    return R.snap_doors(view(spark, d, "door_rects"), _walls(spark, d), K)


@query("snap_method", _snap_sql("SELECT 0 AS turn, 0 AS s", "greatest(x2 - x1, y2 - y1) + 5"))
def snap_method(spark, d):
    return R.snap_doors(view(spark, d, "door_rects"), _walls(spark, d), K, method="slide")


@query(
    "plan_bill",
    f"""WITH {cte('rects', 'hexagons')}, s AS (SELECT dwg_id, count(*) AS windows FROM rects GROUP BY 1), r AS (SELECT dwg_id,
      sum(w * cy + cx * (h - cy)) / 1e4 AS ra, count(*) AS rooms, count(*) FILTER (WHERE id % 3 = 0) AS a, count(*) FILTER (WHERE id % 3 = 1) AS b,
      count(*) FILTER (WHERE id % 3 = 2) AS c, sum(w * h) / 1e4 AS st FROM hexagons GROUP BY 1)
    SELECT dwg_id, round(coalesce(st, 0) + coalesce(ra, 0), 6) AS total_area, round(coalesce(ra, 0), 6) AS room_area, coalesce(rooms, 0) AS rooms,
      coalesce(a, 0) AS single_doors, coalesce(b, 0) AS double_doors, coalesce(c, 0) AS slide_doors, coalesce(windows, 0) AS windows FROM r FULL JOIN s USING (dwg_id)""",
)
def plan_bill(spark, d):
    hexes = view(spark, d, "hexagons")
    rm = hexes.selectExpr("dwg_id", "(w * cy + cx * (h - cy)) / 1e4D AS area")
    dr = hexes.selectExpr("dwg_id", "CASE id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'double' ELSE 'slide' END AS kind")
    st = hexes.groupBy("dwg_id").agg((F.sum(F.col("w") * F.col("h")) / 1e4).alias("area"))
    bill = R.plan_bill(rm, dr, view(spark, d, "rects"), st, K)
    return bill.withColumns({c: r6(F.col(c)) for c in ("total_area", "room_area")})
