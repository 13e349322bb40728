"""Scalar geometry over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark.catalog.bindings import VIEWS, cte, view
from planspark.catalog.registry import query
from planspark.functions import boxes as B
from planspark.functions import geometry as G
from planspark.operators.segments import pixels

VIEWS["rect_pairs"] = (
    "lineitem",
    [
        "l_orderkey AS dwg_id",
        VIEWS["rects"][1][1],
        "CAST(l_partkey % 60 * 10 AS BIGINT) AS ax1",
        "CAST(l_suppkey % 50 * 10 AS BIGINT) AS ay1",
        "CAST(l_partkey % 60 * 10 + CAST(l_quantity AS BIGINT) * 10 AS BIGINT) AS ax2",
        "CAST(l_suppkey % 50 * 10 + l_linenumber * 30 AS BIGINT) AS ay2",
        "CAST(l_orderkey % 60 * 10 AS BIGINT) AS bx1",
        "CAST(l_orderkey * 7 % 50 * 10 AS BIGINT) AS by1",
        "CAST(l_orderkey % 60 * 10 + l_linenumber * 20 AS BIGINT) AS bx2",
        "CAST(l_orderkey * 7 % 50 * 10 + CAST(l_quantity AS BIGINT) * 8 AS BIGINT) AS by2",
    ],
)

A = G.cols("ax1 ay1 ax2 ay2")
BB = G.cols("bx1 by1 bx2 by2")
S = G.cols("x1 y1 x2 y2")
KEY = ["dwg_id", "id"]


def r6(column):
    return F.round(column.cast("double"), 6)


# --- viewport ---------------------------------------------------------------

_ENT = cte("drawings", "entities")
_SCALED = f"""WITH {_ENT}, e AS (
  SELECT e.*, img_w AS w, img_h AS h, rx1, ry1, rx2, ry2,
    CASE WHEN img_h / img_w > (ry2 - ry1) / (rx2 - rx1) THEN img_w / (rx2 - rx1)
         ELSE img_h / (ry2 - ry1) END AS s
  FROM entities e JOIN drawings d USING (dwg_id)), p AS (
  SELECT dwg_id, id, w, h,
    CAST(round_even(w / 2 + (x1 - (rx2 + rx1) / 2) * s, 0) AS BIGINT) AS px1,
    h - CAST(round_even(h / 2 + (y1 - (ry2 + ry1) / 2) * s, 0) AS BIGINT) AS py1,
    CAST(round_even(w / 2 + (x2 - (rx2 + rx1) / 2) * s, 0) AS BIGINT) AS px2,
    h - CAST(round_even(h / 2 + (y2 - (ry2 + ry1) / 2) * s, 0) AS BIGINT) AS py2
  FROM e), q AS (
  SELECT *, px1 BETWEEN 0 AND w AND px2 BETWEEN 0 AND w AND py1 BETWEEN 0 AND h
    AND py2 BETWEEN 0 AND h AS ok FROM p) """


def _entities(spark, d):
    return view(spark, d, "entities").join(view(spark, d, "drawings"), "dwg_id")


@query(
    "viewport_scale",
    f"""WITH {cte('drawings')} SELECT dwg_id, round(
    CASE WHEN img_h / img_w > (ry2 - ry1) / (rx2 - rx1) THEN img_w / (rx2 - rx1)
         ELSE img_h / (ry2 - ry1) END, 6) AS scale FROM drawings""",
)
def viewport_scale(spark, d):
    return view(spark, d, "drawings").select("dwg_id", r6(G.Viewport.of().scale).alias("scale"))


@query(
    "viewport_rect",
    _SCALED
    + """SELECT dwg_id, id, CASE WHEN ok THEN px1 END AS x1, CASE WHEN ok THEN least(py1, py2) END AS y1,
    CASE WHEN ok THEN px2 END AS x2, CASE WHEN ok THEN greatest(py1, py2) END AS y2 FROM q""",
)
def viewport_rect(spark, d):
    return _entities(spark, d).select(
        *KEY, *[c.alias(n) for n, c in G.Viewport.of().rect(S).items()]
    )


@query(
    "viewport_point",
    _SCALED
    + """SELECT dwg_id, id, CASE WHEN ok THEN px1 END AS x1, CASE WHEN ok THEN py1 END AS y1,
    CASE WHEN ok THEN px2 END AS x2, CASE WHEN ok THEN py2 END AS y2 FROM q""",
)
def viewport_point(spark, d):
    return _entities(spark, d).select(
        *KEY, *[c.alias(n) for n, c in G.Viewport.of().point(S).items()]
    )


@query(
    "viewport_xy",
    _SCALED
    + """SELECT dwg_id, id, CASE WHEN px1 BETWEEN 0 AND w THEN px1 END AS x,
    CASE WHEN py1 BETWEEN 0 AND h THEN py1 END AS y FROM q""",
)
def viewport_xy(spark, d):
    xy = G.Viewport.of().text(F.col("x1"), F.col("y1"))
    return _entities(spark, d).select(*KEY, *[c.alias(n) for n, c in xy.items()])


@query(
    "viewport_legend_pad",
    _SCALED
    + """SELECT dwg_id, id, px1 - 3 AS x1, least(py1, py2) - 3 AS y1, px2 + 3 AS x2,
    greatest(py1, py2) + 3 AS y2 FROM q WHERE ok""",
)
def viewport_legend_pad(spark, d):
    padded = _entities(spark, d).select(
        *KEY, *[c.alias(n) for n, c in G.Viewport.of().padded_rect(S, 3).items()]
    )
    return padded.where("x1 IS NOT NULL")


def _per_px(w, h):
    return (
        f"CASE WHEN {h} / {w} > (ry2 - ry1) / (rx2 - rx1) THEN (rx2 - rx1) / {w}"
        f" ELSE (ry2 - ry1) / {h} END"
    )


@query(
    "pdf_zoom",
    f"WITH {cte('drawings')} SELECT dwg_id, round({_per_px('1684.0::DOUBLE', '1191.0::DOUBLE')} / 10, 6)"
    " AS zoom FROM drawings",
)
def pdf_zoom(spark, d):
    return view(spark, d, "drawings").select(
        "dwg_id", r6(G.pdf_zoom(G.cols("rx1 ry1 rx2 ry2"))).alias("zoom")
    )


@query(
    "mm_per_px",
    f"WITH {cte('drawings')} SELECT dwg_id, round({_per_px('1600.0::DOUBLE', '1280.0::DOUBLE')}, 6)"
    " AS mm FROM drawings",
)
def mm_per_px(spark, d):
    return view(spark, d, "drawings").select(
        "dwg_id", r6(G.mm_per_px(G.cols("rx1 ry1 rx2 ry2"))).alias("mm")
    )


# --- rectangles -----------------------------------------------------------

_RP = f"WITH {cte('rect_pairs')} "


@query(
    "rect_in_range",
    _RP + "SELECT dwg_id, id FROM rect_pairs WHERE ax1 <= bx1 AND ay1 <= by1 AND ax2 >= bx2 AND ay2 >= by2",
)
def rect_in_range(spark, d):
    return view(spark, d, "rect_pairs").where(G.rect_inside(BB, A)).select(*KEY)


@query(
    "rect_to_ring",
    _RP
    + """SELECT dwg_id, id, i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (
    SELECT dwg_id, id, 0 AS i, ax1 AS x, ay1 AS y FROM rect_pairs UNION ALL
    SELECT dwg_id, id, 1, ax2, ay1 FROM rect_pairs UNION ALL
    SELECT dwg_id, id, 2, ax2, ay2 FROM rect_pairs UNION ALL
    SELECT dwg_id, id, 3, ax1, ay2 FROM rect_pairs)""",
)
def rect_to_ring(spark, d):
    ring = view(spark, d, "rect_pairs").select(*KEY, F.posexplode(G.rect_to_ring(A)).alias("i", "p"))
    return ring.select(*KEY, "i", "p.x", "p.y")


@query(
    "rect_distance",
    _RP
    + """SELECT dwg_id, id, round(sqrt(dx * dx + dy * dy), 6) AS dist FROM (SELECT dwg_id, id,
    greatest(0, greatest(ax1, bx1) - least(ax2, bx2)) AS dx,
    greatest(0, greatest(ay1, by1) - least(ay2, by2)) AS dy FROM rect_pairs)""",
)
def rect_distance(spark, d):
    return view(spark, d, "rect_pairs").select(*KEY, r6(G.rect_distance(A, BB)).alias("dist"))


@query(
    "rects_overlap",
    _RP
    + """SELECT dwg_id, id, (ax2 > bx1 AND bx2 > ax1 AND ay2 > by1 AND by2 > ay1) AS hit,
    CASE WHEN ax1 <= bx1 AND ay1 <= by1 AND ax2 >= bx2 AND ay2 >= by2 THEN 1
      WHEN ax1 >= bx1 AND ay1 >= by1 AND ax2 <= bx2 AND ay2 <= by2 THEN 2 ELSE 0 END AS holds,
    (abs(ax1 - bx1) < 0.001 AND abs(ay1 - by1) < 0.001 AND abs(ax2 - bx2) < 0.001
      AND abs(ay2 - by2) < 0.001) AS same FROM rect_pairs""",
)
def rects_overlap(spark, d):
    return view(spark, d, "rect_pairs").select(
        *KEY,
        G.rects_overlap(A, BB).alias("hit"),
        G.rect_containment(A, BB).alias("holds"),
        G.rects_close(A, BB).alias("same"),
    )


@query(
    "point_rect_distance",
    _RP
    + """SELECT dwg_id, id, round(sqrt(dx * dx + dy * dy), 6) AS dist FROM (SELECT dwg_id, id,
    bx1 - greatest(ax1, least(bx1, ax2)) AS dx, by1 - greatest(ay1, least(by1, ay2)) AS dy FROM rect_pairs)""",
)
def point_rect_distance(spark, d):
    dist = G.point_rect_distance(F.col("bx1"), F.col("by1"), A)
    return view(spark, d, "rect_pairs").select(*KEY, r6(dist).alias("dist"))


_SLANT = f"WITH {cte('slants')} "
_LINE_D = (
    "abs((y2 - y1) * {x} - (x2 - x1) * {y} + x2 * y1 - y2 * x1)"
    " / nullif(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0)"
)


@query(
    "point_line_distance",
    _SLANT + f"SELECT dwg_id, id, round({_LINE_D.format(x='200', y='200')}, 6) AS dist FROM slants",
)
def point_line_distance(spark, d):
    dist = G.point_line_distance(F.lit(200), F.lit(200), S)
    return view(spark, d, "slants").select(*KEY, r6(dist).alias("dist"))


_CORNER = """c AS (SELECT *, abs((by2 - by1) * px - (bx2 - bx1) * py + bx2 * by1 - by2 * bx1)
    / nullif(sqrt((bx2 - bx1) * (bx2 - bx1) + (by2 - by1) * (by2 - by1)), 0) AS dd FROM (
    SELECT *, 0 AS k, ax1 AS px, ay1 AS py FROM rect_pairs UNION ALL
    SELECT *, 1, ax2, ay1 FROM rect_pairs UNION ALL SELECT *, 2, ax2, ay2 FROM rect_pairs UNION ALL
    SELECT *, 3, ax1, ay2 FROM rect_pairs)), far AS (SELECT * FROM c
    QUALIFY row_number() OVER (PARTITION BY dwg_id, id ORDER BY dd DESC, k) = 1) """


@query(
    "farthest_corner",
    f"WITH {cte('rect_pairs')}, {_CORNER} SELECT dwg_id, id, px AS x, py AS y, round(dd, 6) AS dist FROM far",
)
def farthest_corner(spark, d):
    corner = G.farthest_corner(A, BB)
    return view(spark, d, "rect_pairs").select(*KEY, corner.alias("c")).select(
        *KEY, "c.x", "c.y", r6(F.col("c.d")).alias("dist")
    )


@query(
    "rotate_point",
    f"""WITH {cte('rect_pairs')}, {_CORNER}, a AS (SELECT *,
    sqrt(pow(greatest(ax1 - bx1, bx1 - ax2, 0), 2) + pow(greatest(ay1 - by1, by1 - ay2, 0), 2)) AS d1,
    sqrt(pow(greatest(ax1 - bx2, bx2 - ax2, 0), 2) + pow(greatest(ay1 - by2, by2 - ay2, 0), 2)) AS d2
    FROM far), t AS (SELECT *,
    CASE WHEN d1 > d2 THEN atan2(by1 - py, bx1 - px) - atan2(by2 - py, bx2 - px)
      ELSE atan2(by2 - py, bx2 - px) - atan2(by1 - py, bx1 - px) END AS ang FROM a)
    SELECT dwg_id, id, round(cos(ang) * (ax1 - px) - sin(ang) * (ay1 - py) + px, 4) + 0 AS qx,
      round(sin(ang) * (ax1 - px) + cos(ang) * (ay1 - py) + py, 4) + 0 AS qy FROM t""",
)
def rotate_point(spark, d):
    x, y = G.swung_corners(A, BB)[0]
    return view(spark, d, "rect_pairs").select(
        *KEY, (F.round(x, 4) + 0).alias("qx"), (F.round(y, 4) + 0).alias("qy")
    )


_DIR = """m AS (SELECT *, (bx1 + bx2 - ax1 - ax2) / 2.0 AS dx, (by1 + by2 - ay1 - ay2) / 2.0 AS dy,
    (bx1 + bx2) / 2.0 BETWEEN ax1 AND ax2 AND (by1 + by2) / 2.0 BETWEEN ay1 AND ay2 AS in_a,
    (ax1 + ax2) / 2.0 BETWEEN bx1 AND bx2 AND (ay1 + ay2) / 2.0 BETWEEN by1 AND by2 AS in_b
    FROM rect_pairs), w AS (SELECT *, CASE WHEN dx < -1e-5 AND dy > 1e-5 THEN 1
    WHEN abs(dx) < 1e-5 AND dy > 1e-5 THEN 2 WHEN dx > 1e-5 AND dy > 1e-5 THEN 3
    WHEN dx > 1e-5 AND abs(dy) < 1e-5 THEN 4 WHEN dx > 1e-5 AND dy < -1e-5 THEN 5
    WHEN abs(dx) < 1e-5 AND dy < -1e-5 THEN 6 WHEN dx < -1e-5 AND dy < -1e-5 THEN 7
    WHEN dx < -1e-5 THEN 0 ELSE 8 END AS k FROM m), codes AS (SELECT dwg_id, id,
    CASE WHEN k = 8 OR in_a THEN k ELSE k + 10 END AS fwd,
    CASE WHEN k = 8 THEN 8 WHEN in_b THEN (k + 4) % 8 ELSE (k + 4) % 8 + 10 END AS rev FROM w) """


@query("direction_code", f"WITH {cte('rect_pairs')}, {_DIR} SELECT * FROM codes")
def direction_code(spark, d):
    fwd, rev = G.direction_codes(A, BB)
    return view(spark, d, "rect_pairs").select(*KEY, fwd.alias("fwd"), rev.alias("rev"))


@query(
    "rotate_code",
    f"""WITH {cte('rect_pairs')}, {_DIR} SELECT dwg_id, id, t AS turns,
    CASE WHEN fwd = 8 THEN 8 ELSE fwd // 10 * 10 + (fwd % 10 + 2 * t) % 8 END AS code
    FROM codes, (SELECT unnest([0, 1, 2, 3]) AS t)""",
)
def rotate_code(spark, d):
    fwd, _ = G.direction_codes(A, BB)
    turned = view(spark, d, "rect_pairs").select(
        *KEY, fwd.alias("fwd"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turns")
    )
    return turned.select(*KEY, "turns", G.rotated_code(F.col("fwd"), F.col("turns")).alias("code"))


# --- segments -----------------------------------------------------------------


@query(
    "seg_class",
    f"""WITH {cte('door_lines')} SELECT dwg_id, id, CASE WHEN abs(y2 - y1) <= 1 THEN 'h'
    WHEN abs(x2 - x1) <= 1 THEN 'v' ELSE 'o' END AS orient,
    round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 6) AS len FROM door_lines
    WHERE sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) BETWEEN 50 AND 150""",
)
def seg_class(spark, d):
    lines = view(spark, d, "door_lines").withColumns(
        {"orient": G.seg_orientation(S, 1), "len": G.seg_length(S)}
    )
    return lines.where("len BETWEEN 50 AND 150").select(*KEY, "orient", r6(F.col("len")).alias("len"))


_CROSS = """g AS (SELECT *, (ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1) AS det FROM rect_pairs),
  tu AS (SELECT *, ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / nullif(det, 0) AS t,
  ((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / nullif(det, 0) AS u FROM g) """


@query(
    "seg_intersect",
    f"""WITH {cte('rect_pairs')}, {_CROSS} SELECT dwg_id, id, round(ax1 + t * (ax2 - ax1), 6) AS x,
    round(ay1 + t * (ay2 - ay1), 6) AS y, CAST(trunc(ax1 + t * (ax2 - ax1)) AS BIGINT) AS lx,
    CAST(trunc(ay1 + t * (ay2 - ay1)) AS BIGINT) AS ly FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""",
)
def seg_intersect(spark, d):
    pairs = view(spark, d, "rect_pairs").withColumns(
        {"p": G.seg_intersection(A, BB), "q": G.line_intersection(A, BB)}
    )
    return pairs.where("p IS NOT NULL").select(
        *KEY, r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"),
        F.col("q.x").alias("lx"), F.col("q.y").alias("ly"),
    )


@query(
    "seg_pixels",
    f"""WITH {cte('slants')}, p AS (SELECT *, abs(x2 - x1) AS dx, abs(y2 - y1) AS dy,
    CASE WHEN x1 < x2 THEN 1 ELSE -1 END AS sx, CASE WHEN y1 < y2 THEN 1 ELSE -1 END AS sy FROM slants),
    c AS (SELECT *, unnest(range(greatest(dx, dy) + 1)) AS step FROM p)
    SELECT dwg_id, id, step,
      x1 + sx * CASE WHEN dx >= dy THEN step
        ELSE CAST(ceil((2 * step * dx - dy) / (2.0 * dy)) AS BIGINT) END AS x,
      y1 + sy * CASE WHEN dx < dy THEN step WHEN dx = 0 THEN 0
        ELSE CAST(ceil((2 * step * dy - dx) / (2.0 * dx)) AS BIGINT) END AS y FROM c""",
)
def seg_pixels(spark, d):
    return pixels(view(spark, d, "slants"), KEY)


# --- rings ----------------------------------------------------------------------

HEX_POINTS = [
    ("ox", "oy"), ("ox + w", "oy"), ("ox + w", "oy + cy"), ("ox + cx", "oy + cy"),
    ("ox + cx", "oy + h"), ("ox", "oy + h"),
]


def hex_rings(spark, d):
    """L-shaped rings with one reflex corner."""
    ring = G.ring_of([(F.expr(x), F.expr(y)) for x, y in HEX_POINTS])
    return view(spark, d, "hexagons").withColumn("ring", ring)


HEX_SQL = cte("hexagons") + ", verts AS (" + " UNION ALL ".join(
    f"SELECT dwg_id, id, {i} AS i, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM hexagons"
    for i, (x, y) in enumerate(HEX_POINTS)
) + """), hex_edges AS (SELECT a.dwg_id, a.id, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM verts a JOIN verts b ON a.id = b.id AND b.i = (a.i + 1) % 6) """


@query(
    "ring_to_rect",
    f"WITH {HEX_SQL} SELECT dwg_id, id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM verts GROUP BY 1, 2",
)
def ring_to_rect(spark, d):
    return hex_rings(spark, d).select(*KEY, *[c.alias(n) for n, c in G.ring_bounds(F.col("ring")).items()])


@query(
    "ring_round",
    f"WITH {HEX_SQL} SELECT dwg_id, id, i, round_even(x / 4, 0) AS x, round_even(y / 4, 0) AS y FROM verts",
)
def ring_round(spark, d):
    quarter = F.transform("ring", lambda p: F.struct((p["x"] / 4).alias("x"), (p["y"] / 4).alias("y")))
    return hex_rings(spark, d).select(*KEY, F.posexplode(G.ring_round(quarter)).alias("i", "p")).select(
        *KEY, "i", "p.x", "p.y"
    )


@query(
    "ring_area",
    f"""WITH {HEX_SQL} SELECT dwg_id, id, round(abs(sum(x1 * y2 - x2 * y1)) / 2 / 1e4, 6) AS area
    FROM hex_edges GROUP BY 1, 2""",
)
def ring_area(spark, d):
    return hex_rings(spark, d).select(*KEY, r6(G.ring_area(F.col("ring")) / 1e4).alias("area"))


@query(
    "ring_perimeter",
    f"""WITH {HEX_SQL} SELECT dwg_id, id, round(sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) / 1e2, 6)
    AS perimeter FROM hex_edges GROUP BY 1, 2""",
)
def ring_perimeter(spark, d):
    return hex_rings(spark, d).select(*KEY, r6(G.ring_perimeter(F.col("ring")) / 1e2).alias("perimeter"))



@query(
    "point_in_polygon",
    f"""WITH {HEX_SQL}, q AS (SELECT id, ox + 20 + id % 60 AS px, oy + cy - 8 + id % 16 AS py FROM hexagons)
    SELECT e.dwg_id, e.id, count(*) FILTER (WHERE (y1 > py) <> (y2 > py) AND
      px < x1 + (py - y1) * (x2 - x1) / nullif(y2 - y1, 0)) % 2 = 1 AND count(*) FILTER (WHERE
      px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2)) = 0
      AS inside FROM hex_edges e JOIN q USING (id) GROUP BY 1, 2""",
)
def point_in_polygon(spark, d):
    px, py = F.expr("ox + 20 + id % 60"), F.expr("oy + cy - 8 + id % 16")
    return hex_rings(spark, d).select(*KEY, G.point_in_ring(F.col("ring"), px, py).alias("inside"))


@query(
    "point_on_boundary",
    f"""WITH {HEX_SQL}, q AS (SELECT id, ox + 20 + id % 60 AS px, oy + cy - 2 + id % 4 AS py FROM hexagons)
    SELECT e.dwg_id, e.id, bool_or(px BETWEEN least(x1, x2) AND greatest(x1, x2)
      AND py BETWEEN least(y1, y2) AND greatest(y1, y2)) AS touching
    FROM hex_edges e JOIN q USING (id) GROUP BY 1, 2""",
)
def point_on_boundary(spark, d):
    px, py = F.expr("ox + 20 + id % 60"), F.expr("oy + cy - 2 + id % 4")
    return hex_rings(spark, d).select(*KEY, G.point_on_boundary(F.col("ring"), px, py).alias("touching"))


@query(
    "vertex_turns",
    f"""WITH {HEX_SQL}, w AS (SELECT dwg_id, id, i, x, y,
      coalesce(lag(x) OVER p, last_value(x) OVER a) AS ax, coalesce(lag(y) OVER p, last_value(y) OVER a) AS ay,
      coalesce(lead(x) OVER p, first_value(x) OVER a) AS cx, coalesce(lead(y) OVER p, first_value(y) OVER a) AS cy FROM verts
      WINDOW p AS (PARTITION BY id ORDER BY i), a AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT dwg_id, id, i, round((x - ax) * (cy - y) - (y - ay) * (cx - x), 6)
    AS turn, round(degrees(acos(greatest(-1, least(1, -((x - ax) * (cx - x) + (y - ay) * (cy - y))
      / sqrt((pow(x - ax, 2) + pow(y - ay, 2)) * (pow(cx - x, 2) + pow(cy - y, 2))))))), 6) AS angle
    FROM w""",
)
def vertex_turns(spark, d):
    turns = hex_rings(spark, d).select(*KEY, F.inline(G.vertex_turns(F.col("ring"))))
    return turns.select(*KEY, "i", r6(F.col("turn")).alias("turn"), r6(F.col("angle")).alias("angle"))


@query(
    "letterbox_points",
    f"""WITH {HEX_SQL} SELECT v.dwg_id, v.id, v.i, round_even((v.x + 50) * (640 / 500.0::DOUBLE), 0) AS x,
    round_even(v.y * (640 / 500.0::DOUBLE), 0) AS y FROM verts v""",
)
def letterbox_points(spark, d):
    boxed = G.ring_letterbox(F.col("ring"), F.lit(400), F.lit(500))
    return hex_rings(spark, d).select(*KEY, F.posexplode(boxed).alias("i", "p")).select(
        *KEY, "i", "p.x", "p.y"
    )


@query(
    "ring_normalise",
    f"""WITH {HEX_SQL} SELECT dwg_id, id, i, round(trunc(x) / 400, 6) AS x, round(trunc(y) / 500, 6) AS y
    FROM verts""",
)
def ring_normalise(spark, d):
    ring = G.ring_normalise(F.col("ring"), F.lit(400), F.lit(500))
    return hex_rings(spark, d).select(*KEY, F.posexplode(ring).alias("i", "p")).select(
        *KEY, "i", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y")
    )


# --- YOLO boxes -------------------------------------------------------------------

_YOLO = f"WITH {cte('boxes')}, yolo AS (SELECT image_id, box_no, cls, cx / 1000 AS cx, cy / 1000 AS cy, w / 1000 AS w, h / 1000 AS h FROM boxes) "
YKEY = ["image_id", "box_no"]
Y = G.cols("cx cy w h")


def yolo(spark, d):
    b = view(spark, d, "boxes")
    return b.select("image_id", "box_no", "cls", *[(F.col(c) / 1000).alias(c) for c in ("cx", "cy", "w", "h")])


@query(
    "yolo_to_pixel",
    _YOLO
    + """SELECT image_id, box_no, CAST(trunc(cx * 1600 - w * 1600 / 2) AS BIGINT) AS x1,
    CAST(trunc(cy * 1280 - h * 1280 / 2) AS BIGINT) AS y1, CAST(trunc(cx * 1600 + w * 1600 / 2) AS BIGINT) AS x2,
    CAST(trunc(cy * 1280 + h * 1280 / 2) AS BIGINT) AS y2 FROM yolo""",
)
def yolo_to_pixel(spark, d):
    px = B.yolo_to_pixel(*Y, F.lit(1600), F.lit(1280))
    return yolo(spark, d).select(*YKEY, *[c.alias(n) for n, c in px.items()])


@query(
    "pixel_to_yolo",
    f"""WITH {cte('rects')} SELECT dwg_id, id, round((x1 + x2) / 2 / 500, 6) AS cx, round((y1 + y2) / 2 / 450, 6) AS cy,
    round((x2 - x1) / 500, 6) AS w, round((y2 - y1) / 450, 6) AS h FROM rects""",
)
def pixel_to_yolo(spark, d):
    box = B.pixel_to_yolo(S, F.lit(500), F.lit(450))
    return view(spark, d, "rects").select(*KEY, *[r6(c).alias(n) for n, c in box.items()])


@query(
    "yolo_to_coco_box",
    _YOLO
    + """SELECT image_id, box_no, round((cx - w / 2) * 640, 6) AS bx, round((cy - h / 2) * 480, 6) AS "by",
    round(w * 640, 6) AS bw, round(h * 480, 6) AS bh, round(w * 640 * (h * 480), 6) AS area FROM yolo""",
)
def yolo_to_coco_box(spark, d):
    box = B.yolo_to_coco(*Y, F.lit(640), F.lit(480))
    return yolo(spark, d).select(*YKEY, *[r6(c).alias(n) for n, c in box.items()])


_VALID = (
    "cx > 0 AND cx < 1 AND cy > 0 AND cy < 1 AND w > 0 AND w < 1 AND h > 0 AND h < 1 AND cx - w / 2 > 0"
    " AND cx + w / 2 < 1 AND cy - h / 2 > 0 AND cy + h / 2 < 1"
)


@query("yolo_valid", _YOLO + f"SELECT image_id, box_no FROM yolo WHERE {_VALID}")
def yolo_valid(spark, d):
    return yolo(spark, d).where(B.yolo_valid(*Y)).select(*YKEY)


@query(
    "yolo_split_aspect",
    _YOLO
    + """, k AS (SELECT *, h / w > 1.5 AS tall, h / w < 0.75 AS flat FROM yolo)
    SELECT image_id, box_no, 0 AS part, cls, round(CASE WHEN flat THEN cx - w / 4 ELSE cx END, 6) AS cx,
      round(CASE WHEN tall THEN cy - h / 4 ELSE cy END, 6) AS cy, round(CASE WHEN flat THEN w / 2 ELSE w END, 6) AS w,
      round(CASE WHEN tall THEN h / 2 ELSE h END, 6) AS h FROM k
    UNION ALL SELECT image_id, box_no, 1, 0, round(CASE WHEN flat THEN cx + w / 4 ELSE cx END, 6),
      round(CASE WHEN tall THEN cy + h / 4 ELSE cy END, 6), round(CASE WHEN flat THEN w / 2 ELSE w END, 6),
      round(CASE WHEN tall THEN h / 2 ELSE h END, 6) FROM k WHERE tall OR flat""",
)
def yolo_split_aspect(spark, d):
    halves = B.split_by_aspect(yolo(spark, d))
    return halves.select(*YKEY, "part", "cls", *[r6(F.col(c)).alias(c) for c in ("cx", "cy", "w", "h")])


@query(
    "augment_geometry",
    _YOLO
    + """, v AS (SELECT image_id, box_no, 'keep' AS variant, cx, cy, w, h FROM yolo
    UNION ALL SELECT image_id, box_no, 'flip', 1 - cx, cy, w, h FROM yolo
    UNION ALL SELECT image_id, box_no, 'rot90', cy, 1 - cx, h, w FROM yolo
    UNION ALL SELECT image_id, box_no, 'rot180', 1 - cx, 1 - cy, w, h FROM yolo
    UNION ALL SELECT image_id, box_no, 'rot270', 1 - cy, cx, h, w FROM yolo)
    SELECT image_id, box_no, variant, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h
    FROM v WHERE cx > 0 AND cx < 1 AND cy > 0 AND cy < 1 AND w > 0 AND w < 1 AND h > 0 AND h < 1""",
)
def augment_geometry(spark, d):
    copies = B.augment(yolo(spark, d))
    return copies.select(*YKEY, "variant", *[r6(F.col(c)).alias(c) for c in ("cx", "cy", "w", "h")])
