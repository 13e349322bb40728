"""Mask queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark.catalog.bindings import cte, view
from planspark.catalog.registry import query
from planspark.catalog.scalars import hex_rings, r6
from planspark.operators import masks as M
from planspark.operators import rooms as R
from planspark.session import cut

I = ["image_id"]
IS = ["image_id", "side"]
W, H = 200, 24
_PX = f"WITH RECURSIVE {cte('raw_runs')}, px AS (SELECT DISTINCT image_id, side, y, unnest(range(x0, x1 + 1)) AS x FROM raw_runs), t AS (SELECT * FROM px WHERE side = 0), p AS (SELECT * FROM px WHERE side = 1) "


def sides(spark, d, keys=("image_id",)):
    raw = view(spark, d, "raw_runs")
    return [cut(M.union_runs(raw.where(F.col("side") == s), keys)) for s in (0, 1)]


def both_sides(spark, d):
    """Masks of both sides, each of its own: keys image_id and side."""
    return cut(M.union_runs(view(spark, d, "raw_runs"), IS))


@query("mask_area_bbox", _PX + "SELECT image_id, side, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM px GROUP BY 1, 2")
def mask_area_bbox(spark, d):
    return M.area_bbox(both_sides(spark, d), IS)


@query(
    "mask_rle",
    _PX + f""", o AS (SELECT image_id, side, x * {H} + y AS k FROM px), g AS (SELECT image_id, side, k, k - row_number() OVER (PARTITION BY image_id, side ORDER BY k) AS g FROM o),
    r AS (SELECT image_id, side, min(k) AS start, max(k) + 1 AS e FROM g GROUP BY image_id, side, g)
    SELECT image_id, side, start, start - coalesce(lag(e) OVER (PARTITION BY image_id, side ORDER BY start), 0) AS zeros, e - start AS ones FROM r""",
)
def mask_rle(spark, d):
    return M.column_rle(both_sides(spark, d), IS, W, H)


@query(
    "pixel_metrics",
    _PX + f""", a AS (SELECT image_id, count(*) AS t FROM t GROUP BY 1), b AS (SELECT image_id, count(*) AS p FROM p GROUP BY 1),
    c AS (SELECT t.image_id, count(*) AS tp FROM t JOIN p USING (image_id, y, x) GROUP BY 1),
    k AS (SELECT image_id, coalesce(tp, 0) AS tp, coalesce(p, 0) - coalesce(tp, 0) AS fp, coalesce(t, 0) - coalesce(tp, 0) AS fn FROM a FULL JOIN b USING (image_id) LEFT JOIN c USING (image_id))
    SELECT image_id, round(({W * H} - fp - fn) / {W * H}, 6) AS accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS iou FROM k""",
)
def pixel_metrics(spark, d):
    t, p = sides(spark, d)
    m = M.pixel_metrics(t, p, I, W * H)
    return m.select("image_id", *[r6(F.col(c)).alias(c) for c in ("accuracy", "recall", "precision", "f1", "iou")])


@query(
    "pixel_metrics_by_class",
    f"""WITH {cte('raw_runs')}, q AS (SELECT DISTINCT image_id, side, cls, y, unnest(range(x0, x1 + 1)) AS x FROM raw_runs),
    a AS (SELECT cls, count(*) AS t FROM q WHERE side = 0 GROUP BY 1), b AS (SELECT cls, count(*) AS p FROM q WHERE side = 1 GROUP BY 1),
    c AS (SELECT l.cls, count(*) AS tp FROM q l JOIN q r USING (image_id, cls, y, x) WHERE l.side = 0 AND r.side = 1 GROUP BY 1),
    o AS (SELECT image_id, y, x, max(side = 0) AS in_t, max(side = 1) AS in_p FROM q GROUP BY 1, 2, 3),
    g AS (SELECT count(DISTINCT image_id) * {W * H} AS n, count(*) FILTER (WHERE in_t) AS t, count(*) FILTER (WHERE in_p) AS p, count(*) FILTER (WHERE in_t AND in_p) AS c FROM o),
    k AS (SELECT cls, coalesce(t, 0) AS t, coalesce(p, 0) AS p, coalesce(tp, 0) AS tp FROM a FULL JOIN b USING (cls) LEFT JOIN c USING (cls)
      UNION ALL SELECT 0, n - t, n - p, n - t - p + c FROM g)
    SELECT cls, round(coalesce(tp / nullif(t + p - tp, 0), 0), 6) AS iou, round(coalesce(tp / nullif(p, 0), 0), 6) AS precision,
      round(coalesce(tp / nullif(t, 0), 0), 6) AS recall FROM k""",
)
def pixel_metrics_by_class(spark, d):
    t, p = sides(spark, d, ("image_id", "cls"))
    out = M.pixel_metrics_by_class(t, p, "image_id", "cls", W * H)
    return out.select("cls", *[r6(F.col(c)).alias(c) for c in ("iou", "precision", "recall")])


@query(
    "pixel_boundary_f1",
    _PX + f""", bt AS (SELECT DISTINCT image_id, k FROM (SELECT image_id, y * {W} + x - 1 AS k FROM t UNION ALL SELECT image_id, y * {W} + x + 1 FROM t)
      WHERE k BETWEEN 0 AND {W * H - 1} AND (image_id, k) NOT IN (SELECT (image_id, y * {W} + x) FROM t)),
    bp AS (SELECT DISTINCT image_id, k FROM (SELECT image_id, y * {W} + x - 1 AS k FROM p UNION ALL SELECT image_id, y * {W} + x + 1 FROM p)
      WHERE k BETWEEN 0 AND {W * H - 1} AND (image_id, k) NOT IN (SELECT (image_id, y * {W} + x) FROM p)),
    f AS (SELECT image_id, count(*) FILTER (WHERE bt.k IS NOT NULL AND bp.k IS NOT NULL) AS i, count(*) AS u FROM bt FULL JOIN bp USING (image_id, k) GROUP BY 1)
    SELECT image_id, round(2 * i / (u + i), 6) AS boundary_f1 FROM f""",
)
def pixel_boundary_f1(spark, d):
    t, p = sides(spark, d)
    return M.boundary_f1(t, p, I, W, H).select("image_id", r6(F.col("boundary_f1")).alias("boundary_f1"))


@query(
    "run_components",
    _PX + """, n AS (SELECT image_id, side, y, x, y * 1000 + x AS k FROM px), rn AS (SELECT image_id, side, y, k, x - row_number() OVER (PARTITION BY image_id, side, y ORDER BY x) AS g, x FROM n),
    r AS (SELECT image_id, side, y, min(x) AS x0, max(x) AS x1, min(k) AS id FROM rn GROUP BY image_id, side, y, g),
    e AS (SELECT a.image_id, a.side, a.id AS a, b.id AS b FROM r a JOIN r b ON a.image_id = b.image_id AND a.side = b.side AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND a.x1 >= b.x0),
    cc AS (SELECT image_id, side, id, id AS comp FROM r UNION SELECT cc.image_id, cc.side, e.b, cc.comp FROM cc JOIN e ON e.image_id = cc.image_id AND e.side = cc.side AND e.a = cc.id WHERE cc.comp < e.b),
    m AS (SELECT image_id, side, id, min(comp) AS comp FROM cc GROUP BY 1, 2, 3)
    SELECT image_id, side, comp, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area FROM r JOIN m USING (image_id, side, id) GROUP BY 1, 2, 3 HAVING sum(x1 - x0 + 1) > 30""",
)
def run_components(spark, d):
    c = M.run_components(both_sides(spark, d), IS, 30)
    return c.select("image_id", "side", F.expr("comp.y * 1000 + comp.x0").alias("comp"), "area")


@query(
    "seg_mask_ratio",
    _PX + f""", s AS (SELECT image_id, side, cls, y, x0, x1 FROM raw_runs), q AS (SELECT DISTINCT image_id, y, x0, x1 FROM s WHERE side = 1),
    c AS (SELECT image_id, y, x0, x1, unnest(range(x0, x1 + 1)) AS x FROM q),
    h AS (SELECT c.image_id, c.y, c.x0, c.x1, count(*) / (c.x1 - c.x0 + 1) AS ratio FROM c JOIN t USING (image_id, y, x) GROUP BY 1, 2, 3, 4)
    SELECT image_id, y * 1000000 + x0 * 1000 + x1 AS id, round(ratio, 6) AS ratio FROM h WHERE ratio > 0.5""",
)
def seg_mask_ratio(spark, d):
    t, _ = sides(spark, d)
    raw = view(spark, d, "raw_runs").where("side = 1").select("image_id", "y", "x0", "x1").distinct()
    segs = raw.selectExpr("image_id", "y * 1000000 + x0 * 1000 + x1 AS id", "x0 AS x1", "y AS y1", "x1 AS x2", "y AS y2")
    return M.seg_mask_ratio(segs, t, I).select("image_id", "id", r6(F.col("ratio")).alias("ratio"))


def _hex_runs(spark, d):
    edges = R.ring_edge_table(hex_rings(spark, d), ["dwg_id"], "id")
    return M.polygon_to_runs(edges, ["dwg_id", "id"])


@query(
    "polygon_to_runs",
    f"""WITH {cte('hexagons')}, r AS (SELECT *, unnest(range(oy, oy + h)) AS y FROM hexagons)
    SELECT dwg_id, id, y, ox AS x0, CASE WHEN y < oy + cy THEN ox + w ELSE ox + cx END AS x1 FROM r""",
)
def polygon_to_runs(spark, d):
    return _hex_runs(spark, d)


@query(
    "polygon_iou",
    f"""WITH {cte('hexagons')}, r AS (SELECT *, unnest(range(oy, oy + h)) AS y FROM hexagons),
    f AS (SELECT dwg_id, id, y, ox AS x0, CASE WHEN y < oy + cy THEN ox + w ELSE ox + cx END AS x1 FROM r), n AS (SELECT id, sum(x1 - x0 + 1) AS n FROM f GROUP BY 1),
    c AS (SELECT a.dwg_id, a.id AS a, b.id AS b, sum(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1)) AS c FROM f a JOIN f b ON a.dwg_id = b.dwg_id AND a.id < b.id AND a.y = b.y GROUP BY 1, 2, 3)
    SELECT dwg_id, a, b, round(c / (p.n + q.n - c), 6) AS iou FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE c > 0""",
)
def polygon_iou(spark, d):
    from planspark.functions import geometry as G
    from planspark.operators.spatial import box_pairs

    runs = cut(_hex_runs(spark, d))
    ring = hex_rings(spark, d)
    box = ring.select("dwg_id", "id", *[c.alias(n) for n, c in G.ring_bounds(F.col("ring")).items()])
    pairs = box_pairs(box, box, ["dwg_id"], 128, where=F.col("a_id") < F.col("b_id")).select("dwg_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    out = M.polygon_iou(pairs, runs.withColumnRenamed("id", "a"), runs.withColumnRenamed("id", "b"), ["dwg_id"])
    return out.where("iou > 0").select("dwg_id", "a", "b", r6(F.col("iou")).alias("iou"))


_BOXES = "[{p}.ox, {p}.oy, {p}.ox + {p}.w, {p}.oy + {p}.cy, 1], [{p}.ox, {p}.oy, {p}.ox + {p}.cx, {p}.oy + {p}.h, 1], [{p}.ox, {p}.oy, {p}.ox + {p}.cx, {p}.oy + {p}.cy, -1]"


@query(
    "polygon_overlay_iou",
    f"""WITH {cte('hexagons')}, pr AS (SELECT a.dwg_id, a.id AS a, b.id AS b, a.w * a.cy + a.cx * (a.h - a.cy) AS na, b.w * b.cy + b.cx * (b.h - b.cy) AS nb,
      list_sum(list_transform([{_BOXES.format(p='a')}], lambda r: list_sum(list_transform([{_BOXES.format(p='b')}], lambda q:
        r[5] * q[5] * greatest(0, least(r[3], q[3]) - greatest(r[1], q[1])) * greatest(0, least(r[4], q[4]) - greatest(r[2], q[2])))))) AS c
      FROM hexagons a JOIN hexagons b ON a.dwg_id = b.dwg_id AND a.id < b.id)
    SELECT dwg_id, a, b, CAST(c AS DOUBLE) AS common, round(c / (na + nb - c), 6) AS iou FROM pr WHERE c > 0""",
)
def polygon_overlay_iou(spark, d):
    """The overlap of rings without pixels."""
    from planspark.functions import geometry as G
    from planspark.operators.spatial import box_pairs

    ring = hex_rings(spark, d)
    box = ring.select("dwg_id", "id", *[c.alias(n) for n, c in G.ring_bounds(F.col("ring")).items()])
    pairs = box_pairs(box, box, ["dwg_id"], 128, where=F.col("a_id") < F.col("b_id")).select("dwg_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    out = M.overlay_iou(pairs, ring.select("dwg_id", F.col("id").alias("a"), "ring"), ring.select("dwg_id", F.col("id").alias("b"), "ring"), ["dwg_id"])
    return out.where("common > 1e-6").select("dwg_id", "a", "b", r6(F.col("common")).alias("common"), r6(F.col("iou")).alias("iou"))
