"""Detection box queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark.catalog.bindings import cte, view
from planspark.catalog.registry import query
from planspark.catalog.scalars import r6
from planspark.operators import boxes as X

# corners in thousandths, whole numbers
_PX = f"""WITH RECURSIVE {cte('boxes')}, b AS (SELECT image_id, box_no AS id, cls, side, score, cx * 2 - w AS x1, cy * 2 - h AS y1,
  cx * 2 + w AS x2, cy * 2 + h AS y2 FROM boxes), t AS (SELECT * FROM b WHERE side = 0), p AS (SELECT * FROM b WHERE side = 1),
  pr AS (SELECT a.image_id, a.cls, a.id AS a_id, b.id AS b_id, greatest(a.x1, b.x1) AS u1, greatest(a.y1, b.y1) AS v1,
    least(a.x2, b.x2) AS u2, least(a.y2, b.y2) AS v2, (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb
    FROM t a JOIN p b ON a.image_id = b.image_id AND a.cls = b.cls),
  iou AS (SELECT image_id, cls, a_id, b_id, (u2 - u1) * (v2 - v1) / (sa + sb - (u2 - u1) * (v2 - v1)) AS iou FROM pr
    WHERE u2 >= u1 AND v2 >= v1) """


def corners(spark, d):
    return view(spark, d, "boxes").select(
        "image_id", F.col("box_no").alias("id"), "cls", "side", "score",
        (F.col("cx") * 2 - F.col("w")).alias("x1"), (F.col("cy") * 2 - F.col("h")).alias("y1"),
        (F.col("cx") * 2 + F.col("w")).alias("x2"), (F.col("cy") * 2 + F.col("h")).alias("y2"),
    )


def sides(spark, d):
    b = corners(spark, d)
    return b.where("side = 0").drop("side"), b.where("side = 1").drop("side")


CELL = 1000


@query("iou_pairs", _PX + "SELECT image_id, cls, a_id, b_id, round(iou, 6) AS iou FROM iou")
def iou_pairs(spark, d):
    t, p = sides(spark, d)
    pairs = X.iou_pairs(t, p, ["image_id", "cls"], CELL)
    return pairs.select("image_id", "cls", "a_id", "b_id", r6(F.col("iou")).alias("iou"))


@query(
    "detection_missed",
    _PX + """, best AS (SELECT t.image_id, t.id, coalesce(max(iou), 0) AS best FROM t LEFT JOIN iou ON iou.image_id = t.image_id
    AND a_id = t.id GROUP BY 1, 2), m AS (SELECT image_id, count(*) AS truth, count(*) FILTER (WHERE best <= 0.5) AS opn
    FROM best GROUP BY 1), f AS (SELECT image_id, count(*) AS found FROM p GROUP BY 1)
    SELECT image_id, coalesce(truth, 0) AS truth, CASE WHEN truth IS NULL OR found IS NULL
      THEN greatest(coalesce(truth, 0), coalesce(found, 0)) ELSE opn END AS missed FROM m FULL JOIN f USING (image_id)""",
)
def detection_missed(spark, d):
    t, p = sides(spark, d)
    return X.detection_missed(t, p, "image_id", "cls", cell=CELL)


_GREEDY = """walk AS (SELECT image_id, 0 AS k, []::BIGINT[] AS kept, NULL::BIGINT AS id FROM (SELECT DISTINCT image_id FROM rk) UNION ALL
    SELECT w.image_id, r.k, CASE WHEN list_has_any(kept, r.foes) THEN kept ELSE list_append(kept, r.id) END,
      CASE WHEN NOT list_has_any(kept, r.foes) THEN r.id END FROM walk w JOIN rk r ON r.image_id = w.image_id AND r.k = w.k + 1)"""


@query(
    "nms",
    _PX + f""", o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, id) AS k FROM b),
    e AS (SELECT a.image_id, a.id AS win, b.id AS lose FROM o a JOIN o b ON a.image_id = b.image_id AND a.k < b.k AND
      greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1) /
      ((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) - greatest(0, least(a.x2, b.x2) -
      greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1)) > 0.3),
    rk AS (SELECT o.image_id, o.id, o.k, coalesce(list(win) FILTER (WHERE win IS NOT NULL), []) AS foes FROM o LEFT JOIN e ON
      e.image_id = o.image_id AND e.lose = o.id GROUP BY 1, 2, 3), {_GREEDY} SELECT image_id, id FROM walk WHERE id IS NOT NULL""",
)
def nms(spark, d):
    return X.nms(corners(spark, d), ["image_id"], cell=CELL).select("image_id", "id")


@query(
    "label_dedupe",
    _PX + f""", o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY id) AS k FROM b),
    i AS (SELECT a.image_id, a.id AS win, b.id AS lose, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS iw,
      least(a.y2, b.y2) - greatest(a.y1, b.y1) AS ih, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
      FROM o a JOIN o b ON a.image_id = b.image_id AND a.k < b.k),
    e AS (SELECT * FROM i WHERE iw >= 0 AND ih >= 0 AND iw * ih / (s - iw * ih) > 0.5),
    rk AS (SELECT o.image_id, o.id, o.k, coalesce(list(win) FILTER (WHERE win IS NOT NULL), []) AS foes FROM o LEFT JOIN e ON
      e.image_id = o.image_id AND e.lose = o.id GROUP BY 1, 2, 3), {_GREEDY}
    SELECT image_id, id AS box_no FROM walk WHERE id IS NOT NULL""",
)
def label_dedupe(spark, d):
    b = corners(spark, d).withColumnRenamed("id", "box_no")
    return X.label_dedupe(b, ["image_id"], threshold=0.5, cell=CELL).select("image_id", "box_no")


_PR = """, best AS (SELECT t.cls, 0 AS s, t.id, coalesce(max(iou), 0) AS best FROM t LEFT JOIN iou ON iou.image_id = t.image_id AND a_id = t.id
    GROUP BY t.image_id, 1, 2, 3 UNION ALL SELECT p.cls, 1, p.id, coalesce(max(iou), 0) FROM p LEFT JOIN iou ON iou.image_id = p.image_id
    AND b_id = p.id GROUP BY p.image_id, 1, 2, 3),
  k AS (SELECT cls, th AS threshold, count(*) FILTER (WHERE best >= th) AS tp, count(*) FILTER (WHERE best < th AND s = 1) AS fp,
    count(*) FILTER (WHERE best < th AND s = 0) AS fn FROM best, (SELECT unnest([0.5, 0.75]::DOUBLE[]) AS th) GROUP BY 1, 2) """


@query(
    "instance_pr",
    _PX + _PR + """SELECT cls, threshold, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall
    FROM k WHERE threshold = 0.5""",
)
def instance_pr(spark, d):
    t, p = sides(spark, d)
    out = X.instance_pr(t, p, ["image_id", "cls"], ["cls"], cell=CELL)
    return out.select("cls", "threshold", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query("instance_ap", _PX + _PR + "SELECT cls, threshold, round(tp / (tp + fp), 6) AS ap FROM k")
def instance_ap(spark, d):
    t, p = sides(spark, d)
    out = X.instance_ap(t, p, ["image_id", "cls"], ["cls"], cell=CELL)
    return out.select("cls", "threshold", r6(F.col("ap")).alias("ap"))


@query(
    "instance_boundary_f1",
    _PX + """, g AS (SELECT a.cls, sqrt(pow(greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)), 2) +
      pow(greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2)), 2)) AS dist FROM t a JOIN p b ON a.image_id = b.image_id AND a.cls = b.cls),
    k AS (SELECT cls, count(*) FILTER (WHERE dist < 5) AS tp, count(*) AS pairs FROM g GROUP BY 1),
    f AS (SELECT cls, count(*) AS fp FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.image_id = p.image_id AND t.cls = p.cls
      AND t.x1 = p.x1 AND t.y1 = p.y1 AND t.x2 = p.x2 AND t.y2 = p.y2) GROUP BY 1)
    SELECT cls, round(2 * (tp / (tp + fp)) * (tp / pairs) / (tp / (tp + fp) + tp / pairs), 6) AS boundary_f1 FROM k JOIN f USING (cls)""",
)
def instance_boundary_f1(spark, d):
    t, p = sides(spark, d)
    return X.boundary_f1(t, p, ["image_id", "cls"], ["cls"], cell=CELL).select(
        "cls", r6(F.col("boundary_f1")).alias("boundary_f1")
    )
