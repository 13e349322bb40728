"""Rectangle and door queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark.catalog.bindings import cte, view
from planspark.catalog.registry import query
from planspark.operators import doors as D
from planspark.operators import rects as R

K = ["dwg_id"]
BOX = ["x1", "y1", "x2", "y2"]

PAIRS_SQL = """ln AS (SELECT dwg_id, CASE WHEN abs(y2 - y1) <= 1 THEN 0 WHEN abs(x2 - x1) <= 1 THEN 1 END AS otype, *
    EXCLUDE (dwg_id) FROM door_lines WHERE sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) BETWEEN 50 AND 150),
  e AS (SELECT dwg_id, id, otype, CASE otype WHEN 0 THEN least(x1, x2) ELSE least(y1, y2) END AS lo,
    CASE otype WHEN 0 THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS hi,
    CASE otype WHEN 0 THEN y1 ELSE x1 END AS o FROM ln WHERE otype IS NOT NULL),
  pairs AS (SELECT DISTINCT a.dwg_id, a.otype, CASE a.otype WHEN 0 THEN a.lo ELSE least(a.o, b.o) END AS x1,
    CASE a.otype WHEN 0 THEN least(a.o, b.o) ELSE a.lo END AS y1, CASE a.otype WHEN 0 THEN a.hi ELSE greatest(a.o, b.o) END AS x2,
    CASE a.otype WHEN 0 THEN greatest(a.o, b.o) ELSE a.hi END AS y2
    FROM e a JOIN e b ON a.dwg_id = b.dwg_id AND a.otype = b.otype AND a.lo = b.lo AND a.hi = b.hi AND a.id < b.id
      AND abs(a.o - b.o) <= 15)"""


@query("door_line_pairs", f"WITH {cte('door_lines')}, {PAIRS_SQL} SELECT * FROM pairs")
def door_line_pairs(spark, d):
    return D.door_line_pairs(view(spark, d, "door_lines"), K)


@query(
    "rect_drop_contained",
    f"""WITH {cte('rects')} SELECT dwg_id, otype, id, x1, y1, x2, y2 FROM rects r WHERE NOT EXISTS (SELECT 1 FROM rects s
    WHERE s.dwg_id = r.dwg_id AND s.otype = r.otype AND s.id <> r.id AND s.x1 <= r.x1 AND s.y1 <= r.y1 AND s.x2 >= r.x2
    AND s.y2 >= r.y2 AND (s.id < r.id OR s.x1 < r.x1 OR s.y1 < r.y1 OR s.x2 > r.x2 OR s.y2 > r.y2))""",
)
def rect_drop_contained(spark, d):
    return R.drop_contained(view(spark, d, "rects"), ["dwg_id", "otype"])


def merge_sql(source: str, keys: str, steps: int = 14) -> str:
    """Every rectangle grows to the bounds of all it overlaps, until nothing changes."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ks = ", ".join(f"a.{k}" for k in keys.split(", "))
    n = len(keys.split(", ")) + 5
    group = ", ".join(str(i) for i in range(1, len(keys.split(", ")) + 2)) + ", a.x1, a.y1, a.x2, a.y2"
    return f"""m AS (SELECT DISTINCT {keys}, 0 AS step, x1, y1, x2, y2 FROM {source} UNION
    SELECT DISTINCT {ks}, a.step + 1, min(b.x1), min(b.y1), max(b.x2), max(b.y2) FROM m a JOIN m b ON {on} AND a.step = b.step
      AND ((a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2) OR (a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2))
    WHERE a.step < {steps} GROUP BY {group}),
  merged AS (SELECT DISTINCT {keys}, x1, y1, x2, y2 FROM m WHERE step = {steps})"""


@query(
    "rect_merge_overlap",
    f"WITH RECURSIVE {cte('rects')}, {merge_sql('rects', 'dwg_id, otype')} SELECT * FROM merged",
)
def rect_merge_overlap(spark, d):
    merged = R.merge_overlapping(view(spark, d, "rects"), ["dwg_id", "otype"])
    return merged.select("dwg_id", "otype", *BOX)


_HIT = """h AS (SELECT r.*, a.id AS arc_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, a.px1, a.py1, a.px2, a.py2
    FROM door_rects r JOIN arcs a ON a.dwg_id = r.dwg_id AND greatest(r.x1, a.x1) - least(r.x2, a.x2) <= 5
      AND greatest(r.y1, a.y1) - least(r.y2, a.y2) <= 5
    QUALIFY row_number() OVER (PARTITION BY r.dwg_id, r.id ORDER BY a.id) = 1)"""
_CLOSED = f"""{_HIT}, dd AS (SELECT *,
    sqrt(pow(greatest(x1 - px1, px1 - x2, 0), 2) + pow(greatest(y1 - py1, py1 - y2, 0), 2)) >
    sqrt(pow(greatest(x1 - px2, px2 - x2, 0), 2) + pow(greatest(y1 - py2, py2 - y2, 0), 2)) AS flip FROM h),
  st AS (SELECT *, CASE WHEN flip THEN px1 - px2 ELSE px2 - px1 END AS tx, CASE WHEN flip THEN py1 - py2 ELSE py2 - py1 END AS ty,
    least(x1, ax1) AS u1, least(y1, ay1) AS v1, greatest(x2, ax2) AS u2, greatest(y2, ay2) AS v2 FROM dd),
  cl AS (SELECT dwg_id, id, arc_id,
    CASE WHEN otype = 1 THEN u1 WHEN tx < 0 THEN u1 - (y2 - y1) ELSE u2 END AS c_x1,
    CASE WHEN otype = 1 THEN u2 WHEN tx < 0 THEN u1 ELSE u2 + (y2 - y1) END AS c_x2,
    CASE WHEN otype = 0 THEN v1 WHEN ty < 0 THEN v1 - (x2 - x1) ELSE v2 END AS c_y1,
    CASE WHEN otype = 0 THEN v2 WHEN ty < 0 THEN v1 ELSE v2 + (x2 - x1) END AS c_y2 FROM st)"""


@query(
    "door_arc_match",
    f"""WITH {cte('door_rects', 'arcs')}, {_CLOSED} SELECT r.dwg_id, r.id, arc_id, c_x1, c_y1, c_x2, c_y2
    FROM door_rects r LEFT JOIN cl ON cl.dwg_id = r.dwg_id AND cl.id = r.id""",
)
def door_arc_match(spark, d):
    found = D.door_arc_match(view(spark, d, "door_rects"), view(spark, d, "arcs"), K)
    return found.select("dwg_id", "id", "arc_id", "c_x1", "c_y1", "c_x2", "c_y2")


@query(
    "door_arc_match_bbox",
    f"""WITH RECURSIVE {cte('door_rects', 'arcs')}, {_HIT}, bb AS (SELECT dwg_id, least(x1, ax1) AS x1, least(y1, ay1) AS y1,
    greatest(x2, ax2) AS x2, greatest(y2, ay2) AS y2 FROM h), {merge_sql('bb', 'dwg_id')} SELECT * FROM merged""",
)
def door_arc_match_bbox(spark, d):
    return D.door_arc_match_bbox(view(spark, d, "door_rects"), view(spark, d, "arcs"), K).select(*K, *BOX)


_DOUBLE = """cand AS (SELECT a.dwg_id, a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.dwg_id ORDER BY a.id, b.id) AS k
    FROM arcs a JOIN arcs b ON a.dwg_id = b.dwg_id AND a.id < b.id AND (((a.x1 = b.x2 OR a.x2 = b.x1) AND a.y1 <= b.y2 AND a.y2 >= b.y1)
      OR ((a.y1 = b.y2 OR a.y2 = b.y1) AND a.x1 <= b.x2 AND a.x2 >= b.x1))
      AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) = 0),
  walk AS (SELECT dwg_id, 0 AS k, []::BIGINT[] AS used, NULL::BIGINT AS i, NULL::BIGINT AS j FROM (SELECT DISTINCT dwg_id FROM cand) UNION ALL
    SELECT w.dwg_id, c.k, CASE WHEN list_has_any(used, [c.i, c.j]) THEN used ELSE list_concat(used, [c.i, c.j]) END,
      CASE WHEN NOT list_has_any(used, [c.i, c.j]) THEN c.i END, CASE WHEN NOT list_has_any(used, [c.i, c.j]) THEN c.j END
    FROM walk w JOIN cand c ON c.dwg_id = w.dwg_id AND c.k = w.k + 1),
  pick AS (SELECT dwg_id, i, j FROM walk WHERE i IS NOT NULL),
  doors AS (SELECT p.dwg_id, p.i AS id, 'double' AS kind, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1,
    greatest(a.x2, b.x2) AS x2, greatest(a.y2, b.y2) AS y2 FROM pick p JOIN arcs a ON a.id = p.i JOIN arcs b ON b.id = p.j
    UNION ALL SELECT dwg_id, id, 'single', x1, y1, x2, y2 FROM arcs WHERE id NOT IN (SELECT i FROM pick UNION ALL SELECT j FROM pick))"""


@query("double_door_merge", f"WITH RECURSIVE {cte('arcs')}, {_DOUBLE} SELECT * FROM doors")
def double_door_merge(spark, d):
    return D.double_door_merge(view(spark, d, "arcs"), K)


def slide_sql(source: str, keys: str = "dwg_id, otype") -> str:
    """The loop over the leaves of each group in id order, as a recursion; doors in ``slides``."""
    on = ", ".join(f"w.{k}" for k in keys.split(", "))
    grown = "{'id': cur.id, 'x1': least(cur.x1, c.x1), 'y1': least(cur.y1, c.y1), 'x2': greatest(cur.x2, c.x2), 'y2': greatest(cur.y2, c.y2)}"
    near = (
        "greatest(cur.x1, r.x1) - least(cur.x2, r.x2) <= 10 AND greatest(cur.y1, r.y1) - least(cur.y2, r.y2) <= 10"
        " AND NOT (cur.x1 = r.x1 AND cur.x2 = r.x2) AND NOT (cur.y1 = r.y1 AND cur.y2 = r.y2)"
    )
    return f"""lf AS (SELECT {keys}, list({{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY id) AS ls FROM {source} GROUP BY ALL),
  wa AS (SELECT {keys}, ls[1] AS cur, ls[2:] AS rest, 0 AS n, ls[1] AS door, FALSE AS made FROM lf
    UNION ALL SELECT {on}, CASE WHEN c IS NOT NULL THEN {grown} ELSE rest[1] END,
      CASE WHEN c IS NOT NULL THEN list_filter(rest, lambda r: r.id <> c.id) ELSE rest[2:] END,
      CASE WHEN c IS NOT NULL THEN n + 1 ELSE 0 END, cur, c IS NULL AND n > 0
    FROM (SELECT *, list_filter(rest, lambda r: {near})[1] AS c FROM wa WHERE cur IS NOT NULL) w),
  slides AS (SELECT {keys}, door.id AS id, door.x1 AS x1, door.y1 AS y1, door.x2 AS x2, door.y2 AS y2 FROM wa WHERE made)"""


@query("slide_door_merge", f"WITH RECURSIVE {cte('door_rects')}, {slide_sql('door_rects')} SELECT * FROM slides")
def slide_door_merge(spark, d):
    return D.slide_door_merge(view(spark, d, "door_rects"), ["dwg_id", "otype"])


# leaves: pairs without contained ones, overlaps merged; a merged leaf has the smallest number of those it holds
_LEAVES = f"""{PAIRS_SQL}, nu AS (SELECT *, row_number() OVER (PARTITION BY dwg_id ORDER BY otype, y1, x1, x2, y2) AS id FROM pairs),
  dc AS (SELECT * FROM nu r WHERE NOT EXISTS (SELECT 1 FROM nu s WHERE s.dwg_id = r.dwg_id AND s.otype = r.otype AND s.id <> r.id AND s.x1 <= r.x1 AND s.y1 <= r.y1
    AND s.x2 >= r.x2 AND s.y2 >= r.y2)), {merge_sql('dc', 'dwg_id, otype')},
  lv AS (SELECT g.dwg_id, g.otype, g.x1, g.y1, g.x2, g.y2, min(dc.id) AS id FROM merged g JOIN dc ON dc.dwg_id = g.dwg_id AND dc.otype = g.otype AND dc.x1 >= g.x1
    AND dc.y1 >= g.y1 AND dc.x2 <= g.x2 AND dc.y2 <= g.y2 GROUP BY ALL),
  fr AS (SELECT * FROM lv r WHERE NOT EXISTS (SELECT 1 FROM arcs a WHERE a.dwg_id = r.dwg_id AND greatest(r.x1, a.x1) - least(r.x2, a.x2) <= 5
    AND greatest(r.y1, a.y1) - least(r.y2, a.y2) <= 5))"""


@query(
    "doors_classify",
    f"""WITH RECURSIVE {cte('door_lines', 'arcs')}, {_LEAVES}, {slide_sql('fr')}, {_DOUBLE}, al AS (SELECT dwg_id, kind FROM doors UNION ALL SELECT dwg_id, 'slide' FROM slides
      UNION ALL SELECT dwg_id, 'closed' FROM lv ANTI JOIN fr USING (dwg_id, id))
    SELECT dwg_id, count(*) FILTER (kind = 'single') AS single, count(*) FILTER (kind = 'double') AS double, count(*) FILTER (kind = 'slide') AS slide,
      count(*) FILTER (kind = 'closed') AS closed FROM al GROUP BY 1""",
)
def doors_classify(spark, d):
    doors = D.doors_classify(view(spark, d, "door_lines"), view(spark, d, "arcs"), K)
    counts = doors.groupBy("dwg_id").pivot("kind", ["single", "double", "slide", "closed"]).count()
    return counts.fillna(0)
