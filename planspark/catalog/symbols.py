"""Legend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark.catalog.bindings import cte, view
from planspark.catalog.registry import query
from planspark.functions import text as T
from planspark.operators import legend as L
from planspark.session import cut

K = ["dwg_id"]
BOX = ["x1", "y1", "x2", "y2"]
REACH = 200

def _edges_sql(nodes: str, keys: str, same: str, reach: int, tag: str = "") -> str:
    """Edges ``ed`` of near nodes of the same drawing, block and whatever ``same`` asks; ``tag`` ends the names."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    gap = "sqrt(pow(greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)), 2) + pow(greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2)), 2))"
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""pr{tag} AS (SELECT {own}, a.id AS aid, b.id AS bid, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1,
      b.x2 AS bx2, b.y2 AS by2 FROM {nodes} a JOIN {nodes} b ON {on} AND a.block = b.block {same} AND a.id < b.id AND {gap} <= {reach}),
  mm{tag} AS (SELECT *, (bx1 + bx2 - ax1 - ax2) / 2.0 AS dx, (by1 + by2 - ay1 - ay2) / 2.0 AS dy,
    (bx1 + bx2) / 2.0 BETWEEN ax1 AND ax2 AND (by1 + by2) / 2.0 BETWEEN ay1 AND ay2 AS in_a,
    (ax1 + ax2) / 2.0 BETWEEN bx1 AND bx2 AND (ay1 + ay2) / 2.0 BETWEEN by1 AND by2 AS in_b FROM pr{tag}),
  ww{tag} AS (SELECT *, CASE WHEN dx < 0 AND dy > 0 THEN 1 WHEN dx = 0 AND dy > 0 THEN 2 WHEN dx > 0 AND dy > 0 THEN 3 WHEN dx > 0 AND dy = 0 THEN 4
    WHEN dx > 0 AND dy < 0 THEN 5 WHEN dx = 0 AND dy < 0 THEN 6 WHEN dx < 0 AND dy < 0 THEN 7 WHEN dx < 0 THEN 0 ELSE 8 END AS k FROM mm{tag}),
  ed{tag} AS MATERIALIZED (SELECT {keys}, aid AS src, bid AS dst, CASE WHEN k = 8 OR in_a THEN k ELSE k + 10 END AS weight FROM ww{tag} UNION ALL
    SELECT {keys}, bid, aid, CASE WHEN k = 8 THEN 8 WHEN in_b THEN (k + 4) % 8 ELSE (k + 4) % 8 + 10 END FROM ww{tag})"""


_N = f"WITH RECURSIVE {cte('legend_nodes')}, "
_E = _edges_sql("legend_nodes", "dwg_id", "AND a.line_id = b.line_id", REACH)
_C = _E + """, cc AS (SELECT dwg_id, id, id AS comp FROM legend_nodes UNION SELECT cc.dwg_id, e.dst, cc.comp FROM cc JOIN ed e
    ON e.dwg_id = cc.dwg_id AND e.src = cc.id WHERE cc.comp < e.dst),
  cm AS (SELECT dwg_id, id, min(comp) AS comp FROM cc GROUP BY 1, 2),
  gn AS (SELECT n.*, cm.comp FROM legend_nodes n JOIN cm USING (dwg_id, id))"""


def nodes(spark, d):
    return view(spark, d, "legend_nodes")


def edges(spark, d):
    return L.proximity_edges(nodes(spark, d), K, REACH, ("block", "line_id"))


def grouped(spark, d):
    return L.grouped_nodes(nodes(spark, d), edges(spark, d), K)


@query("proximity_edges", _N + _E + " SELECT * FROM ed")
def proximity_edges(spark, d):
    return edges(spark, d)


@query("edge_fn", _N + _E + " SELECT dwg_id, src, dst, 1 AS weight FROM ed")
def edge_fn(spark, d):
    """The same graph with a caller's weight function."""
    return L.proximity_edges(nodes(spark, d), K, REACH, ("block", "line_id"), edge=lambda a, b: (F.lit(1), F.lit(1)))


_DIRECTED = "(src % 7 + 2 * (dst % 5)) % 3 <> 0"
_STRONG_REACH = 600


@query(
    "strong_components",
    _N + _edges_sql("legend_nodes", "dwg_id", "AND a.line_id = b.line_id", _STRONG_REACH)
    + f""", de AS (SELECT dwg_id, src, dst FROM ed WHERE {_DIRECTED}),
    re AS (SELECT dwg_id, src, dst FROM de UNION SELECT re.dwg_id, re.src, de.dst FROM re JOIN de ON de.dwg_id = re.dwg_id AND de.src = re.dst),
    sc AS (SELECT a.dwg_id, a.src AS id, min(a.dst) AS comp FROM re a JOIN re b ON b.dwg_id = a.dwg_id AND b.src = a.dst AND b.dst = a.src GROUP BY 1, 2)
    SELECT n.dwg_id, n.id, least(n.id, coalesce(comp, n.id)) AS comp FROM legend_nodes n LEFT JOIN sc USING (dwg_id, id)""",
)
def strong_components(spark, d):
    """A graph with edges of one direction: some of the pairs are taken out."""
    near = L.proximity_edges(nodes(spark, d), K, _STRONG_REACH, ("block", "line_id")).where(_DIRECTED)
    return L.strong_components(nodes(spark, d), near, K).select("dwg_id", "id", "comp")


@query(
    "component_bbox",
    _N + _C + """, s AS (SELECT dwg_id, comp, count(*) AS size, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, arg_min(type, id) AS t,
    arg_min(line_id, id) AS line_id FROM gn GROUP BY 1, 2) SELECT dwg_id, comp, size, CASE WHEN size > 1 THEN 'Merge' ELSE t END AS type, line_id, x1, y1, x2, y2
    FROM s WHERE size > 1 OR t IN ('Block', 'Hatch')""",
)
def component_bbox(spark, d):
    return L.component_bbox(grouped(spark, d), K).select("dwg_id", "comp", "size", "type", "line_id", *BOX)


@query(
    "hatch_border_drop",
    _N + _C + """, hl AS (SELECT *, CASE WHEN type = 'Line' THEN x1 ELSE x2 END AS qx FROM gn),
    sd AS (SELECT dwg_id, comp, x1, y1, x1 AS x2, y2 FROM gn WHERE type = 'Hatch' UNION SELECT dwg_id, comp, x2, y1, x2, y2 FROM gn WHERE type = 'Hatch'
      UNION SELECT dwg_id, comp, x1, y2, x2, y2 FROM gn WHERE type = 'Hatch' UNION SELECT dwg_id, comp, x1, y1, x2, y1 FROM gn WHERE type = 'Hatch')
    SELECT dwg_id, id FROM gn g WHERE NOT (type = 'Line' AND EXISTS (SELECT 1 FROM sd WHERE sd.dwg_id = g.dwg_id AND sd.comp = g.comp AND sd.x1 = g.x1
      AND sd.y1 = g.y1 AND sd.x2 = g.x2 AND sd.y2 = g.y2))""",
)
def hatch_border_drop(spark, d):
    return L.drop_hatch_borders(cut(grouped(spark, d)), K).select("dwg_id", "id")


@query("legend_sort", f"WITH {cte('legend_nodes')} SELECT dwg_id, id, row_number() OVER (PARTITION BY dwg_id ORDER BY y1 DESC, x1, id) AS rn FROM legend_nodes")
def legend_sort(spark, d):
    return L.sorted_nodes(nodes(spark, d), K).select("dwg_id", "id", "rn")


@query("item_order", f"WITH {cte('rects')} SELECT dwg_id, id, row_number() OVER (PARTITION BY dwg_id ORDER BY id) AS item_order FROM rects")
def item_order(spark, d):
    from planspark.operators.ordering import ranked

    return ranked(view(spark, d, "rects").select("dwg_id", "id"), K, [F.col("id")], "item_order", bounded=False)


_ROWS = """gd AS (SELECT dwg_id, line_id FROM legend_nodes GROUP BY 1, 2 HAVING count(*) FILTER (WHERE type = 'Text') > 0 AND count(*) FILTER (WHERE type <> 'Text') > 0),
  rw AS (SELECT n.*, row_number() OVER (PARTITION BY dwg_id, line_id ORDER BY y1 DESC, x1, id) AS pos FROM legend_nodes n SEMI JOIN gd USING (dwg_id, line_id))"""


@query("legend_rows", _N + _ROWS + " SELECT dwg_id, line_id, id, pos FROM rw")
def legend_rows(spark, d):
    return L.legend_rows(nodes(spark, d), K).select("dwg_id", "line_id", "id", "pos")


@query(
    "legend_pairs",
    _N + _ROWS + """, wk AS (SELECT dwg_id, line_id, CAST(0 AS BIGINT) AS pos, NULL::BIGINT AS held, NULL::BIGINT AS hk, NULL::BIGINT AS label_id, NULL::BIGINT AS symbol_id
      FROM gd UNION ALL SELECT r.dwg_id, r.line_id, r.pos,
      CASE WHEN held IS NULL THEN r.id WHEN hk <> k THEN NULL ELSE held END, CASE WHEN held IS NULL THEN k WHEN hk <> k THEN NULL ELSE hk END,
      CASE WHEN held IS NOT NULL AND hk <> k THEN CASE WHEN k = 0 THEN r.id ELSE held END END,
      CASE WHEN held IS NOT NULL AND hk <> k THEN CASE WHEN k = 0 THEN held ELSE r.id END END
      FROM wk JOIN (SELECT *, CASE WHEN type = 'Text' THEN 0 ELSE 1 END AS k FROM rw) r ON r.dwg_id = wk.dwg_id AND r.line_id = wk.line_id AND r.pos = wk.pos + 1)
    SELECT dwg_id, line_id, label_id, symbol_id FROM wk WHERE label_id IS NOT NULL""",
)
def legend_pairs(spark, d):
    return L.legend_pairs(cut(L.legend_rows(nodes(spark, d), K)), K).select("dwg_id", "line_id", "label_id", "symbol_id")


KV = ["dwg_id", "vp"]
LEGEND_REACH, MODEL_REACH = 60, 90


def _has_cjk(text: str) -> str:
    from planspark.functions import dictionaries as D

    return f"regexp_matches({text}, '[{D.CJK_WIDE}]')"


#: The legend's symbols, their components without hatch borders, and the pairs read from the rows.
_LEGEND = f"""WITH RECURSIVE {cte('legend_items')},
  it AS MATERIALIZED (SELECT *, type = 'Text' AND {_has_cjk('text')} AS lab FROM legend_items
    WHERE NOT (type = 'Text' AND NOT {_has_cjk('text')} AND length(text) > 2)),
  sy AS (SELECT * FROM it WHERE NOT lab),
  {_edges_sql('sy', 'dwg_id, vp', 'AND a.line_id = b.line_id', LEGEND_REACH)},
  cc AS (SELECT dwg_id, vp, id, id AS comp FROM sy UNION SELECT cc.dwg_id, cc.vp, e.dst, cc.comp FROM cc JOIN ed e
    ON e.dwg_id = cc.dwg_id AND e.vp = cc.vp AND e.src = cc.id WHERE cc.comp < e.dst),
  cm AS (SELECT dwg_id, vp, id, min(comp) AS comp FROM cc GROUP BY ALL),
  g0 AS (SELECT sy.*, comp FROM sy JOIN cm USING (dwg_id, vp, id)),
  sd AS (SELECT dwg_id, vp, comp, x1, y1, x1 AS x2, y2 FROM g0 WHERE type = 'Hatch' UNION SELECT dwg_id, vp, comp, x2, y1, x2, y2 FROM g0 WHERE type = 'Hatch'
    UNION SELECT dwg_id, vp, comp, x1, y2, x2, y2 FROM g0 WHERE type = 'Hatch' UNION SELECT dwg_id, vp, comp, x1, y1, x2, y1 FROM g0 WHERE type = 'Hatch'),
  gn AS MATERIALIZED (SELECT * FROM g0 g WHERE NOT (type = 'Line' AND EXISTS (SELECT 1 FROM sd WHERE sd.dwg_id = g.dwg_id AND sd.vp = g.vp AND sd.comp = g.comp
    AND sd.x1 = g.x1 AND sd.y1 = g.y1 AND sd.x2 = g.x2 AND sd.y2 = g.y2))),
  si AS (SELECT dwg_id, vp, comp AS id, CASE WHEN count(*) > 1 THEN 'Merge' ELSE arg_min(type, id) END AS type, arg_min(line_id, id) AS line_id,
    min(x1) AS x1, max(y2) AS y2, min(y1) AS y1 FROM gn GROUP BY ALL HAVING count(*) > 1 OR arg_min(type, id) IN ('Block', 'Hatch')),
  al AS (SELECT dwg_id, vp, id, type, '' AS text, line_id, x1, y1 FROM si UNION ALL SELECT dwg_id, vp, id, 'Text', text, line_id, x1, y1 FROM it WHERE lab),
  gd AS (SELECT dwg_id, vp, line_id FROM al GROUP BY ALL HAVING count(*) FILTER (type = 'Text') > 0 AND count(*) FILTER (type <> 'Text') > 0),
  rw AS MATERIALIZED (SELECT al.*, row_number() OVER (PARTITION BY dwg_id, vp, line_id ORDER BY y1 DESC, x1, id) AS pos, CASE WHEN type = 'Text' THEN 0 ELSE 1 END AS k
    FROM al SEMI JOIN gd USING (dwg_id, vp, line_id)),
  wk AS (SELECT dwg_id, vp, line_id, CAST(0 AS BIGINT) AS pos, NULL::BIGINT AS held, NULL::BIGINT AS hk, NULL::BIGINT AS label_id, NULL::BIGINT AS tpl FROM gd
    UNION ALL SELECT r.dwg_id, r.vp, r.line_id, r.pos,
    CASE WHEN held IS NULL THEN r.id WHEN hk <> k THEN NULL ELSE held END, CASE WHEN held IS NULL THEN k WHEN hk <> k THEN NULL ELSE hk END,
    CASE WHEN held IS NOT NULL AND hk <> k THEN CASE WHEN k = 0 THEN r.id ELSE held END END,
    CASE WHEN held IS NOT NULL AND hk <> k THEN CASE WHEN k = 0 THEN held ELSE r.id END END
    FROM wk JOIN rw r ON r.dwg_id = wk.dwg_id AND r.vp = wk.vp AND r.line_id = wk.line_id AND r.pos = wk.pos + 1),
  na AS MATERIALIZED (SELECT w.dwg_id, w.vp, r.text AS label, tpl, label_id FROM wk w JOIN rw r ON r.dwg_id = w.dwg_id AND r.vp = w.vp AND r.id = w.label_id AND r.k = 0
    WHERE label_id IS NOT NULL),
  me AS MATERIALIZED (SELECT dwg_id, vp, comp AS tpl, id, type || text AS ntype FROM gn SEMI JOIN na ON na.dwg_id = gn.dwg_id AND na.vp = gn.vp AND na.tpl = gn.comp),
  te AS MATERIALIZED (SELECT e.dwg_id, e.vp, a.tpl, e.src, e.dst, weight, turn,
      CASE WHEN weight = 8 THEN 8 ELSE weight - weight % 10 + (weight % 10 + 2 * turn) % 8 END AS w
    FROM ed e JOIN me a ON a.dwg_id = e.dwg_id AND a.vp = e.vp AND a.id = e.src JOIN me b ON b.dwg_id = e.dwg_id AND b.vp = e.vp AND b.id = e.dst AND b.tpl = a.tpl,
    (SELECT unnest(range(4)) AS turn)),
  sz AS (SELECT dwg_id, vp, tpl, count(*) AS n, list_sort(list(ntype)) AS kinds FROM me GROUP BY ALL)"""

#: Hits of every template and rotation, grown along its edges and tested whole at the end.
_HITS = f""",
  {_edges_sql('legend_items', 'dwg_id, vp', '', MODEL_REACH, '_m')},
  od AS (SELECT dwg_id, vp, tpl, [min(id)] AS placed FROM me GROUP BY ALL
    UNION ALL SELECT od.dwg_id, od.vp, od.tpl, list_append(placed, min(dst)) FROM od JOIN te ON te.dwg_id = od.dwg_id AND te.vp = od.vp AND te.tpl = od.tpl AND turn = 0
      AND list_contains(placed, src) AND NOT list_contains(placed, dst) GROUP BY od.dwg_id, od.vp, od.tpl, placed),
  fo AS MATERIALIZED (SELECT od.dwg_id, od.vp, od.tpl, placed FROM od JOIN sz ON sz.dwg_id = od.dwg_id AND sz.vp = od.vp AND sz.tpl = od.tpl AND len(placed) = n),
  ht AS (SELECT fo.dwg_id, fo.vp, fo.tpl, turn, [m.id] AS m FROM fo JOIN me s ON s.dwg_id = fo.dwg_id AND s.vp = fo.vp AND s.tpl = fo.tpl AND s.id = placed[1]
      JOIN legend_items m ON m.dwg_id = fo.dwg_id AND m.vp = fo.vp AND m.type || m.text = s.ntype, (SELECT unnest(range(4)) AS turn)
    UNION SELECT ht.dwg_id, ht.vp, ht.tpl, ht.turn, list_append(m, x.dst) FROM ht
      JOIN fo ON fo.dwg_id = ht.dwg_id AND fo.vp = ht.vp AND fo.tpl = ht.tpl AND len(m) < len(placed)
      JOIN te ON te.dwg_id = ht.dwg_id AND te.vp = ht.vp AND te.tpl = ht.tpl AND te.turn = ht.turn AND te.dst = placed[len(m) + 1] AND list_contains(placed[1:len(m)], te.src)
      JOIN ed_m x ON x.dwg_id = ht.dwg_id AND x.vp = ht.vp AND x.src = m[list_position(placed, te.src)] AND x.weight = te.w
      JOIN me s ON s.dwg_id = ht.dwg_id AND s.vp = ht.vp AND s.tpl = ht.tpl AND s.id = te.dst
      JOIN legend_items q ON q.dwg_id = ht.dwg_id AND q.vp = ht.vp AND q.id = x.dst AND q.type || q.text = s.ntype
      WHERE NOT list_contains(m, x.dst)),
  fu AS MATERIALIZED (SELECT ht.*, placed, row_number() OVER () AS h FROM ht JOIN fo ON fo.dwg_id = ht.dwg_id AND fo.vp = ht.vp AND fo.tpl = ht.tpl AND len(m) = len(placed)),
  mb AS MATERIALIZED (SELECT dwg_id, vp, tpl, turn, h, unnest(m) AS id, unnest(placed) AS t FROM fu),
  me_n AS (SELECT a.h, count(*) AS n FROM mb a JOIN mb b ON b.h = a.h JOIN ed_m x ON x.dwg_id = a.dwg_id AND x.vp = a.vp AND x.src = a.id AND x.dst = b.id GROUP BY a.h),
  ok_n AS (SELECT a.h, count(*) AS n FROM mb a JOIN mb b ON b.h = a.h JOIN ed_m x ON x.dwg_id = a.dwg_id AND x.vp = a.vp AND x.src = a.id AND x.dst = b.id
    JOIN te ON te.dwg_id = a.dwg_id AND te.vp = a.vp AND te.tpl = a.tpl AND te.turn = a.turn AND te.src = a.t AND te.dst = b.t AND te.w = x.weight GROUP BY a.h),
  te_n AS (SELECT dwg_id, vp, tpl, count(*) AS n FROM te WHERE turn = 0 GROUP BY ALL),
  hi AS MATERIALIZED (SELECT DISTINCT fu.dwg_id, fu.vp, fu.tpl, list_sort(m) AS m FROM fu LEFT JOIN me_n USING (h) LEFT JOIN ok_n USING (h)
    LEFT JOIN te_n ON te_n.dwg_id = fu.dwg_id AND te_n.vp = fu.vp AND te_n.tpl = fu.tpl
    WHERE coalesce(me_n.n, 0) = coalesce(te_n.n, 0) AND coalesce(ok_n.n, 0) = coalesce(te_n.n, 0))"""


def items(spark, d):
    return view(spark, d, "legend_items")


def _legend(spark, d):
    """Members, edges and labels of the templates that the legends of all viewports give."""
    label = (F.col("type") == "Text") & T.has_cjk(F.col("text"))
    dropped = (F.col("type") == "Text") & ~T.has_cjk(F.col("text")) & (F.length("text") > 2)
    symbols = items(spark, d).where(~dropped & ~label)
    near = cut(L.proximity_edges(symbols, KV, LEGEND_REACH, ("block", "line_id")))
    parts = cut(L.drop_hatch_borders(cut(L.grouped_nodes(symbols, near, KV)), KV))
    merged = L.component_bbox(parts, KV).select(*KV, F.col("comp").alias("id"), "type", "text", "line_id", *BOX)
    labels = items(spark, d).where(label).select(*KV, "id", "type", "text", "line_id", *BOX)
    pairs = cut(L.legend_pairs(cut(L.legend_rows(merged.unionByName(labels), KV)), KV))
    return L.legend_templates(merged, pairs, parts, near, KV)


@query(
    "template_match",
    _LEGEND + _HITS + " SELECT dwg_id, vp, tpl, array_to_string(m, ',') AS members, len(m) AS node_num FROM hi",
)
def template_match(spark, d):
    """Every template of the legends in its own drawing, in four rotations."""
    members, own, _ = _legend(spark, d)
    model = cut(items(spark, d).withColumn("ntype", F.concat("type", "text")))
    near = cut(L.proximity_edges(model, KV, MODEL_REACH, ("block",)))
    turns = members.select(*KV, "tpl").distinct().withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return L.match_templates(model, near, members, own, KV, turns).select(
        *KV, "tpl", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.size("members").cast("long").alias("node_num")
    )


@query(
    "match_drop_included",
    f"""WITH {cte('rects')}, h AS (SELECT *, y2 - y1 AS node_num, x1 % 7 AS label_order FROM rects)
    SELECT dwg_id, id FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.dwg_id = a.dwg_id AND (-b.node_num, b.label_order, b.id) < (-a.node_num, a.label_order, a.id)
      AND b.x1 <= a.x1 AND b.y1 <= a.y1 AND b.x2 >= a.x2 AND b.y2 >= a.y2)""",
)
def match_drop_included(spark, d):
    hits = view(spark, d, "rects").withColumns({"node_num": F.expr("y2 - y1"), "label_order": F.expr("x1 % 7")})
    return L.drop_included(hits, K).select("dwg_id", "id")


@query(
    "template_build",
    _LEGEND + """, tr AS (SELECT te.dwg_id, te.vp, te.tpl, te.turn, list_sort(list({'s': a.ntype, 'd': b.ntype, 'w': w})) AS h FROM te
      JOIN me a ON a.dwg_id = te.dwg_id AND a.vp = te.vp AND a.id = te.src JOIN me b ON b.dwg_id = te.dwg_id AND b.vp = te.vp AND b.id = te.dst GROUP BY ALL),
    ev AS (SELECT DISTINCT na.dwg_id, na.vp, label, na.tpl, turn, kinds, n FROM na JOIN sz ON sz.dwg_id = na.dwg_id AND sz.vp = na.vp AND sz.tpl = na.tpl,
      (SELECT unnest(range(4)) AS turn)),
    kn AS (SELECT ev.*, h FROM ev LEFT JOIN tr ON tr.dwg_id = ev.dwg_id AND tr.vp = ev.vp AND tr.tpl = ev.tpl AND tr.turn = ev.turn WHERE h IS NOT NULL OR ev.turn = 0)
    SELECT dwg_id, vp, label, min({'tpl': tpl, 'turn': turn}).tpl AS tpl, CAST(min({'tpl': tpl, 'turn': turn}).turn AS INTEGER) AS turn, n AS node_num
    FROM kn GROUP BY dwg_id, vp, label, kinds, n, h""",
)
def template_build(spark, d):
    members, _, labels = _legend(spark, d)
    sizes = members.groupBy(*KV, "tpl").agg(F.count(F.lit(1)).alias("node_num"))
    return labels.join(sizes, [*KV, "tpl"]).select(*KV, "label", "tpl", "turn", "node_num")


_BOXES = """,
  lo AS (SELECT dwg_id, vp, id, row_number() OVER (PARTITION BY dwg_id, vp ORDER BY y1 DESC, x1, id) AS rn FROM it WHERE lab),
  ab AS (SELECT na.dwg_id, na.vp, label, max(n) AS node_num, min(rn) AS label_order FROM na JOIN sz ON sz.dwg_id = na.dwg_id AND sz.vp = na.vp AND sz.tpl = na.tpl
    JOIN lo ON lo.dwg_id = na.dwg_id AND lo.vp = na.vp AND lo.id = na.label_id GROUP BY ALL),
  hm AS (SELECT DISTINCT dwg_id, vp, m FROM hi),
  hx AS (SELECT h.dwg_id, h.vp, h.m, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM (SELECT *, unnest(m) AS id FROM hm) h
    JOIN legend_items q ON q.dwg_id = h.dwg_id AND q.vp = h.vp AND q.id = h.id GROUP BY ALL),
  lb AS MATERIALIZED (SELECT DISTINCT hi.dwg_id, hi.vp, na.label, node_num, label_order, x1, y1, x2, y2 FROM hi JOIN na ON na.dwg_id = hi.dwg_id AND na.vp = hi.vp
    AND na.tpl = hi.tpl JOIN hx ON hx.dwg_id = hi.dwg_id AND hx.vp = hi.vp AND hx.m = hi.m JOIN ab ON ab.dwg_id = hi.dwg_id AND ab.vp = hi.vp AND ab.label = na.label),
  lm AS MATERIALIZED (SELECT dwg_id, vp, label, node_num, x1, y1, x2, y2 FROM lb a WHERE NOT EXISTS (SELECT 1 FROM lb b WHERE b.dwg_id = a.dwg_id AND b.vp = a.vp
    AND (-b.node_num, b.label_order, b.x1, b.y1, b.x2, b.y2) < (-a.node_num, a.label_order, a.x1, a.y1, a.x2, a.y2)
    AND b.x1 <= a.x1 AND b.y1 <= a.y1 AND b.x2 >= a.x2 AND b.y2 >= a.y2))"""


@query("legend_match", _LEGEND + _HITS + _BOXES + " SELECT * FROM lm")
def legend_match(spark, d):
    """The legend job: templates from each viewport's own legend, their hits in its model, without included ones."""
    return L.legend_hits(items(spark, d), items(spark, d), KV, LEGEND_REACH, MODEL_REACH)


def _job_bill_sql():
    from planspark.catalog.texts import _first, _subject
    from planspark.functions import dictionaries as D

    return _LEGEND + _HITS + _BOXES + f""", co AS (SELECT dwg_id, label AS name, vp, count(*) AS num FROM lm GROUP BY ALL),
    bv AS (SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY dwg_id, name ORDER BY num DESC, vp) = 1),
    ca AS (SELECT *, {_first('name', D.LEGEND_WORDS, D.ROOM_DEFAULT)} AS category FROM bv)
    SELECT dwg_id, {_subject('category')} AS subject, category, name, num FROM ca"""


@query("legend_match_bill", _job_bill_sql())
def legend_match_bill(spark, d):
    """The bill of the hits: of each name the viewport with most of them."""
    hits = L.legend_hits(items(spark, d), items(spark, d), KV, LEGEND_REACH, MODEL_REACH)
    counts = hits.groupBy("dwg_id", F.col("label").alias("name"), "vp").agg(F.count(F.lit(1)).alias("num"))
    return L.legend_bill(counts, K)


@query(
    "best_viewport",
    f"""WITH {cte('legend_names')}, c AS (SELECT dwg_id, text AS name, vp, CAST(sum(hits) AS BIGINT) AS num FROM legend_names GROUP BY 1, 2, 3)
    SELECT dwg_id, name, vp, num FROM c QUALIFY row_number() OVER (PARTITION BY dwg_id, name ORDER BY num DESC, vp) = 1""",
)
def best_viewport(spark, d):
    return L.best_viewport(_counts(spark, d), K)


def _counts(spark, d):
    return view(spark, d, "legend_names").groupBy("dwg_id", F.col("text").alias("name"), "vp").agg(F.sum("hits").alias("num"))


def _bill_sql():
    from planspark.catalog.texts import _first, _subject
    from planspark.functions import dictionaries as D

    return f"""WITH {cte('legend_names')}, c AS (SELECT dwg_id, text AS name, vp, CAST(sum(hits) AS BIGINT) AS num FROM legend_names GROUP BY 1, 2, 3),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dwg_id, name ORDER BY num DESC, vp) = 1),
    k AS (SELECT *, {_first('name', D.LEGEND_WORDS, D.ROOM_DEFAULT)} AS category FROM b)
    SELECT dwg_id, {_subject('category')} AS subject, category, name, num FROM k"""


@query("legend_bill", _bill_sql())
def legend_bill(spark, d):
    return L.legend_bill(_counts(spark, d), K)
