"""Source and sink queries: documents that Spark derives from the tables, parsed and written."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark.catalog.bindings import cte, table, view
from planspark.catalog.registry import query
from planspark.catalog.scalars import hex_rings, r6, yolo
from planspark.sources import files as S
from planspark.sources import sinks as W

#: Items per document part.
PART = 5


def docs(spark, d, expr, source="orders", key="o_orderkey"):
    return table(spark, d, source).select(F.col(key).alias("file"), F.expr(expr).alias("content"))


def _dump(n):
    values = ", ', ', ".join(["o_custkey", "o_orderkey", "o_custkey + 5", "o_orderkey + 7", "o_orderkey % 2", "1", "3", "9"][:n])
    bad = f"CASE WHEN o_orderkey % 11 = 0 THEN 'Door2: 1, x, 3' ELSE concat('Door2: ', {values}) END"
    return f"concat('range: 0, 0, ', o_custkey, ', 50\\ntotal: 2\\nDoor1: ', {values}, '\\n', {bad})"


_DUMP_SQL = """SELECT o_orderkey AS file, i AS item_no, CAST(o_custkey AS DOUBLE) AS bx, CAST(o_custkey AS DOUBLE) AS a, CAST(o_orderkey + 7 AS DOUBLE) AS d
  FROM orders, (SELECT unnest([1, 2]) AS i) WHERE o_orderkey % 11 <> 0"""


def _dump_query(name, n):
    @query(name, _DUMP_SQL)
    def run(spark, d):
        out = S.parse_dump(docs(spark, d, _dump(n)), values=n)
        at = lambda c, i: F.get(c, F.lit(i))
        return out.select("file", "item_no", at("box", 2).alias("bx"), at("v", 0).alias("a"), at("v", 3).alias("d"))


for _name, _n in (("src_range_txt", 6), ("src_range_txt_lines", 4), ("src_range_txt_ceiling", 4), ("src_range_txt_arc", 8)):
    _dump_query(_name, _n)


@query("src_room_text", "SELECT o_orderkey AS file, 3 AS pos, o_orderpriority || ', x' AS text, o_custkey / 4 AS x, CAST(o_orderkey AS DOUBLE) AS y FROM orders")
def src_room_text(spark, d):
    content = "concat('a\\nb\\nc\\nText: ', o_orderpriority, ', x, X: ', o_custkey / 4, ', Y: ', o_orderkey, '\\nText: , X: 1, Y: 2')"
    return S.parse_room_text(docs(spark, d, content))


@query("src_yolo", "SELECT o_orderkey AS file, 0 AS box_no, CAST(o_custkey % 3 AS INT) AS cls, 0.5 AS cx, o_custkey / 4 AS cy FROM orders")
def src_yolo(spark, d):
    content = "concat(o_custkey % 3, ' 0.5 ', o_custkey / 4, ' 0.1 0.2\\n1 0.3 0.4')"
    return S.parse_yolo(docs(spark, d, content)).select("file", "box_no", "cls", "cx", "cy")


@query("src_corpus_tsv", "SELECT o_orderkey AS file, 1 AS pos, o_orderpriority AS text, CAST(o_custkey % 5 AS INT) AS label FROM orders")
def src_corpus_tsv(spark, d):
    return S.parse_corpus(docs(spark, d, "concat('\\n', o_orderpriority, '\\t', o_custkey % 5, '\\n  \\n')"))


@query("src_files_sha256", "SELECT page_id AS file, sha256(html) AS sha256 FROM pages")
def src_files_sha256(spark, d):
    return S.with_hash(docs(spark, d, "html", "pages", "page_id"))


@query(
    "src_item_json",
    """SELECT o_orderkey AS file, kind, 1 AS item_no, CASE WHEN kind IN ('ArcDoor', 'ParallelWindow') THEN CAST(o_custkey AS DOUBLE) END AS rx,
    CASE WHEN kind IN ('ArcDoor', 'WallLine') THEN CAST(o_orderkey AS DOUBLE) END AS px, CASE kind WHEN 'Text' THEN o_orderpriority END AS text
    FROM orders, (SELECT unnest(['ArcDoor', 'ParallelWindow', 'WallLine', 'Text']) AS kind)""",
)
def src_item_json(spark, d):
    content = """concat('{"dwg_name": "p", "range": [0, 0, 9, 9], "box": [0, 0, 1, 1], "arc_items": [{"rect": [', o_custkey, ', 0, 1, 1], "point": [', o_orderkey,
      ', 0, 1, 1]}], "balcony_items": [], "window_items": [{"rect": [', o_custkey, ', 0, 1, 1]}], "wall_line_items": [{"point": [', o_orderkey,
      ', 0, 1, 1]}], "text_items": [{"text": "', o_orderpriority, '", "x": 1, "y": 2}]}')"""
    at = lambda c: F.get(c, F.lit(0))
    return S.parse_items(docs(spark, d, content)).select("file", "kind", "item_no", at("rect").alias("rx"), at("point").alias("px"), "text")


@query("src_legend_json", "SELECT o_orderkey AS id, 'vp' || (o_custkey % 4) AS vp, 0 AS node_no, 'Block' AS type, CAST(o_custkey AS DOUBLE) AS x1, 30.0 AS yd FROM orders")
def src_legend_json(spark, d):
    o = table(spark, d, "orders").select(
        F.expr("concat(o_orderkey, '--&&&--vp', o_custkey % 4, '-legend.json')").alias("file"),
        F.expr("""concat('{"yd": 30, "legend_item": [{"Type": "Block", "Rect": [', o_custkey, ', 1, 2, 3], "BlockName": "b"}]}')""").alias("content"),
    )
    return S.parse_legends(o).select(F.split_part("file", F.lit("--"), F.lit(1)).cast("long").alias("id"), "vp", "node_no", "type", "x1", "yd")


@query(
    "src_labelme",
    """SELECT o_orderkey AS file, s AS shape_no, CASE s WHEN 0 THEN 'line' WHEN 1 THEN 'arc' WHEN 2 THEN 'box' ELSE 'reject' END AS geometry,
    CAST(least(o_custkey, 100) AS DOUBLE) AS x1, CASE s WHEN 1 THEN o_orderkey END AS px1 FROM orders, (SELECT unnest([0, 1, 2, 3]) AS s)""",
)
def src_labelme(spark, d):
    four = "[[', o_custkey, ', 1], [100, 1], [100, 5], [', o_custkey, ', 5]]"
    content = f"""concat('{{"imageWidth": 9, "imageHeight": 9, "shapes": [{{"label": "a", "points": [[', o_custkey, ', 1], [100, 2]]}}, {{"label": "b", "points": {four},
      "description": "[', o_orderkey, ', 2, 3, 4]"}}, {{"label": "c", "points": {four}, "description": ""}}, {{"label": "d", "points": [[', o_custkey, ', 1], [100, 2], [100, 3]]}}]}}')"""
    return S.parse_labelme(docs(spark, d, content)).select("file", "shape_no", "geometry", "x1", "px1")


@query(
    "src_svg_segments",
    """SELECT o_orderkey AS file, s - 1 AS path_no, 1 AS seg_no, CASE s WHEN 1 THEN CAST(o_custkey AS DOUBLE) ELSE 5.5 END AS x1, CASE s WHEN 1 THEN 5.5 ELSE CAST(o_orderkey AS DOUBLE) END AS x2
    FROM orders, (SELECT unnest([1, 2]) AS s)""",
)
def src_svg_segments(spark, d):
    content = """concat('<svg><g id="A-WALL-1"><g transform="scale(1)"><path style="x" d="M ', o_custkey, ',2 L 5.5,7"/></g><path d="M 5.5,7 L ', o_orderkey, ',-3"/></g><g id="DOOR"><path d="M 1,1 L 2,2"/></g></svg>')"""
    return S.parse_svg(docs(spark, d, content)).select("file", "path_no", "seg_no", "x1", "x2")


@query(
    "snk_yolo",
    f"WITH {cte('boxes')} SELECT image_id, box_no, cls || ' ' || printf('%.6f', cx / 1000) || ' ' || printf('%.6f', cy / 1000) || ' ' || printf('%.6f', w / 1000) || ' ' || printf('%.6f', h / 1000) AS line FROM boxes",
)
def snk_yolo(spark, d):
    return W.yolo_lines(yolo(spark, d), "image_id")


@query(
    "snk_coco",
    f"""WITH {cte('boxes')}, i AS (SELECT image_id AS k, row_number() OVER (ORDER BY image_id) AS n FROM (SELECT DISTINCT image_id FROM boxes))
    SELECT row_number() OVER (ORDER BY image_id, box_no) AS id, n AS image_id, cls + 1 AS category_id, round((cx / 1000 - w / 1000 / 2) * 640, 6) AS bx,
    round(w / 1000 * 640 * (h / 1000 * 480), 6) AS area, 0 AS iscrowd FROM boxes JOIN i ON k = image_id""",
)
def snk_coco(spark, d):
    b = yolo(spark, d)
    images = W.coco_images(b.select("image_id").distinct().withColumns({"width": F.lit(640), "height": F.lit(480)}), "image_id")
    a = W.coco_annotations(b, images, "image_id")
    return a.select("id", "image_id", "category_id", r6(F.col("bx")).alias("bx"), r6(F.col("area")).alias("area"), "iscrowd")


@query("snk_result_json", f"WITH {cte('arcs')} SELECT dwg_id, (n - 1) // 5 AS part, count(*) AS n, min(x1) AS low FROM (SELECT *, row_number() OVER (PARTITION BY dwg_id ORDER BY id) AS n FROM arcs) GROUP BY 1, 2")
def snk_result_json(spark, d):
    """Documents written and read back: items per drawing and the smallest x."""
    out = W.result_json(view(spark, d, "arcs"), ["dwg_id"], "doors", ["x1", "y1", "x2", "y2"], PART)
    back = out.select("dwg_id", "part", F.from_json("json", "doors array<array<bigint>>")["doors"].alias("doors"))
    return back.select("dwg_id", "part", F.size("doors").alias("n"), F.array_min(F.transform("doors", lambda r: r[0])).alias("low"))


@query("snk_labelme", f"WITH {cte('hexagons')} SELECT dwg_id, (n - 1) // 5 AS part, count(*) AS n, min(ox) + 0.0 AS low FROM (SELECT *, row_number() OVER (PARTITION BY dwg_id ORDER BY id) AS n FROM hexagons) GROUP BY 1, 2")
def snk_labelme(spark, d):
    """LabelMe documents written and parsed again."""
    shapes = hex_rings(spark, d).select(
        "dwg_id", F.col("id").alias("shape_no"), F.lit("WallArea1").alias("label"), F.transform("ring", lambda p: F.array(p["x"], p["y"])).alias("points"),
        F.lit("polygon").alias("shape_type"), F.lit("").alias("description"),
    )
    out = W.labelme_json(shapes, "dwg_id", F.lit(400), F.lit(400), PART)
    back = S.parse_labelme(out.select(F.struct("dwg_id", "part").alias("file"), F.col("json").alias("content")))
    return back.groupBy("file.dwg_id", "file.part").agg(F.count(F.lit(1)).alias("n"), F.min("x1").alias("low"))
