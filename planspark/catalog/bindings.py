"""How the driver tables are read as drawings, annotations, texts and tasks.

One list of expressions per view, valid in Spark SQL and in DuckDB, so both
sides of a check start from the same rows. Only integer arithmetic is used.
Sixteen consecutive orders make one drawing: the number of drawings grows with
the data, their size does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DWG_L = "CAST(floor(l_orderkey / 16) AS BIGINT)"
_DWG_O = "CAST(floor(o_orderkey / 16) AS BIGINT)"
_ITEM = (
    "CAST(((l_orderkey % 16) * 8 + l_linenumber) * CAST(1000000 AS BIGINT) + l_suppkey AS BIGINT)"
    " * 1000000000 + l_partkey"
)
_QTY = "CAST(l_quantity AS BIGINT)"
_X = "CAST(l_partkey % 400 AS BIGINT)"
_Y = "CAST((l_suppkey * 37 + l_linenumber * 13) % 400 AS BIGINT)"
_H = "CAST((l_partkey + l_linenumber) % 2 AS BIGINT)"  # 0 along x, 1 along y
_WORDS = (
    "客厅", "起居室", "阳台", "主卧", "次卧", "洗衣房", "厨房", "餐厅", "卫生间", "书房",
    "玄关", "健身房", "花园", "衣帽间", "空调板", "客厅餐厅",
)
_LEGENDS = (
    "吸顶灯", "单联开关", "烟感探测器", "配电箱", "热水器", "排水管", "地漏", "截止阀",
    "送风口", "风管", "玻璃隔断", "剪力墙", "标高符号", "检修口", "图例", "A1", "注：见详图",
    "default text", "冷水管阀门", "LED灯",
)


def _pick(words: tuple[str, ...], number: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words))
    return f"CASE {number} % {len(words)} {cases} END"


VIEWS: dict[str, tuple[str, list[str]]] = {
    # drawing header: model-space box and image size
    "drawings": (
        "orders",
        [
            "o_orderkey AS dwg_id",
            "CAST(o_custkey % 500 AS DOUBLE) AS rx1",
            "CAST(o_orderkey % 300 AS DOUBLE) AS ry1",
            "CAST(o_custkey % 500 + 900 + o_orderkey % 1100 AS DOUBLE) AS rx2",
            "CAST(o_orderkey % 300 + 700 + o_custkey % 900 AS DOUBLE) AS ry2",
            "CAST(1600 + o_custkey % 700 AS BIGINT) AS img_w",
            "CAST(1200 + o_orderkey % 500 AS BIGINT) AS img_h",
        ],
    ),
    # raw entities in model space, one drawing per order
    "entities": (
        "lineitem",
        [
            "l_orderkey AS dwg_id",
            f"{_ITEM} AS id",
            "CAST(l_partkey % 1500 AS DOUBLE) AS x1",
            "CAST(l_suppkey * 13 % 1200 AS DOUBLE) AS y1",
            "CAST(l_partkey % 1500 + 20 + l_quantity AS DOUBLE) AS x2",
            "CAST(l_suppkey * 13 % 1200 + 10 + l_linenumber * 7 AS DOUBLE) AS y2",
        ],
    ),
    "rects": (
        "lineitem",
        [
            f"{_DWG_L} AS dwg_id",
            f"{_ITEM} AS id",
            f"{_X} AS x1",
            f"{_Y} AS y1",
            f"{_X} + 5 + {_QTY} AS x2",
            f"{_Y} + 5 + l_linenumber * 3 AS y2",
            "CAST(l_linenumber % 2 AS BIGINT) AS otype",
        ],
    ),
    "door_lines": (
        "lineitem",
        [
            f"{_DWG_L} AS dwg_id",
            f"{_ITEM} AS id",
            "CAST(l_partkey % 6 * 20 + (1 - l_linenumber % 2) * (l_suppkey % 100) * 3 AS BIGINT) AS x1",
            "CAST(l_partkey % 6 * 20 + (l_linenumber % 2) * (l_suppkey % 100) * 3 AS BIGINT) AS y1",
            "CAST(l_partkey % 6 * 20 + (1 - l_linenumber % 2) * (l_suppkey % 100) * 3"
            f" + (l_linenumber % 2) * (40 + {_QTY} % 4 * 30) AS BIGINT) AS x2",
            "CAST(l_partkey % 6 * 20 + (l_linenumber % 2) * (l_suppkey % 100) * 3"
            f" + (1 - l_linenumber % 2) * (40 + {_QTY} % 4 * 30) AS BIGINT) AS y2",
        ],
    ),
    "door_rects": (
        "lineitem",
        [
            f"{_DWG_L} AS dwg_id",
            f"{_ITEM} AS id",
            f"{_X} AS x1",
            f"{_Y} AS y1",
            f"{_X} + CASE WHEN l_linenumber % 2 = 0 THEN 50 + {_QTY} ELSE 4 + {_QTY} % 6 END AS x2",
            f"{_Y} + CASE WHEN l_linenumber % 2 = 0 THEN 4 + {_QTY} % 6 ELSE 50 + {_QTY} END AS y2",
            "CAST(l_linenumber % 2 AS BIGINT) AS otype",
        ],
    ),
    # door leaves two by two, so that they slide past each other, and now and then one alone or one too short
    "leaves": (
        "lineitem",
        [
            f"{_DWG_L} AS dwg_id",
            f"{_ITEM} AS id",
            f"CAST(l_orderkey % 16 * 400 + CASE (l_linenumber - 1) % 2 WHEN 0 THEN 160 - {_QTY} % 5 * 20 ELSE 195 END AS BIGINT) AS x1",
            "CAST(floor((l_linenumber - 1) / 2) * 100 + (l_linenumber - 1) % 2 * 5 AS BIGINT) AS y1",
            f"CAST(l_orderkey % 16 * 400 + CASE (l_linenumber - 1) % 2 WHEN 0 THEN 200 ELSE 235 + {_QTY} % 5 * 20 END AS BIGINT) AS x2",
            "CAST(floor((l_linenumber - 1) / 2) * 100 + (l_linenumber - 1) % 2 * 5 + 5 AS BIGINT) AS y2",
        ],
    ),
    "arcs": (
        "orders",
        [
            f"{_DWG_O} AS dwg_id",
            "o_orderkey AS id",
            "CAST(o_custkey * 7 % 40 * 10 AS BIGINT) AS x1",
            "CAST(o_orderkey * 31 % 40 * 10 AS BIGINT) AS y1",
            "CAST(o_custkey * 7 % 40 * 10 + 40 + o_custkey % 3 * 10 AS BIGINT) AS x2",
            "CAST(o_orderkey * 31 % 40 * 10 + 40 + o_custkey % 3 * 10 AS BIGINT) AS y2",
            "CAST(o_custkey * 7 % 40 * 10 + o_custkey % 2 * (40 + o_custkey % 3 * 10) AS BIGINT) AS px1",
            "CAST(o_orderkey * 31 % 40 * 10 AS BIGINT) AS py1",
            "CAST(o_custkey * 7 % 40 * 10 + (1 - o_custkey % 2) * (40 + o_custkey % 3 * 10) AS BIGINT) AS px2",
            "CAST(o_orderkey * 31 % 40 * 10 + 40 + o_custkey % 3 * 10 AS BIGINT) AS py2",
        ],
    ),
    # axis-parallel wall lines on a coarse raster, so that they overlap and cross
    "segments": (
        "lineitem",
        [
            f"{_DWG_L} AS dwg_id",
            f"{_ITEM} AS id",
            "CAST(l_partkey % 20 * 20 AS BIGINT) AS x1",
            "CAST(l_suppkey * 7 % 20 * 20 AS BIGINT) AS y1",
            f"CAST(l_partkey % 20 * 20 + {_H} * (20 + {_QTY} * 3) AS BIGINT) AS x2",
            f"CAST(l_suppkey * 7 % 20 * 20 + (1 - {_H}) * (20 + {_QTY} * 3) AS BIGINT) AS y2",
        ],
    ),
    # slanted lines for the general intersection and distance expressions
    "slants": (
        "lineitem",
        [
            f"{_DWG_L} AS dwg_id",
            f"{_ITEM} AS id",
            f"{_X} AS x1",
            f"{_Y} AS y1",
            f"{_X} + {_QTY} - 25 AS x2",
            f"{_Y} + l_linenumber * 11 - 40 AS y2",
        ],
    ),
    # simple hexagons: one ring per order, vertices as columns
    "hexagons": (
        "orders",
        [
            f"{_DWG_O} AS dwg_id",
            "o_orderkey AS id",
            "CAST(o_custkey * 3 % 300 AS BIGINT) AS ox",
            "CAST(o_orderkey * 17 % 300 AS BIGINT) AS oy",
            "CAST(60 + o_custkey % 50 AS BIGINT) AS w",
            "CAST(60 + o_orderkey % 50 AS BIGINT) AS h",
            "CAST(10 + o_custkey % 40 AS BIGINT) AS cx",
            "CAST(10 + o_orderkey % 40 AS BIGINT) AS cy",
        ],
    ),
    "texts": (
        "orders",
        [
            f"{_DWG_O} AS dwg_id",
            "o_orderkey AS id",
            f"{_pick(_WORDS, 'o_custkey')} AS text",
            "CAST(o_custkey * 11 % 400 AS BIGINT) AS x",
            "CAST(o_orderkey * 29 % 400 AS BIGINT) AS y",
        ],
    ),
    "legend_names": (
        "orders",
        [
            f"{_DWG_O} AS dwg_id",
            "o_orderkey AS id",
            f"{_pick(_LEGENDS, 'o_custkey')} AS text",
            "CAST(o_custkey % 4 AS BIGINT) AS vp",
            "CAST(1 + o_orderkey % 9 AS BIGINT) AS hits",
        ],
    ),
    # legend-side and model-side nodes
    "legend_nodes": (
        "lineitem",
        [
            f"{_DWG_L} AS dwg_id",
            f"{_ITEM} AS id",
            "CASE l_linenumber % 4 WHEN 0 THEN 'Line' WHEN 1 THEN 'Block' WHEN 2 THEN 'Text'"
            " ELSE 'Hatch' END AS type",
            "CASE WHEN l_linenumber % 4 = 2 THEN CASE l_partkey % 3 WHEN 0 THEN '吸顶灯'"
            " WHEN 1 THEN 'AP' ELSE 'LIGHT' END ELSE '' END AS text",
            "l_returnflag AS block",
            "CAST(l_suppkey % 5 AS BIGINT) AS line_id",
            "CAST(l_partkey % 400 * 10 AS BIGINT) AS x1",
            "CAST((l_suppkey * 37 + l_linenumber * 13) % 400 * 10 AS BIGINT) AS y1",
            f"CAST(l_partkey % 400 * 10 + {_QTY} * 6 AS BIGINT) AS x2",
            f"CAST((l_suppkey * 37 + l_linenumber * 13) % 400 * 10 + {_QTY} * 4 AS BIGINT) AS y2",
        ],
    ),
    # items of a drawing's legend and of its model alike, in two viewports
    "legend_items": (
        "lineitem",
        [
            f"{_DWG_L} AS dwg_id",
            "CAST(l_suppkey % 2 AS BIGINT) AS vp",
            f"{_ITEM} AS id",
            "CASE l_linenumber % 4 WHEN 0 THEN 'Line' WHEN 1 THEN 'Block' WHEN 2 THEN 'Text'"
            " ELSE 'Hatch' END AS type",
            "CASE WHEN l_linenumber % 4 = 2 THEN CASE l_partkey % 4 WHEN 0 THEN 'AP' WHEN 1 THEN 'LIGHT'"
            f" ELSE {_pick(_LEGENDS[:6], 'l_suppkey')} END ELSE '' END AS text",
            "l_returnflag AS block",
            "CAST(l_partkey % 3 AS BIGINT) AS line_id",
            "CAST(l_partkey % 40 * 40 AS BIGINT) AS x1",
            "CAST((l_suppkey * 37 + l_linenumber * 13) % 40 * 40 AS BIGINT) AS y1",
            f"CAST(l_partkey % 40 * 40 + 20 + {_QTY} % 5 * 30 AS BIGINT) AS x2",
            f"CAST((l_suppkey * 37 + l_linenumber * 13) % 40 * 40 + 20 + {_QTY} % 3 * 30 AS BIGINT) AS y2",
        ],
    ),
    # YOLO rows in thousandths
    "boxes": (
        "lineitem",
        [
            f"{_DWG_L} AS image_id",
            f"{_ITEM} AS box_no",
            "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls",
            "CAST(l_linenumber % 2 AS BIGINT) AS side",
            "CAST(l_partkey * 7 % 41 * 25 AS BIGINT) AS cx",
            "CAST(l_suppkey * 11 % 41 * 25 AS BIGINT) AS cy",
            f"CAST(40 + {_QTY} * 3 AS BIGINT) AS w",
            "CAST(40 + l_linenumber * 20 AS BIGINT) AS h",
            "CAST(l_partkey % 1000 AS BIGINT) AS score",
        ],
    ),
    # mask runs of two sources (0 truth, 1 prediction)
    "raw_runs": (
        "lineitem",
        [
            f"{_DWG_L} AS image_id",
            "CAST(l_linenumber % 2 AS BIGINT) AS side",
            "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS cls",
            "CAST(l_suppkey % 24 AS BIGINT) AS y",
            "CAST(l_partkey % 150 AS BIGINT) AS x0",
            f"CAST(l_partkey % 150 + {_QTY} - 1 AS BIGINT) AS x1",
        ],
    ),
    # the task log; create_time is a JavaScript date string
    "tasks": (
        "events",
        [
            "event_id AS task_id",
            "user_id",
            "event_type AS task_type",
            "props AS task_name",
            "ts",
            "value",
        ],
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, exprs = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*exprs)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cte(*names: str) -> str:
    """The bindings as common table expressions: ``name AS (...), ...``."""
    parts = []
    for name in names:
        source, exprs = VIEWS[name]
        parts.append(f"{name} AS (SELECT {', '.join(exprs)} FROM {source})")
    return ", ".join(parts)
