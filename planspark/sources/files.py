"""Reading drawing items, text dumps, annotation files and SVG walls.

Every parser takes a table (file, content), so the same code serves files,
streams and columns; ``read_*`` gives such a table from a folder. A file is
one row, its items are exploded at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM_SCHEMA = (
    "dwg_name string, range array<double>, box array<double>,"
    " arc_items array<struct<rect: array<double>, point: array<double>>>,"
    " balcony_items array<struct<rect: array<double>>>, door_line_items array<struct<point: array<double>>>,"
    " window_items array<struct<rect: array<double>>>, wall_line_items array<struct<point: array<double>>>,"
    " text_items array<struct<text: string, x: double, y: double>>"
)
# File suffix and item list of each kind.
ITEM_KINDS = {
    "ArcDoor": "arc_items", "Balcony": "balcony_items", "DoorLine": "door_line_items",
    "ParallelWindow": "window_items", "WallLine": "wall_line_items", "Text": "text_items",
}
LEGEND_SCHEMA = (
    "range array<double>, yd double, legend_item array<struct<Type: string, Text: string, Rect: array<double>,"
    " BlockName: string, LayerName: string, line_id: string>>, ceiling_item array<struct<Type: string, Text: string,"
    " Rect: array<double>, BlockName: string, LayerName: string, line_id: string>>"
)
LABELME_SCHEMA = (
    "version string, imagePath string, imageHeight int, imageWidth int, shapes array<struct<label: string,"
    " points: array<array<double>>, group_id: string, description: string, shape_type: string>>"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the text files of a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256): content hash per file; equal drawings share it."""
    return with_hash(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


def with_hash(files: DataFrame) -> DataFrame:
    return files.select("file", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


# --- JSON ---------------------------------------------------------------------------


def parse_items(files: DataFrame) -> DataFrame:
    """(file, kind, item_no, rect, point, text, x, y) of item files; malformed files give nothing."""
    doc = files.select("file", F.from_json("content", ITEM_SCHEMA).alias("d"))
    nothing = F.lit(None)

    def rows(kind: str, name: str) -> Column:
        has = {"arc_items": ("rect", "point"), "text_items": ("text", "x", "y")}.get(
            name, ("point",) if name.endswith("line_items") else ("rect",)
        )

        def one(item: Column, i: Column) -> Column:
            field = lambda f, t: (item[f] if f in has else nothing).cast(t).alias(f)
            return F.struct(
                F.lit(kind).alias("kind"), (i + 1).alias("item_no"), field("rect", "array<double>"), field("point", "array<double>"),
                field("text", "string"), field("x", "double"), field("y", "double"),
            )

        empty = F.array().cast("array<struct<kind:string,item_no:int,rect:array<double>,point:array<double>,text:string,x:double,y:double>>")
        return F.coalesce(F.transform(F.col(f"d.{name}"), one), empty)

    every = F.concat(*[rows(k, n) for k, n in ITEM_KINDS.items()])
    return doc.select("file", F.inline(every))


def parse_headers(files: DataFrame) -> DataFrame:
    """(file, dwg_name, range, box) of item files."""
    return files.select("file", F.from_json("content", ITEM_SCHEMA).alias("d")).select("file", "d.dwg_name", "d.range", "d.box")


def parse_legends(files: DataFrame, side: str = "legend") -> DataFrame:
    """(file, vp, node_no, type, text, block, layer, line_id, x1..y2, yd) of legend or model files."""
    name = "legend_item" if side == "legend" else "ceiling_item"
    doc = files.select("file", F.regexp_extract("file", f"--&&&--(.*)-{'legend' if side == 'legend' else 'model'}\\.json$", 1).alias("vp"), F.from_json("content", LEGEND_SCHEMA).alias("d"))
    items = doc.select("file", "vp", F.col("d.yd").alias("yd"), F.posexplode(f"d.{name}").alias("node_no", "n"))
    return items.select(
        "file", "vp", "node_no", F.col("n.Type").alias("type"), F.coalesce("n.Text", F.lit("")).alias("text"), F.col("n.BlockName").alias("block"),
        F.col("n.LayerName").alias("layer"), F.col("n.line_id").alias("line_id"),
        *[F.get("n.Rect", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], "yd",
    )


def parse_labelme(files: DataFrame) -> DataFrame:
    """(file, shape_no, label, shape_type, geometry, points, x1..y2, px1..py2).

    ``geometry`` is 'line' for exactly two points, 'arc' for a box with four
    whole numbers in its description, 'box' for other shapes of four or more
    points, else 'reject'.
    """
    doc = files.select("file", F.posexplode(F.from_json("content", LABELME_SCHEMA)["shapes"]).alias("shape_no", "s"))
    pts = F.col("s.points")
    xs, ys = F.transform(pts, lambda p: F.get(p, F.lit(0))), F.transform(pts, lambda p: F.get(p, F.lit(1)))
    ends = F.transform(F.split(F.regexp_replace(F.coalesce("s.description", F.lit("")), r"[\[\]\s]", ""), ","), lambda v: v.try_cast("long"))
    is_arc = (F.size(ends) == 4) & F.forall(ends, lambda v: v.isNotNull())
    kind = F.when(F.size(pts) == 2, "line").when((F.size(pts) >= 4) & is_arc, "arc").when(F.size(pts) >= 4, "box").otherwise("reject")
    return doc.select(
        "file", "shape_no", F.col("s.label").alias("label"), F.col("s.shape_type").alias("shape_type"), kind.alias("geometry"), pts.alias("points"),
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"),
        *[F.when(is_arc, F.get(ends, F.lit(i))).alias(c) for i, c in enumerate(("px1", "py1", "px2", "py2"))],
    )


# --- plain text ----------------------------------------------------------------------


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")).where(F.trim("line") != "")


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, ",\\s*"), lambda v: F.trim(v).try_cast("double"))


def parse_dump(files: DataFrame, values: int = 6, header: int = 0, first: int = 2) -> DataFrame:
    """(file, box, item_no, v): rows 'Name1: n, n, ...' after a 'range: a, b, c, d' line.

    ``values`` numbers per row; any row that does not parse drops the whole
    file. Variants: 4 for lines and ceilings, 8 for arcs; ``header`` and
    ``first`` are the line numbers of the range and of the first item.
    """
    rows = _lines(files)
    v = _numbers(F.regexp_extract("line", "^[^:]*: (.*)$", 1))
    wanted = F.when(F.col("pos") == header, 4).otherwise(values)
    used = rows.where((F.col("pos") == header) | (F.col("pos") >= first)).select("file", "pos", v.alias("v"), wanted.alias("n"))
    good = (F.size("v") >= F.col("n")) & F.forall("v", lambda x: x.isNotNull())
    bad = used.where(~good).select("file").distinct()
    kept = used.join(bad, "file", "left_anti")
    box = kept.where(F.col("pos") == header).select("file", F.col("v").alias("box"))
    return kept.where(F.col("pos") >= first).join(box, "file").select("file", "box", (F.col("pos") - first + 1).alias("item_no"), "v")


def parse_room_text(files: DataFrame, skip: int = 3) -> DataFrame:
    """(file, pos, text, x, y) of rows 'Text: <t>, X: <x>, Y: <y>'; files shorter than the header are blank."""
    row = r"^Text: (.+), X: ([^,]+), Y: (.+)$"
    rows = _lines(files).where((F.col("pos") >= skip) & F.col("line").rlike(row))
    return rows.select(
        "file", "pos", F.regexp_extract("line", row, 1).alias("text"),
        F.regexp_extract("line", row, 2).try_cast("double").alias("x"), F.regexp_extract("line", row, 3).try_cast("double").alias("y"),
    )


def parse_yolo(files: DataFrame) -> DataFrame:
    """(file, box_no, cls, cx, cy, w, h); rows with fewer than five numbers are skipped."""
    rows = _lines(files).select("file", "pos", F.split(F.trim("line"), "\\s+").alias("p")).where(F.size("p") >= 5)
    return rows.select(
        "file", F.col("pos").alias("box_no"), F.get("p", F.lit(0)).try_cast("double").cast("int").alias("cls"),
        *[F.get("p", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))],
    )


def parse_corpus(files: DataFrame) -> DataFrame:
    """(file, pos, text, label) of rows 'text<TAB>label'; blank rows are skipped."""
    return _lines(files).select(
        "file", "pos", F.split_part(F.trim("line"), F.lit("\t"), F.lit(1)).alias("text"),
        F.split_part(F.trim("line"), F.lit("\t"), F.lit(2)).try_cast("int").alias("label"),
    )


def parse_svg(files: DataFrame, mark: str = "WALL") -> DataFrame:
    """(file, group_no, path_no, seg_no, x1..y2) of the paths in groups whose id holds ``mark``.

    M moves, L draws from the last point. Groups nest: a group ends with the
    closing tag of its own depth, and marked groups inside a marked one belong
    to the outer one. Tags of one file are ordered in one window, as a file is
    one row to begin with.
    """
    tags = F.regexp_extract_all("content", F.lit(r"(?s)(<g(?=[\s>/])[^>]*>|</g\s*>|<path(?=[\s>/])[^>]*>)"), F.lit(1))
    t = files.select("file", F.posexplode(tags).alias("pos", "tag"))
    opens = F.col("tag").startswith("<g") & ~F.col("tag").endswith("/>")
    step = F.when(opens, 1).when(F.col("tag").startswith("</g"), -1).otherwise(0)
    along = Window.partitionBy("file").orderBy("pos")
    t = t.withColumn("step", step).withColumn("depth", F.sum("step").over(along))
    # the k-th opening tag of a depth belongs to the k-th closing tag of that depth
    level = F.when(F.col("step") == 1, F.col("depth")).otherwise(F.col("depth") + 1)
    t = t.withColumn("level", level).withColumn("nth", F.row_number().over(Window.partitionBy("file", "level", "step").orderBy("pos")))
    ends = t.where("step = -1").select("file", "level", "nth", F.lit(1).alias("step"), F.col("pos").alias("end"))
    t = t.join(ends, ["file", "level", "nth", "step"], "left")
    marked = (F.col("step") == 1) & F.col("tag").rlike(f'id="[^"]*{mark}[^"]*"')
    t = t.withColumn("reach", F.when(marked, F.coalesce("end", F.lit(2**31 - 1))))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("open_to", F.coalesce(F.max("reach").over(before), F.lit(-1)))
    outer = F.when(F.col("reach").isNotNull() & (F.col("open_to") < F.col("pos")), 1).otherwise(0)
    t = t.withColumn("outer", outer).withColumn("group_no", F.sum("outer").over(along) - 1)
    paths = t.where(F.col("tag").startswith("<path") & (F.col("open_to") > F.col("pos")) & F.col("tag").rlike(r'\sd="'))
    p = paths.select(
        "file", F.col("group_no").cast("int").alias("group_no"),
        (F.row_number().over(Window.partitionBy("file", "group_no").orderBy("pos")) - 1).alias("path_no"),
        F.regexp_extract("tag", r'\sd="([^"]*)"', 1).alias("d"),
    )
    token = r"([ML])\s*([-0-9.]+),([-0-9.]+)"
    steps = F.arrays_zip(
        F.regexp_extract_all("d", F.lit(token), F.lit(1)).alias("c"), F.regexp_extract_all("d", F.lit(token), F.lit(2)).alias("x"),
        F.regexp_extract_all("d", F.lit(token), F.lit(3)).alias("y"),
    )
    rows = p.select("file", "group_no", "path_no", steps.alias("t"))
    seg = F.transform(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: F.struct(
            i.alias("seg_no"), F.get("t", i)["c"].alias("c"),
            F.coalesce(F.get("t", i - 1)["x"].cast("double"), F.lit(0.0)).alias("x1"), F.coalesce(F.get("t", i - 1)["y"].cast("double"), F.lit(0.0)).alias("y1"),
            F.get("t", i)["x"].cast("double").alias("x2"), F.get("t", i)["y"].cast("double").alias("y2"),
        ),
    )
    return rows.where(F.size("t") > 0).select("file", "group_no", "path_no", F.inline(seg)).where("c = 'L'").drop("c")
