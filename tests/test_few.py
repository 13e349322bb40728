"""Drawings with few rows are settled by tasks, others by joins and rounds; the rows are the same."""

import random

import pytest
from pyspark.sql import functions as F

from planspark.catalog import plans
from planspark.operators import cycles, faces, masks, planar, rects, rooms, rounds, segments
from planspark.session import cut

K = ["k"]
LINE = "k long, x1 long, y1 long, x2 long, y2 long"


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def both_ways(monkeypatch, make, found, by_joins):
    """``make()`` by tasks with the given functions out of use, then by them alone: both results."""
    with monkeypatch.context() as m:
        for module, name in by_joins:
            m.setattr(module, name, lambda *a, **k: pytest.fail("small groups went by joins"))
        few = found(make())
    with monkeypatch.context() as m:
        m.setattr(planar, "FEW", 1)
        return few, found(make())


def lines(seed, odd=False):
    dice = random.Random(seed)
    out = []
    for k in range(5):
        for _ in range(40):
            x, y, long = dice.randrange(12) * 5, dice.randrange(12) * 5, dice.randrange(1, 8) * 5
            out.append((k, x, y, x + long, y) if dice.random() < 0.5 else (k, x, y + long, x, y))
    if odd:  # a slanted line, a null, a null key
        out += [(1, 0, 0, 17, 31), (2, None, 0, 5, 5), (None, 0, 0, 9, 0), (None, 4, -3, 4, 3)]
    return out + out[:30]


def test_lines_are_split_and_walked_by_tasks(spark, monkeypatch):
    df = spark.createDataFrame(lines(1), LINE)
    split = lambda: segments.split_all(segments.merge_collinear(df, K), K)
    few, joins = both_ways(monkeypatch, split, rows, [(segments, "_split_by_joins")])
    assert few == joins and len(few) > 300
    edges = cut(split())
    monkeypatch.setattr(faces, "half_edges", lambda *a: pytest.fail("small groups went by joins"))
    directed = faces.planar_faces(edges, K).collect()
    assert len(directed) > 200
    at = {(r["k"], r["face"], r["pos"]): (r["x1"], r["y1"], r["x2"], r["y2"]) for r in directed}
    ahead = lambda k, face, pos: at.get((k, face, pos + 1)) or at[k, face, 0]
    assert len(at) == len(directed) and all(e[2:] == ahead(*key)[:2] for key, e in at.items())
    assert all(tuple(face) == min(e for (g, f, _), e in at.items() if (g, f) == (k, face)) for k, face, _ in at)


def test_odd_drawings_go_by_joins(spark):
    df = spark.createDataFrame(lines(2, odd=True), LINE)
    assert rows(segments.split_all(df, K)) == rows(segments._split_by_joins(df, K))


def test_walks_and_borders_are_linked_by_tasks(spark, monkeypatch):
    """Two squares that touch in a corner are walked round together, and are two loops."""
    square = lambda x: [(0, x, x, x + 9, x), (0, x, x + 9, x + 9, x + 9), (0, x, x, x, x + 9), (0, x + 9, x, x + 9, x + 9)]
    walked = cut(faces.planar_faces(spark.createDataFrame(square(0) + square(9), LINE), K))
    outer = faces.face_table(walked, K).where("area < 0")
    assert outer.count() == 1
    monkeypatch.setattr(faces, "_loop_links", lambda *a: pytest.fail("small groups went by joins"))
    monkeypatch.setattr(faces, "_border_links", lambda *a: pytest.fail("small groups went by joins"))
    blocks = faces.block_rings(walked.join(outer.select("k", "face"), ["k", "face"], "left_semi"), K)
    assert sorted(r["count"] for r in blocks.groupBy("block").count().collect()) == [4, 4]
    kept = faces.face_table(walked, K).where("area > 0").select("k", "face", F.lit(1).alias("part"))
    rings = faces.region_rings(walked, kept, K, ["part"]).first()["rings"]
    assert sorted(len(r) for r in rings) == [4, 4]


def test_points_are_asked_by_tasks(spark, monkeypatch):
    """Also equal points, which count together, points on borders, nulls and a point without a drawing."""
    dice = random.Random(4)
    ring = lambda x, y, w, h: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w // 2, y + h), (x, y + h))]
    rings = spark.createDataFrame([(k, i, ring(*(dice.randrange(20) for _ in range(2)), dice.randrange(4, 30), dice.randrange(4, 30))) for k in range(4) for i in range(5)], "k long, o long, ring array<struct<x:double,y:double>>")
    spots = [(k, f"p{i}", dice.randrange(40), dice.randrange(40)) for k in range(4) for i in range(60)]
    spots += spots[:9] + [(1, None, 5, 5), (1, "n", None, 5), (None, "m", 5, 5)]
    points = spark.createDataFrame(spots, "k long, name string, x long, y long")
    edges = rooms.ring_edge_table(rings, K, "o")
    for border in (False, True):
        ask = lambda: faces.points_in_rings(points, edges, K, "o", 16, border)  # noqa: B023, E731
        few, joins = both_ways(monkeypatch, ask, rows, [(faces, "_points_by_joins")])
        assert few == joins and len(few) > 50


@pytest.mark.parametrize("method", ["arc", "slide"])
def test_doors_meet_walls_by_tasks(spark, monkeypatch, method):
    """Also a door that comes twice, two doors of one id and a turned one."""
    dice = random.Random(5)
    ring = lambda x, y, w, h: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y + 3), (x + w, y + h), (x, y + h))]
    walls = spark.createDataFrame([(k, i, ring(dice.randrange(150), dice.randrange(150), dice.randrange(9, 60), dice.randrange(9, 60))) for k in range(4) for i in range(5)], "k long, id long, ring array<struct<x:double,y:double>>")
    boxes = []
    for k in range(4):
        for i in range(40):
            x, y, long = dice.randrange(200), dice.randrange(200), dice.randrange(20, 50)
            boxes.append((k, i, x, y, x + long, y + 5) if dice.random() < 0.5 else (k, i, x, y, x + 5, y + long))
    turned = [(3, 99, 50, 50, 40, 45)]
    doors = spark.createDataFrame(boxes + boxes[:3] + [(0, 0, 5, 5, 50, 9)], f"k long, id long, {LINE[8:]}")
    few, joins = both_ways(monkeypatch, lambda: rooms.snap_doors(doors, walls, K, method), rows, [(rooms, "_fitted_by_joins")])
    assert few == joins and few != rows(doors)
    few, joins = both_ways(monkeypatch, lambda: rooms.door_wall_touch(doors, walls, K), rows, [(rooms, "_touching")])
    assert few == joins and 0 < len(few) < doors.count()
    odd = doors.unionByName(spark.createDataFrame(turned, doors.schema))
    assert len(rows(rooms.snap_doors(odd, walls, K, method))) == odd.count()


def test_few_links_conflicts_and_boxes_take_no_rounds(spark, monkeypatch):
    dice = random.Random(6)
    for module, name in ((rounds, "_least_by_rounds"), (rounds, "_dropped_by_rounds"), (rects, "_close_by_rounds")):
        monkeypatch.setattr(module, name, lambda *a: pytest.fail("small groups went by rounds"))
    pairs = [(k, dice.randrange(40), dice.randrange(40)) for k in "abcd" for _ in range(25)] + [("a", 3, 3), ("b", None, 4), (None, 1, 2)]
    edges = spark.createDataFrame(pairs, "k string, a long, b long")
    nodes = spark.createDataFrame([(k, i) for k in "abcd" for i in range(40)], "k string, id long")
    comp = {(k, i): i for k in "abcd" for i in range(40)}
    links = [(k, a, b) for k, a, b in pairs if k and a is not None]
    for _ in range(40):
        for k, a, b in links:
            comp[k, a] = comp[k, b] = min(comp[k, a], comp[k, b])
    assert {(r["k"], r["id"]): r["comp"] for r in rounds.components(nodes, edges, K).collect()} == comp
    ordered = sorted({(k, min(a, b), max(a, b)) for k, a, b in links if a != b})
    gone = set()
    for k, i in sorted(comp):
        if (k, i) not in gone:
            gone |= {(g, b) for g, a, b in ordered if (g, a) == (k, i)}
    got = rounds.greedy_dropped(spark.createDataFrame(ordered, "k string, win long, lose long"), K)
    assert {(r["k"], r["lose"]) for r in got.collect()} == gone
    boxes = [(k, i, x := dice.randrange(200), y := dice.randrange(200), x + dice.randrange(25), y + dice.randrange(1, 25)) for k in "abcd" for i in range(60)]
    table = spark.createDataFrame(boxes, f"k string, id long, {LINE[8:]}")
    for gap in (None, 4):
        want = [list(b) for b in boxes]
        meet = lambda p, q: p[0] == q[0] and (
            (p[4] > q[2] and q[4] > p[2] and p[5] > q[3] and q[5] > p[3]) if gap is None  # noqa: B023
            else max(p[2], q[2]) - min(p[4], q[4]) <= gap and max(p[3], q[3]) - min(p[5], q[5]) <= gap  # noqa: B023
        )
        while found := next(((i, j) for i, p in enumerate(want) for j, q in enumerate(want[:i]) if meet(p, q)), None):
            q, p = want.pop(found[0]), want[found[1]]
            p[1:] = [min(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3]), max(p[4], q[4]), max(p[5], q[5])]
        assert sorted(map(tuple, rects.close_boxes(table, K, gap, 64).select("k", "id", *planar.SEG).collect())) == sorted(map(tuple, want))
    twice = spark.createDataFrame([*boxes, boxes[0]], table.schema)
    small, large = planar.closed_small(twice, K, None)
    assert large is None and {r["k"] for r in small.where("open").collect()} == {"a"}


def test_masks_of_few_pixels(spark, monkeypatch):
    dice = random.Random(7)
    raw = [(k, y, x := dice.randrange(40), x + dice.randrange(9)) for k in range(4) for y in range(8) for _ in range(3)]
    runs = cut(masks.union_runs(spark.createDataFrame(raw, "k long, y long, x0 long, x1 long"), K))
    few, joins = both_ways(monkeypatch, lambda: masks.column_rle(runs, K, 50, 8), rows, [(masks, "_rle_by_joins")])
    assert few == rows(masks._rle_by_joins(runs, K, 8)) == joins
    shape = [(k, i, y, i * 3 + k, i * 3 + k + 10 + (y % 5 if i == 2 else 0)) for k in range(3) for i in range(5) for y in range(i, i + 20)]
    filled = spark.createDataFrame(shape, "k long, id long, y long, x0 long, x1 long")
    pairs = spark.createDataFrame([(k, a, b) for k in range(3) for a in range(5) for b in range(a + 1, 6)], "k long, a long, b long")
    iou = lambda: masks.polygon_iou(pairs, filled.withColumnRenamed("id", "a"), filled.withColumnRenamed("id", "b"), K)
    few, joins = both_ways(monkeypatch, iou, rows, [(masks, "_common_by_joins")])
    assert few == joins and len(few) == 45


def test_labels_go_along_with_their_rooms(spark, monkeypatch):
    """Rooms of one ring and few labels need no search; a room listed twice is searched as before."""
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (40, 0), (40, 30), (25, 30), (25, 12), (0, 30))]
    rings = spark.createDataFrame([(k, ring) for k in range(4)], "room long, ring array<struct<x:double,y:double>>")
    labels = spark.createDataFrame([(0, 1, 5.0, 5.0), (0, 2, 30.0, 20.0), (0, 3, 30.0, 20.0), (1, 4, 9.0, 9.0), (2, 5, 3.0, 20.0)], "room long, id long, x double, y double")
    want = rows(rooms.nearest_label(rooms._points_by_rows(rings, ["room"], 2), labels, ["room"]))
    found = lambda table: rooms.nearest_label(rooms.grid_points(rooms.with_labels(table, labels, ["room"]), ["room"], 2), labels, ["room"])
    with monkeypatch.context() as m:
        m.setattr(rooms, "candidate_labels", lambda *a: pytest.fail("few labels were searched"))
        got = rows(found(rings.where("room < 3")))
        parts = rows(rooms.label_voronoi_split(rings, labels, ["room"]).select("room", "label_id", F.round("area", 9)))
    assert got == want and len(want) > 400
    monkeypatch.setattr(rooms, "FEW_LABELS", 1)
    assert rows(found(rings)) == want
    assert rows(rooms.label_voronoi_split(rings, labels, ["room"]).select("room", "label_id", F.round("area", 9))) == parts


def test_guillotine_query_has_the_rings_of_each_label(spark, tmp_path):
    orders = [(k, 7 * k % 31) for k in range(64)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    out = plans.label_guillotine_split(spark, str(tmp_path)).collect()
    assert out
    for r in out:
        size = 0.0
        for ring in r["rings"]:
            size += sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring, ring[1:] + ring[:1])) / 2
        assert abs(size / 1e4 - r["area"]) < 1e-9


def test_shuffle_files_go_with_the_step_that_made_them(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").count("/shuffle_")
    before = files()
    made = cut(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count())
    assert files() <= before and made.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_leaf_faces_are_rectangles(spark):
    box = lambda k, x, y: [(k, x, y, x + 80, y), (k, x, y + 10, x + 80, y + 10), (k, x, y, x, y + 10), (k, x + 80, y, x + 80, y + 10)]
    df = spark.createDataFrame([e for k in range(3) for i in range(4) for e in box(k, 100 * i, 30 * i)], LINE)
    directed = faces.planar_faces(segments.split_all(segments.merge_collinear(df, K), K), K)
    assert cycles.four_point_cycles(directed, K).count() == cycles.rect_cycles(directed, K).count() == 12
