"""Doors, walls and rooms on small drawings."""

import random

import pytest
from pyspark.sql import functions as F

from planspark.functions import geometry as G
from planspark.functions import text as T
from planspark.operators import doors as D
from planspark.operators import rects as R
from planspark.operators import rooms as P

K = ["dwg_id"]


def boxes(rng, n, size, spread):
    out = []
    for i in range(n):
        x, y = rng.randrange(spread), rng.randrange(spread)
        out.append((0, i, x, y, x + rng.randrange(1, size), y + rng.randrange(1, size)))
    return out


def meet(a, b, gap):
    if gap is None:
        return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    return max(a[0], b[0]) - min(a[2], b[2]) <= gap and max(a[1], b[1]) - min(a[3], b[3]) <= gap


@pytest.mark.parametrize("gap", [None, 10])
def test_close_boxes(spark, gap):
    rows = boxes(random.Random(2), 70, 25, 400)
    df = spark.createDataFrame(rows, "dwg_id int, id int, x1 int, y1 int, x2 int, y2 int")
    got = {(r.x1, r.y1, r.x2, r.y2) for r in R.close_boxes(df, K, gap).collect()}
    todo = [r[2:] for r in rows]
    while True:
        hit = next(((i, j) for i in range(len(todo)) for j in range(i) if meet(todo[i], todo[j], gap)), None)
        if hit is None:
            break
        a, b = todo.pop(hit[0]), todo.pop(hit[1])
        todo.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))
    assert got == set(todo)


def test_slide_doors(spark):
    rows = boxes(random.Random(4), 14, 30, 130)
    df = spark.createDataFrame(rows, "dwg_id int, id int, x1 int, y1 int, x2 int, y2 int")
    got = {(r.id, r.x1, r.y1, r.x2, r.y2) for r in D.slide_door_merge(df, K).collect()}
    free, want = {r[1]: r[2:] for r in rows}, set()
    while free:
        i = min(free)
        box, grown = free.pop(i), False
        while True:
            j = next((j for j in sorted(free) if meet(box, free[j], 10) and (box[0], box[2]) != (free[j][0], free[j][2])
                      and (box[1], box[3]) != (free[j][1], free[j][3])), None)
            if j is None:
                break
            o, grown = free.pop(j), True
            box = (min(box[0], o[0]), min(box[1], o[1]), max(box[2], o[2]), max(box[3], o[3]))
        if grown:
            want.add((i, *box))
    assert got == want


def test_double_door(spark):
    arcs = spark.createDataFrame(
        [(0, 1, 1491, 658, 1572, 739), (0, 2, 1572, 712, 1599, 739), (0, 3, 10, 10, 20, 20)],
        "dwg_id int, id int, x1 int, y1 int, x2 int, y2 int",
    )
    got = sorted((r.kind, r.x1, r.y1, r.x2, r.y2) for r in D.double_door_merge(arcs, K).collect())
    assert got == [("double", 1491, 658, 1599, 739), ("single", 10, 10, 20, 20)]


def ring(x1, y1, x2, y2):
    return [{"x": float(x), "y": float(y)} for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]


WALLS = [(0, 0, 300, 10), (0, 190, 300, 200), (0, 10, 10, 190), (290, 10, 300, 190), (140, 10, 150, 190), (50, 80, 70, 100)]


def test_rooms_with_a_hole(spark):
    rings = spark.createDataFrame([(0, i, ring(*w)) for i, w in enumerate(WALLS)], "dwg_id int, poly_id int, ring array<struct<x:double,y:double>>")
    labels = spark.createDataFrame(
        [(0, 1, "主卧室", 30, 30), (0, 2, "客厅", 200, 50), (0, 3, "餐厅", 220, 60), (0, 4, "厨房", None, 60)],
        "dwg_id int, id int, text string, x int, y int",
    )
    got = sorted((round(r.area, 4), round(r.perimeter, 2), r.function) for r in P.rooms(rings, labels, K).collect())
    assert got == [
        (round((130 * 180 - 400) / 1e4, 4), round((620 + 80) / 1e2, 2), ["bed"]),
        (round(140 * 180 / 1e4, 4), 6.4, ["living", "canteen"]),
    ]


def test_wall_outline_of_two_blocks(spark):
    lines = [(0, 0, 100, 0), (100, 0, 100, 50), (100, 50, 0, 50), (0, 50, 0, 0), (60, 0, 60, 50), (100, 50, 160, 50), (160, 50, 160, 90), (160, 90, 100, 90), (100, 90, 100, 50), (10, 10, 20, 10)]
    df = spark.createDataFrame([(0, i, *l) for i, l in enumerate(lines)], "dwg_id int, id int, x1 int, y1 int, x2 int, y2 int")
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    out = P.wall_outlines(df, K).groupBy("block").agg((F.abs(F.sum(cross)) / 2).alias("a")).collect()
    assert sorted(r.a for r in out) == [2400.0, 5000.0]


NOTCHED = [(0, 0), (10, 0), (10, 10), (4, 10), (4, 8), (4, 5), (3, 5), (3, 8), (3, 10), (0, 10)]


@pytest.mark.parametrize(
    "inner, stays",
    [
        ([(0, 1), (10, 1), (10, 8), (0, 8)], True),
        ([(0, 1), (10, 1), (10, 5), (0, 5)], False),
        ([(0, 6), (3, 6), (3, 9), (0, 9)], False),
        ([(2, 6), (5, 6), (5, 7), (2, 7)], True),
        ([(1, 1), (9, 1), (5, 4)], False),
        ([(0, 10), (3, 10), (3, 5), (4, 5), (4, 10), (10, 10), (10, 0), (0, 0)], False),
    ],
)
def test_contained_polygons(spark, inner, stays):
    rings = [(0, 1, [{"x": float(x), "y": float(y)} for x, y in NOTCHED]), (0, 2, [{"x": float(x), "y": float(y)} for x, y in inner])]
    df = spark.createDataFrame(rings, "dwg_id int, id int, ring array<struct<x:double,y:double>>")
    assert {r.id for r in P.drop_contained_rings(df, K).collect()} == ({1, 2} if stays else {1})


def test_natural_keys_of_long_numbers(spark):
    names = ["a2", "a10", "a0010b", "a123456789012345678901234", "a123456789012345678909999", "b1", "7"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(T.natural_key(F.col("n"))).collect()]
    assert got == ["7", "a2", "a10", "a0010b", "a123456789012345678901234", "a123456789012345678909999", "b1"]


def test_iou_of_rings_without_pixels(spark):
    from planspark.operators import masks as M

    pairs = spark.createDataFrame([(0, 1, 2), (0, 3, 2)], "dwg_id int, a int, b int")
    runs = spark.createDataFrame([(0, 1, 0, 0, 3), (0, 2, 0, 2, 5)], "dwg_id int, id int, y int, x0 int, x1 int")
    out = M.polygon_iou(pairs, runs.withColumnRenamed("id", "a"), runs.withColumnRenamed("id", "b"), K).collect()
    assert {(r.a, r.b, round(r.iou, 4)) for r in out} == {(1, 2, round(2 / 6, 4)), (3, 2, 0.0)}


def test_cycles_of_door_lines(spark):
    from planspark.operators import cycles as C
    from planspark.operators import faces

    def box(x1, y1, x2, y2):
        return [(x1, y1, x2, y1), (x1, y2, x2, y2), (x1, y1, x1, y2), (x2, y1, x2, y2)]

    # two leaves that slide past each other, a square, and a leaf whose long side has a line on it
    lines = box(0, 0, 80, 10) + box(75, 12, 160, 20) + box(300, 300, 340, 340) + box(0, 500, 100, 510) + box(40, 510, 60, 600)
    df = spark.createDataFrame([(0, i, *l) for i, l in enumerate(lines)], "dwg_id int, id int, x1 int, y1 int, x2 int, y2 int")
    from planspark.operators.segments import merge_collinear, split_all

    directed = faces.planar_faces(split_all(merge_collinear(df, K), K), K)
    four = {(r.x1, r.y1, r.x2, r.y2) for r in C.four_point_cycles(directed, K).collect()}
    assert four == {(0, 0, 80, 10), (75, 12, 160, 20), (300, 300, 340, 340), (40, 510, 60, 600)}
    rects = C.rect_cycles(directed, K)
    assert {(r.x1, r.y1, r.x2, r.y2) for r in rects.collect()} == four | {(0, 500, 100, 510)}
    leaves = {(r.otype, r.x1, r.y1, r.x2, r.y2) for r in C.cycles_to_rects(rects, K).collect()}
    assert leaves == {(0, 0, 0, 80, 10), (0, 75, 12, 160, 20), (0, 0, 500, 100, 510)}
    doors = C.slide_doors_by_cycles(df, K).collect()
    assert [(r.otype, r.x1, r.y1, r.x2, r.y2) for r in doors] == [(0, 0, 0, 160, 20)]


def test_subset_cycles(spark):
    from planspark.operators import cycles as C

    def ring_of(*points):
        return [{"x": float(x), "y": float(y)} for x, y in points]

    a = ring_of((0, 0), (10, 0), (10, 5), (10, 10), (0, 10))
    rows = [(0, 1, a), (0, 2, a[:2] + a[3:]), (0, 3, [a[0], a[3], a[1], a[2], a[4]]), (0, 4, ring_of((0, 0), (10, 0), (5, 5))), (0, 5, a), (1, 2, a[:3])]
    df = spark.createDataFrame(rows, "dwg_id int, id int, ring array<struct<x:double,y:double>>")
    assert {(r.dwg_id, r.id) for r in C.drop_subset_cycles(df, K).collect()} == {(0, 1), (0, 4), (1, 2)}


def test_viewport_and_dates(spark):
    row = spark.range(1).select(
        *[F.lit(v).alias(n) for n, v in (("rx1", 0.0), ("ry1", 0.0), ("rx2", 100.0), ("ry2", 50.0), ("img_w", 200), ("img_h", 200), ("x1", 10.0), ("y1", 10.0), ("x2", 20.0), ("y2", 30.0))],
        F.lit("Thu Aug 02 2024 11:23:50 GMT+0800 (CST)").alias("t"),
    )
    box = row.select(*[c.alias(n) for n, c in G.Viewport.of().rect(G.cols("x1 y1 x2 y2")).items()]).first()
    assert tuple(box) == (20, 90, 40, 130)
    assert str(row.select(T.js_date(F.col("t"))).first()[0]) == "2024-08-02 11:23:50"
