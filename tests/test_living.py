"""The living room split: cuts at reflex corners, parts with labels, the rest."""

from planspark.operators import living as L

RING = [(0, 0), (6, 0), (6, 2), (4, 2), (4, 4), (6, 4), (6, 6), (0, 6), (0, 4), (2, 4), (2, 2), (0, 2)]
K = ["dwg_id"]


def rings(spark, *rows):
    return spark.createDataFrame([(d, i, [{"x": float(x), "y": float(y)} for x, y in r]) for d, i, r in rows], "dwg_id long, room_id long, ring array<struct<x:double,y:double>>")


def test_cuts_of_a_double_cross(spark):
    """Both bars of the shape are cut off along the waist; the cuts across the bars are shorter parts inside them."""
    moved = [(10 * x + 20, 10 * y + 20) for x, y in RING]
    for ring in (moved, moved[::-1], moved[5:] + moved[:5]):
        found = L.cut_parts(rings(spark, (1, 1, ring)).drop("room_id"), K).collect()
        boxes = sorted((min(p["x"] for p in r["ring"]), min(p["y"] for p in r["ring"]), max(p["x"] for p in r["ring"]), max(p["y"] for p in r["ring"]), r["area"]) for r in found)
        assert boxes == [(20, 20, 80, 40, 1200), (20, 60, 80, 80, 1200)]


def test_rooms_after_the_split(spark):
    notched = [(100, 100), (400, 100), (400, 200), (300, 200), (300, 300), (100, 300)]
    box = [(0, 500), (50, 500), (50, 550), (0, 550)]
    rooms = rings(spark, (1, 1, box), (1, 2, notched), (1, 3, box), (2, 1, box), (3, 1, box))
    labels = [(1, 2, 10, "客厅", 150.0, 150.0), (1, 2, 11, "餐厅", 380.0, 120.0), (2, 1, 12, "客厅", 10.0, 510.0), (3, 1, 13, "卧室", 10.0, 510.0)]
    table = spark.createDataFrame(labels, "dwg_id long, room_id long, id long, text string, x double, y double")
    got = sorted(L.living_room_split(rooms, table, K).collect(), key=lambda r: (r["dwg_id"], r["room_id"]))
    assert [(r["dwg_id"], r["room_id"], r["label_id"], round(r["area"], 4)) for r in got] == [
        (1, 1, None, 0.25), (1, 2, None, 0.25), (1, 3, 11, 1.0), (1, 4, 10, 4.0), (2, 1, 12, 0.25), (3, 1, None, 0.25),
    ]
    rest = got[3]
    assert rest["functions"] == ["living"] and rest["perimeter"] == 8.0 and len(rest["rings"]) == 1
    corners = {(p["x"], p["y"]) for p in rest["rings"][0]}
    assert {(100, 100), (300, 100), (300, 300), (100, 300)} <= corners


def test_cuts_stop_at_their_longest(spark):
    long = [(100, 100), (900, 100), (900, 900), (800, 900), (800, 500), (100, 500)]
    found = L.cut_parts(rings(spark, (1, 1, long)).drop("room_id"), K).collect()
    assert [round(r["area"]) for r in found] == [40000]
    assert L.cut_parts(rings(spark, (1, 1, [(0, 0), (5, 0), (5, 5)])).drop("room_id"), K).count() == 0
