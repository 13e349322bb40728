"""Known results of small real inputs."""

import pytest
from pyspark.sql import functions as F

from planspark.functions import geometry as G
from planspark.operators import metrics as M

RANGE = (-13797.863969016031, -17390.14303809416, 2577.9994704378305, -4800.9944446952086)
IMAGE = (1781, 1259)
WINDOWS = [
    (-965.35702989462879, -11811.461514753608, -265.357029894054, -11611.461514753608),
    (-12165.357029894516, -11811.461234079525, -11564.767653917694, -11611.461514753606),
    (-2065.3597987664834, -9661.461553531899, -1465.3597987664834, -9461.4516923644969),
    (-12165.357029894516, -11811.461234079525, -11965.357029894425, -8911.461514753606),
]


def test_windows_in_pixels(spark):
    names = "id int, rx1 double, ry1 double, rx2 double, ry2 double, img_w int, img_h int, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame([(i, *RANGE, *IMAGE, *w) for i, w in enumerate(WINDOWS)], names)
    boxes = df.select("id", *[c.alias(f"p{n}") for n, c in G.Viewport.of().rect(G.cols("x1 y1 x2 y2")).items()])
    got = [tuple(r)[1:] for r in boxes.orderBy("id").collect()]
    assert got == [(1355, 681, 1425, 701), (235, 681, 295, 701), (1245, 466, 1305, 486), (235, 411, 255, 701)]


AREAS = [
    ("balcony", 2.844600, 2.980), ("living", 30.925483, 31.348), ("balcony", 4.762625, 4.931), ("kitchen", 4.939791, 4.924),
    ("rest", 3.872085, 3.850), ("bed", 12.479159, 12.529), ("rest", 3.494724, 3.490), ("bed", 7.666905, 7.664),
    ("bed", 10.246353, 10.200), ("balcony", 7.297031, 7.254),
]


def test_area_log(spark):
    rooms = spark.createDataFrame(AREAS, "room string, measured double, drawn double")
    s = M.area_diff_stats(rooms).first()
    assert (s.mean_diff, s.mean_pct, s.total_diff, s.ratio) == pytest.approx((0.09110, 1.21661, 0.91102, 0.010291), abs=2e-5)
    assert rooms.where(F.col("room") == "balcony").count() == 3
