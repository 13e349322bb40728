"""Listed rows are joined by shuffle: the size of what they are listed from says little about them."""

import pytest
from pyspark.sql import functions as F

from planspark.operators import faces as P
from planspark.operators import masks as M
from planspark.operators import rooms as R
from planspark.operators.spatial import box_anti, box_pairs

RING = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 60D, 'y', 0D), named_struct('x', 60D, 'y', 60D), named_struct('x', 0D, 'y', 60D))"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def rings(spark, tmp_path):
    # a table of a few bytes, so that Spark would send any part of it to the driver
    spark.range(20).selectExpr("id % 2 AS d", "id", f"{RING} AS ring").write.parquet(str(tmp_path / "rings"))
    return spark.read.parquet(str(tmp_path / "rings"))


def test_no_listed_rows_go_through_the_driver(spark, rings):
    box = rings.select("d", "id", *[F.lit(v).alias(n) for n, v in (("x1", 0), ("y1", 0), ("x2", 50), ("y2", 5))])
    points = rings.select("d", "id", F.lit(7.0).alias("x"), F.lit(9.0).alias("y"))
    edges = R.ring_edge_table(rings, ["d"], "id").withColumnRenamed("id", "room")
    runs = M.polygon_to_runs(R.ring_edge_table(rings, ["d"], "id"), ["d", "id"])
    pairs = rings.select("d", F.col("id").alias("a"), F.col("id").alias("b"))
    room = rings.select("d", F.col("id").alias("room"), "ring")
    labels = points.withColumn("room", F.col("id"))
    found = {
        "box_pairs": box_pairs(box, box, ["d"], 64),
        "box_anti": box_anti(box, box, ["d"], ["id"], 64),
        "points_in_rings": P.points_in_rings(points, edges, ["d"], "room"),
        "polygon_iou": M.polygon_iou(pairs, runs.withColumnRenamed("id", "a"), runs.withColumnRenamed("id", "b"), ["d"]),
        "nearest_label": R.nearest_label(R.grid_points(room, ["d", "room"], 4), labels, ["d", "room"]),
        "label_grid_split": R.label_grid_split(room, labels, ["d", "room"], 4),
        "label_voronoi_split": R.label_voronoi_split(room, labels, ["d", "room"]),
        "door_wall_touch": R.door_wall_touch(box, rings, ["d"]),
        "snap_doors": R.snap_doors(box, rings, ["d"]),
    }
    assert [name for name, df in found.items() if "Broadcast" in plan(df)] == []
    assert found["points_in_rings"].count() == 200
