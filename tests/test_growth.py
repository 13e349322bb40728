"""What queries list, compute and send per row: plans stay lean and the results are those of plain loops."""

import inspect
import math
import random

from pyspark.sql import functions as F

from planspark.functions import geometry as G
from planspark.operators import doors as D
from planspark.operators import legend as L
from planspark.operators import masks as M
from planspark.operators import segments as S
from planspark.operators.spatial import cells

RUN = "k long, side long, y long, x0 long, x1 long"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rings(spark):
    draw = random.Random(3)
    out = [(1, [(0, 0), (10, 0), (0, 8), (10, 8)]), (2, [(2, 1), (9, 1), (9, 300), (5, 300), (5, 20), (2, 20)]), (3, [(0.5, 0.25), (7.5, 3.75), (1.25, 9.5)])]
    out += [(k, [(draw.randint(0, 40), draw.randint(0, 200)) for _ in range(7)]) for k in range(4, 24)]
    rows = [(k, p[i][0] * 1.0, p[i][1] * 1.0, p[(i + 1) % len(p)][0] * 1.0, p[(i + 1) % len(p)][1] * 1.0) for k, p in out for i in range(len(p))]
    return rows, spark.createDataFrame(rows, "k long, x1 double, y1 double, x2 double, y2 double")


def test_filled_rings_are_sent_by_strips(spark):
    rows, edges = rings(spark)
    want = []
    for k in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == k]
        for y in range(-1, 302):
            xs = sorted(x1 + (y - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in mine if min(y1, y2) <= y < max(y1, y2))
            for i in range(0, len(xs), 2):
                a, b = math.ceil(xs[i]), math.floor(xs[min(i + 1, len(xs) - 1)])
                want += [(k, y, a, b)] if a <= b else []
    found = M.polygon_to_runs(edges, ["k"])
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # pixel rows are listed after the only grouping, so no window sorts them
    assert "Window" not in plan(found)


def test_run_lengths_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "RLE_CHUNK", 8, raising=False)
    draw, width, height = random.Random(5), 12, 7
    rows = {(k, y, x) for k in (1, 2) for y in range(height) for x in range(width) if draw.random() < 0.6}
    rows |= {(3, y, x) for y in range(height) for x in range(width)}
    runs = M.union_runs(spark.createDataFrame([(k, 0, y, x, x) for k, y, x in rows], RUN), ["k", "side"])
    want = []
    for k in (1, 2, 3):
        at, last, n = sorted(x * height + y for j, y, x in rows if j == k), 0, 0
        while n < len(at):
            m = n
            while m + 1 < len(at) and at[m + 1] == at[m] + 1:
                m += 1
            want.append((k, 0, at[n], at[n] - last, at[m] + 1 - at[n]))
            last, n = at[m] + 1, m + 1
    loose = spark.createDataFrame([(1, 0, None, 2, 3)], RUN)
    odd = M.column_rle(runs.unionByName(loose), ["k", "side"], width, height).where("start IS NULL")
    assert [tuple(r) for r in odd.collect()] == [(1, 0, None, None, None)] * 2
    found = M.column_rle(runs, ["k", "side"], width, height)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # no order over all masks: neither ranges nor a numbering
    assert "RepartitionByExpression [k" in plan(found) and "row_number" not in plan(found)


def test_runs_are_dealt_out_once(spark):
    runs = spark.createDataFrame([(1, 0, 0, 0, 4), (1, 0, 0, 3, 9), (1, 0, 0, 3, 5), (1, 0, 0, 12, 12)], RUN)
    merged = M.union_runs(runs, ["k", "side"])
    assert sorted(map(tuple, merged.collect())) == [(1, 0, 0, 0, 9), (1, 0, 0, 12, 12)]
    assert merged._jdf.queryExecution().sparkPlan().toString().count("REPARTITION_BY_NUM") == 1


def test_linked_runs_once_each(spark):
    runs = spark.createDataFrame([(1, 0, 0, 0, 200), (1, 0, 1, 60, 70), (1, 0, 1, 100, 190), (1, 0, 3, 0, 40)], RUN)
    found = M.run_components(runs, ["k", "side"], 1)
    assert sorted((r["comp"]["y"], r["comp"]["x0"], r["area"]) for r in found.collect()) == [(0, 0, 303), (3, 0, 41)]


def test_pixels_of_segments_without_lambda(spark):
    segments = spark.range(1).selectExpr("id", "1L AS x1", "5L AS y1", "4L AS x2", "0L AS y2")
    found = S.pixels(segments, ["id"])
    want = segments.select("id", F.inline(G.seg_cells(S.S))).collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))
    assert "lambda" not in plan(found)


def test_crossings_are_joined_once(spark):
    rows = [(1, 0, 5, 10, 5), (1, 3, 0, 3, 10), (1, 6, 5, 6, 9), (2, 0, 0, 4, 0)]
    cut_up = S.split_once(spark.createDataFrame(rows, "k long, x1 long, y1 long, x2 long, y2 long"), ["k"])
    assert sorted(map(tuple, cut_up.collect())) == [
        (1, 0, 5, 3, 5), (1, 3, 0, 3, 5), (1, 3, 5, 3, 10), (1, 3, 5, 6, 5), (1, 6, 5, 6, 9), (1, 6, 5, 10, 5), (2, 0, 0, 4, 0),
    ]
    assert sum(line.strip(" :+-").startswith("Join") for line in plan(cut_up).splitlines()) == 1


def test_weights_are_not_computed_in_the_join(spark):
    rows = [(1, i, "A", 0, 10 * i, 0, 10 * i + 5, 5) for i in range(4)]
    nodes = spark.createDataFrame(rows, "k long, id long, block string, line_id long, x1 long, y1 long, x2 long, y2 long")
    near = L.proximity_edges(nodes, ["k"], 5, ("block", "line_id"))
    assert sorted((r["src"], r["dst"]) for r in near.collect()) == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)]
    joins = [line for line in plan(near).splitlines() if "Join" in line]
    assert len(joins) == 1 and "CASE" not in joins[0]


def test_rings_are_built_once(spark):
    point = "CAST(id + {} AS DOUBLE)"
    ring = G.ring_of([(F.expr(point.format(x)), F.expr(point.format(y))) for x, y in ((0, 0), (9, 0), (9, 9), (0, 9))])
    touch = spark.range(3).select(G.point_on_boundary(ring, F.lit(2.0), F.lit(5.0)).alias("t"))
    assert [r["t"] for r in touch.collect()] == [False, False, True]
    # the corner at (id + 9, id + 9) has that number twice
    assert plan(touch).count("+ 9") <= 4


def test_door_lines_are_folded_once(spark, tmp_path):
    rows = [(1, i, 0, y, 100, y) for i, y in enumerate((0, 0, 9, 40))] + [(1, 9, 0, 0, 30, 40), (1, 10, 0, 0, 9, 0)]
    spark.createDataFrame(rows, "d long, id long, x1 long, y1 long, x2 long, y2 long").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines")).withColumns({c: F.col(c) + 1 for c in ("x1", "y1", "x2", "y2")})
    found = D.door_line_pairs(lines, ["d"])
    assert sorted(map(tuple, found.collect())) == [(1, 0, 1, 1, 101, 1), (1, 0, 1, 1, 101, 10)]
    # length and direction are tested on ends that are there, not in the scan
    assert "SQRT" not in "".join(line for line in plan(found).splitlines() if line.strip(" :+-").startswith("Filter"))


def test_door_sized_boxes_are_in_few_cells(spark):
    size = inspect.signature(D.arc_matches).parameters["cell"].default
    listed = cells(spark.range(400).selectExpr("id % 20 * 20 AS x1", "id div 20 * 20 AS y1", "id % 20 * 20 + 100 AS x2", "id div 20 * 20 + 60 AS y2"), size, 5)
    assert listed.count() < 2 * 400
