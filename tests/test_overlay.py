"""Exact overlap of oblique rings."""

import math
import random

from planspark.operators import masks as M


def area(ring):
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) / 2


def clipped(ring, convex):
    """A ring cut by the half planes of a convex one that runs counter-clockwise."""
    for (ax, ay), (bx, by) in zip(convex, convex[1:] + convex[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            fp, fq = side(p), side(q)
            if fp >= 0:
                out.append(p)
            if fp * fq < 0:
                t = fp / (fp - fq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
    return ring


def star(x, y, n, near, far, turn):
    return [(x + r * math.cos(turn + k * math.pi / n), y + r * math.sin(turn + k * math.pi / n)) for k in range(2 * n) for r in [far if k % 2 else near]]


def polygon(x, y, n, r, turn):
    return star(x, y, n, r * math.cos(math.pi / n), r, turn)


def test_overlap_of_oblique_rings(spark):
    dice = random.Random(9)
    square, diamond = [(0, 0), (2, 0), (2, 2), (0, 2)], [(2.5, 1), (1, 2.5), (-0.5, 1), (1, -0.5)]
    cases = [(square, diamond, 3.5), (diamond, square[::-1], 3.5), (square, square, 4.0), (square, [(2, 0), (4, 0), (4, 2), (2, 2)], 0.0)]
    cases += [(square, [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)], 0.25), (square, [(5, 5), (6, 5), (6, 6)], 0.0), (square, [(0, 0), (2, 0), (2, 1), (0, 1)], 2.0)]
    for _ in range(40):
        one = star(dice.uniform(0, 10), dice.uniform(0, 10), dice.randrange(3, 7), dice.uniform(1, 3), dice.uniform(3, 6), dice.uniform(0, 3))
        two = polygon(dice.uniform(0, 10), dice.uniform(0, 10), dice.randrange(3, 8), dice.uniform(2, 6), dice.uniform(0, 3))
        cases.append((one, two, area(clipped(one, two)) if len(clipped(one, two)) > 2 else 0.0))
    ring = "array<struct<x:double,y:double>>"
    rows = [(1, k, [{"x": float(x), "y": float(y)} for x, y in a], [{"x": float(x), "y": float(y)} for x, y in b]) for k, (a, b, _) in enumerate(cases)]
    table = spark.createDataFrame(rows, f"dwg_id long, a long, one {ring}, two {ring}")
    pairs = table.selectExpr("dwg_id", "a", "a AS b")
    got = {r["a"]: r for r in M.overlay_iou(pairs, table.selectExpr("dwg_id", "a", "one AS ring"), table.selectExpr("dwg_id", "a AS b", "two AS ring"), ["dwg_id"]).collect()}
    assert len(got) == len(cases)
    for k, (a, b, common) in enumerate(cases):
        assert abs(got[k]["common"] - common) < 1e-6, k
        assert abs(got[k]["iou"] - common / (abs(area(a)) + abs(area(b)) - common)) < 1e-6
    assert sum(c > 1 for *_, c in cases) > 20


def test_pairs_worked_on_whole_equal_those_by_edges(spark):
    """Also a ring listed twice, one without points, one with a number missing, one without area and one that is null."""
    dice = random.Random(10)
    ring = "array<struct<x:double,y:double>>"
    point = lambda x, y: {"x": x if x is None else float(x), "y": float(y)}
    rings = [(1, k, [point(round(x), round(y)) for x, y in star(dice.uniform(0, 9), dice.uniform(0, 9), dice.randrange(3, 6), 2, 6, 0)]) for k in range(9)]
    rings += [(1, 9, []), (1, 10, [point(0, 0), point(5, 5), point(9, 9)]), (1, 11, [point(None, 0), point(9, 0), point(9, 9)]), (1, 12, None), rings[0]]
    rings = spark.createDataFrame(rings, f"dwg_id long, id long, ring {ring}")
    left, right = rings.withColumnRenamed("id", "a"), rings.withColumnRenamed("id", "b")
    pairs = left.select("dwg_id", "a").distinct().join(right.select("dwg_id", "b").distinct(), "dwg_id")
    rows = lambda df: sorted((r["a"], r["b"], round(r["common"], 6) + 0.0, round(r["iou"], 6) + 0.0) for r in df.collect())
    want = rows(M._overlay_by_edges(pairs, left, right, ["dwg_id"]))
    assert rows(M.overlay_iou(pairs, left, right, ["dwg_id"])) == want
    assert sum(0.1 < w[3] < 0.9 for w in want) > 20


def test_small_rings_make_no_rows_of_edges(spark, monkeypatch):
    monkeypatch.setattr(M, "_overlay_by_edges", None)
    rows = [(1, 1, 2, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])]
    rings = spark.createDataFrame(rows, "dwg_id long, a long, b long, ring array<struct<x:double,y:double>>")
    assert [tuple(r) for r in M.overlay_iou(rings, rings.drop("b"), rings.drop("a"), ["dwg_id"]).collect()] == [(1, 1, 2, 4.0, 1.0)]
