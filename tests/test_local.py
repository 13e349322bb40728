"""Chunks that shorten rounds: same results wherever chunks end, and less work left for the rounds."""

import random

import numpy as np
from pyspark.sql import functions as F

from planspark.operators import cycles, doors, faces, local, rounds
from planspark.operators.segments import crossings
from test_rounds import sliding_doors


def test_forest_shortens_links_and_joins_the_same_nodes(spark):
    dice = random.Random(3)
    rows = [(k, dice.randrange(300), dice.randrange(300)) for k in (1, 2, None) for _ in range(500)]
    links = spark.createDataFrame(rows, "k long, a long, b long")
    less = local.forest(links.select("k", F.col("a").alias("u"), F.col("b").alias("v")).coalesce(1), ["k"]).collect()
    assert 0 < len(less) <= 2 * 299 and {r["k"] for r in less} == {1, 2}
    nodes = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(300)], "k long, id long")
    parent = {(k, i): i for k in (1, 2) for i in range(300)}
    moved = True
    while moved:
        moved = False
        for k, a, b in rows:
            low = k and min(parent[k, a], parent[k, b])
            if k and (parent[k, a], parent[k, b]) != (low, low):
                parent[k, a] = parent[k, b] = low
                moved = True
    got = {(r["k"], r["id"]): r["comp"] for r in rounds.components(nodes, links, ["k"]).collect()}
    assert got == parent


def test_cycles_are_labelled_in_chunks_and_across_them(spark, monkeypatch):
    dice = random.Random(7)
    rows = []
    for k in range(5):
        ids = dice.sample(range(1000), 200)
        while ids:
            ring, ids = ids[: dice.randrange(1, 30)], ids[30:]
            rows += [(k, a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
    rows.append((None, 1, 1))
    dice.shuffle(rows)
    nxt = {(k, a): b for k, a, b in rows if k is not None}
    want = {}
    for k, a in nxt:
        ring = [a]
        while nxt[k, ring[-1]] != a:
            ring.append(nxt[k, ring[-1]])
        low = min(ring)
        want[k, a] = (low, (len(ring) - ring.index(low)) % len(ring))
    links = spark.createDataFrame(rows, "k long, id long, nxt long")
    for laid in (links.coalesce(1), links.repartition(7)):
        rows_ = local.closed_cycles(laid, ["k"]).where("pos IS NOT NULL").collect()
        assert all(want[r["k"], r["id"]] == (r["cycle"], r["pos"]) for r in rows_)
        got = {(r["k"], r["id"]): (r["cycle"], r["pos"]) for r in rounds.cycle_labels(laid, ["k"]).collect()}
        assert got == want
    assert len(local.closed_cycles(links.coalesce(1), ["k"]).where("pos IS NOT NULL").collect()) == len(want)


def test_faces_without_loose_edges_are_labelled_once(spark, monkeypatch):
    square = [(1, 0, 0, 9, 0), (1, 9, 0, 9, 9), (1, 0, 9, 9, 9), (1, 0, 0, 0, 9)]
    calls = []
    monkeypatch.setattr(faces, "cycle_labels", lambda *a, **k: calls.append(1) or rounds.cycle_labels(*a, **k))
    schema = "k long, x1 long, y1 long, x2 long, y2 long"
    assert faces.planar_faces(spark.createDataFrame(square, schema), ["k"]).count() == 8 and len(calls) == 1
    calls.clear()
    assert faces.planar_faces(spark.createDataFrame([*square, (1, 9, 9, 20, 20)], schema), ["k"]).count() == 8 and len(calls) == 2


def test_parallel_lines_are_never_paired(spark):
    rows = [(1, i, 0, y, 50, y) for i, y in enumerate(range(0, 40, 4))] + [(1, 90, 25, -5, 25, 60), (1, 91, 0, -1, 50, 49), (1, 92, 0, 49, 50, -1)]
    lines = spark.createDataFrame(rows, "k long, id long, x1 long, y1 long, x2 long, y2 long")
    hits = crossings(lines, ["k"])
    got = {(r["a_id"], r["b_id"]) for r in hits.collect()}
    want = {(i, j) for i in range(10) for j in (90, 91, 92)} | {(90, 91), (90, 92), (91, 92)}
    assert got == want and hits.count() == len(want)
    boxes = [p for p in hits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "NOT (" in p and "sx1" in p]
    assert boxes, "lines along an axis are listed on one side only"


def test_small_groups_of_leaves_take_the_loop_and_no_rounds(spark, monkeypatch):
    """Also equal rows and nulls; turned leaves and two leaves of one id are left open, and go to the rounds with large groups."""
    dice = random.Random(11)
    rows, turned = [], [("t", i, 60 * i + 50, 0, 60 * i, 5 + i) for i in range(2)] + [("u", 1, 0, 0, 50, 5), ("u", 1, 0, 1, 51, 5)]
    for k in ("a", "b", "c"):
        for i in range(60):
            x, y, long = dice.randrange(600), dice.randrange(600), dice.choice((50, 60))
            rows.append((k, i * 7 % 61, x, y, x + long, y + 5) if dice.random() < 0.5 else (k, i * 7 % 61, x, y, x + 5, y + long))
    want = [(k, *door) for k in "abc" for door in sliding_doors([(r[1], r[2:]) for r in rows if r[0] == k], 10)]
    odd = [("a", 100, None, 1, 2, 3), ("a", None, 1, 1, 51, 5), (None, 1, 1, 1, 51, 5)]
    leaves = spark.createDataFrame(rows + rows[:60] + odd, "k string, id long, x1 long, y1 long, x2 long, y2 long")
    whole = leaves.dropna("any")
    monkeypatch.setattr(doors, "_slide_rounds", lambda own, *_: own)
    got = sorted(map(tuple, doors.slide_door_merge(leaves, ["k"]).collect()))
    assert got == sorted(want + [w for w in want if w[0] == "a"]) and len(want) > 9
    more = whole.unionByName(spark.createDataFrame(turned, leaves.schema))
    assert sorted(tuple(r)[:-1] for r in local.settled_doors(more, ["k"], 10).where("open").collect()) == turned
    small, large = local.by_size(whole, ["k"], limit=60)
    assert {r["k"] for r in large.collect()} == {"a"} and small.where("k = 'a'").isEmpty()


def test_small_groups_of_sets_are_settled_without_joins(spark):
    """Also equal rows, equal sets of other sizes, empty sets, nulls and different sets of one id."""
    dice = random.Random(12)
    spot = lambda k: {"x": float(k % 3), "y": float(k // 3)}
    rows = [(g, i, [spot(k) for k in sorted(dice.sample(range(9), dice.randrange(0, 6)))], float(dice.randrange(3))) for g in ("a", "b", "c") for i in range(40)]
    odd = [(None, 1, [spot(1)], 1.0), (None, 2, [spot(1), spot(2)], 1.0), ("n", 1, None, 1.0), ("n", 2, [spot(1)], None), ("n", 3, [spot(1)], 1.0)]
    clash = [("d", 1, [spot(1)], 1.0), ("d", 1, [spot(2)], 1.0), ("d", 2, [spot(1), spot(2)], 1.0)]
    sets = spark.createDataFrame(rows + rows[:20] + odd + clash, "k string, id long, spots array<struct<x:double,y:double>>, size double")
    name = lambda df: sorted(((r["k"] or "", r["id"]) for r in df.collect()))
    settled = local.settled_sets(sets, ["k"])
    assert {r["k"] for r in settled.where("open").collect()} == {None, "n", "d"}
    want = name(cycles._drop_by_joins(sets, ["k"]))
    assert name(settled.where("NOT open")) == [w for w in want if w[0] in ("a", "b", "c")] and 10 < len(want) < 100
    # every comparison in a block of its own
    owner, code = [0, 0, 1, 1, 1, 2, 3], [0, 1, 0, 1, 2, 2, 2]
    for step in (1, 100):
        gone = local.covered_sets(*map(np.array, (owner, code, [1.0, 1.0, 1.0, 2.0])), 4, step)
        assert gone.tolist() == [True, False, True, True]


def test_few_links_take_no_rounds_and_many_do(spark, monkeypatch):
    """Rows of structs, nulls and a link to itself; the same components by one chunk and by rounds."""
    dice = random.Random(13)
    ends = [(dice.randrange(400), dice.randrange(400)) for _ in range(300)] + [(7, 7), (None, 3)]
    row = lambda c: F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("id"))
    links = spark.createDataFrame(ends, "a long, b long").select(row("a").alias("a"), row("b").alias("b"))
    nodes = spark.range(400).select(row("id").alias("id"))
    marks = []
    monkeypatch.setattr(rounds, "_fingerprint", lambda e, f=rounds._fingerprint: marks.append(1) or f(e))
    found = lambda: {r["id"]["id"]: r["comp"]["id"] for r in rounds.components(nodes, links, []).collect()}
    few = found()
    assert not marks and len(set(few.values())) > 50
    monkeypatch.setattr(rounds, "CHUNK", 1)
    assert found() == few and marks
