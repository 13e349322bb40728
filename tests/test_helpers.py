"""Ordering, rounds and spatial joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from planspark.operators import ordering as O
from planspark.operators import rounds as R
from planspark.operators.spatial import box_pairs


@pytest.mark.parametrize("large", [False, True])
def test_ranked_is_the_same_for_large_groups(spark, large):
    rows = [(i % 2 if i % 3 else 0, (i * 37) % 11, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v int, id int")
    got = {(r.k, r.id): r.rn for r in O.ranked(df, ["k"], [F.col("v"), F.col("id")], bounded=not large).collect()}
    for k in (0, 1):
        order = sorted((v, i) for g, v, i in rows if g == k)
        assert [got[k, i] for _, i in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("large", [False, True])
def test_islands(spark, large):
    rng = random.Random(3)
    rows = [(g, a, a + rng.randrange(1, 5)) for g in range(2) for a in (rng.randrange(300) for _ in range(80))]
    out = O.islands(spark.createDataFrame(rows, "g int, lo int, hi int"), ["g"], "lo", "hi", bounded=not large)
    got = {(r.g, r.lo, r.hi) for r in out.groupBy("g", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    want = set()
    for g in range(2):
        runs = []
        for a, b in sorted((a, b) for k, a, b in rows if k == g):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        want |= {(g, a, b) for a, b in runs}
    assert got == want


@pytest.mark.parametrize("large", [False, True])
def test_carried_header(spark, large):
    rows = [(0, i, f"h{i}" if i % 7 == 3 else None) for i in range(60)]
    out = O.carried_header(spark.createDataFrame(rows, "g int, pos int, h string"), ["g"], [F.col("pos")], F.col("h"), "section", not large)
    last = None
    for r in sorted(out.collect(), key=lambda r: r.pos):
        last = r.h or last
        assert r.section == last


def test_components_and_cycles(spark):
    rng = random.Random(5)
    edges = [(0, i, i + 1) for i in range(40)] + [(0, 100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)]
    nodes = spark.createDataFrame([(0, i) for i in list(range(41)) + list(range(100, 130))], "g int, id int")
    got = {r.id: r.comp for r in R.components(nodes, spark.createDataFrame(edges, "g int, a int, b int"), ["g"]).collect()}
    label = {i: i for i in got}
    for _ in range(80):
        for _, a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label
    perm = list(range(50))
    rng.shuffle(perm)
    links = spark.createDataFrame([(0, i, p) for i, p in enumerate(perm)], "g int, id int, nxt int")
    out = {r.id: (r.cycle, r.pos) for r in R.cycle_labels(links, ["g"]).collect()}
    for i in range(50):
        walk = [i]
        while perm[walk[-1]] != i:
            walk.append(perm[walk[-1]])
        start = min(walk)
        assert out[i] == (start, (len(walk) - walk.index(start)) % len(walk))


def test_greedy_selection(spark):
    rng = random.Random(9)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)})
    lost = {r.lose for r in R.greedy_dropped(spark.createDataFrame([(0, a, b) for a, b in pairs], "g int, win int, lose int"), ["g"]).collect()}
    kept = []
    for i in range(60):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    assert lost == set(range(60)) - set(kept)


def test_box_pairs_finds_each_pair_once(spark):
    rng = random.Random(1)
    rows = [(0, i, rng.randrange(-90, 90), rng.randrange(-90, 90)) for i in range(60)]
    rows = [(g, i, x, y, x + rng.randrange(40), y + rng.randrange(40)) for g, i, x, y in rows]
    df = spark.createDataFrame(rows, "g int, id int, x1 int, y1 int, x2 int, y2 int")
    got = sorted((r.a_id, r.b_id) for r in box_pairs(df, df, ["g"], 16, 5, F.col("a_id") < F.col("b_id")).collect())
    near = lambda a, b: all(max(a[k], b[k]) - min(a[k + 2], b[k + 2]) <= 5 for k in (2, 3))
    assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and near(a, b))
