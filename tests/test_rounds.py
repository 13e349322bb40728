"""Operators in rounds against plain loops: sliding doors, strong components, symbols in a model."""

import itertools
import random

from pyspark.sql import functions as F

from planspark.operators import doors as D
from planspark.operators import legend as L


def sliding_doors(leaves, gap):
    """The loop: leaves lead in id order and take the first free near one until none is left."""
    boxes, free, out = dict(leaves), {i for i, _ in leaves}, []
    for lead in sorted(boxes):
        if lead not in free:
            continue
        door, alone = boxes[lead], True
        while True:
            near = [
                i for i in sorted(free) if i > lead
                and max(door[0], boxes[i][0]) - min(door[2], boxes[i][2]) <= gap and max(door[1], boxes[i][1]) - min(door[3], boxes[i][3]) <= gap
                and not (door[0] == boxes[i][0] and door[2] == boxes[i][2]) and not (door[1] == boxes[i][1] and door[3] == boxes[i][3])
            ]
            if not near:
                break
            b = boxes[near[0]]
            door, alone = (min(door[0], b[0]), min(door[1], b[1]), max(door[2], b[2]), max(door[3], b[3])), False
            free.remove(near[0])
        free.remove(lead)
        if not alone:
            out.append((lead, *door))
    return out


def test_sliding_doors_equal_the_loop(spark):
    dice = random.Random(4)
    rows = []
    for dwg, size, n in ((1, 300, 250), (2, 3000, 400), (3, 60, 30), (4, 10, 1)):
        for i in range(n):
            x, y, long, thin = dice.randrange(size), dice.randrange(size), dice.choice((50, 60, 60)), dice.choice((4, 5))
            rows.append((dwg, i * 7 % 1009, x, y, x + long, y + thin) if dice.random() < 0.6 else (dwg, i * 7 % 1009, x, y, x + thin, y + long))
    got = D.slide_door_merge(spark.createDataFrame(rows, "dwg_id long, id long, x1 long, y1 long, x2 long, y2 long"), ["dwg_id"])
    want = [(d, *door) for d in (1, 2, 3, 4) for door in sliding_doors([(r[1], r[2:]) for r in rows if r[0] == d], 10)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30


def test_strong_components(spark):
    dice = random.Random(5)
    ring = [(k, (k + 1) % 3) for k in range(3)]
    eight = [(10, 11), (11, 12), (12, 10), (12, 13), (13, 14), (14, 12)]
    chain = [(k, k + 1) for k in range(20, 30)]
    joined = [(40, 41), (41, 40), (41, 42), (42, 43), (43, 42), (44, 44)]
    loose = [(50 + dice.randrange(30), 50 + dice.randrange(30)) for _ in range(45)]
    edges = ring + eight + chain + joined + loose
    reach = {n: {n} for n in range(100)}
    while any(not reach[a] >= reach[b] for a, b in edges):
        for a, b in edges:
            reach[a] |= reach[b]
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
    nodes = spark.range(100).select(F.lit(1).alias("dwg_id"), "id")
    near = spark.createDataFrame([(1, a, b) for a, b in edges], "dwg_id int, src long, dst long")
    got = {r["id"]: r["comp"] for r in L.strong_components(nodes, near, ["dwg_id"]).collect()}
    assert got == want and got[2] == 0 and got[14] == 10 and got[25] == 25
    assert {r["comp"] for r in L.strong_components(nodes, near.limit(0), ["dwg_id"]).collect()} == set(range(100))


def spun(w, turn):
    return w if w == 8 else w - w % 10 + (w % 10 + 2 * turn) % 8


def test_symbols_in_a_model(spark):
    """All node sets whose induced graph is a template's in one of its rotations, by trying all of them."""
    dice = random.Random(6)
    kinds = {i: dice.choice("ab") for i in range(14)}
    edges = {}
    for a, b in itertools.combinations(range(14), 2):
        if dice.random() < 0.35:
            w = dice.choice((0, 2, 8, 11))
            edges[a, b], edges[b, a] = w, w if w == 8 else (w % 10 + 4) % 8 + w - w % 10
    def cut_out(size, first):
        """A connected part of the model under other ids."""
        part = [0]
        while len(part) < size:
            part.append(next(j for i in part for j in range(14) if (i, j) in edges and j not in part))
        name = {i: first + k for k, i in enumerate(part)}
        return {name[i]: kinds[i] for i in part}, {(name[i], name[j]): w for (i, j), w in edges.items() if i in name and j in name}

    templates = {
        1: ({0: "a"}, {}),
        2: ({0: "a", 1: "b"}, {(0, 1): 2, (1, 0): 6}),
        3: cut_out(3, 30),
        4: cut_out(4, 40),
        5: ({1: "a", 2: "a"}, {}),
    }
    want = set()
    for t, (nodes, own) in templates.items():
        if t == 5:  # falls apart: no symbol
            continue
        ids = list(nodes)
        for turn, found in itertools.product(range(4), itertools.permutations(kinds, len(ids))):
            at = dict(zip(ids, found))
            if all(kinds[at[i]] == nodes[i] for i in ids) and all(
                edges.get((at[i], at[j])) == (None if (i, j) not in own else spun(own[i, j], turn)) for i, j in itertools.permutations(ids, 2)
            ):
                want.add((t, tuple(sorted(found))))
    model = spark.createDataFrame([(1, i, k) for i, k in kinds.items()] + [(2, 0, "a")], "dwg_id long, id long, ntype string")
    near = spark.createDataFrame([(1, a, b, w) for (a, b), w in edges.items()], "dwg_id long, src long, dst long, weight long")
    members = spark.createDataFrame([(1, t, i, k) for t, (n, _) in templates.items() for i, k in n.items()], "dwg_id long, tpl long, id long, ntype string")
    own = spark.createDataFrame([(1, t, a, b, w) for t, (_, e) in templates.items() for (a, b), w in e.items()], "dwg_id long, tpl long, src long, dst long, weight long")
    turns = members.select("dwg_id", "tpl").distinct().withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(3))))
    got = {(r["tpl"], tuple(r["members"])) for r in L.match_templates(model, near, members, own, ["dwg_id"], turns).collect()}
    assert got == want and {t for t, _ in got} >= {1, 3, 4}
