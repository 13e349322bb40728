"""Centroid clustering against plain Lloyd rounds."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from planspark.llm import lloyd


def plain(rows, k, rounds, size, scale, seed):
    kept = [
        (v, [math.floor(scale * x) for x in e])
        for v, e in rows
        if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)
    ]
    if not kept:
        return [], []
    order = sorted(kept, key=lambda r: (sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(e) for _, e in order[:k]]

    def nearest(e):
        return min((sum((x - c) ** 2 for x, c in zip(e, own)), n) for n, own in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(e)[1] for _, e in kept]
        for n in range(len(centroids)):
            own = [e for (_, e), m in zip(kept, of) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    return [(v, nearest(e)[1], nearest(e)[0]) for v, e in kept], centroids


@pytest.mark.parametrize(("size", "block"), [(5, 2), (8, 16), (8, 4)])
def test_equals_plain_rounds(spark, size, block):
    dice = random.Random(size * block)
    rows = [(k, [dice.gauss(3 * (k % 4), 1) for _ in range(size)]) for k in range(90)]
    rows += [(k, [0.5] * size) for k in range(90, 130)] + [(7, [0.5] * size), (7, [0.5] * size), (None, [-2.0] * size)]
    rows += [(200, None), (201, []), (202, [1.0] * (size + 1)), (203, [None] + [1.0] * (size - 1))]
    rows += [(204, [float("nan")] * size), (205, [float("-inf")] + [0.0] * (size - 1))]
    schema = "vec_id long, embedding array<double>, cluster string, distance string, vkey long, comps string, block int"
    table = spark.createDataFrame([(*r, "c", "d", 5, "x", 1) for r in rows], schema)
    got, centroids = lloyd.cluster(table, k=6, rounds=4, size=size, scale=16, block=block)
    want, means = plain(rows, 6, 4, size, 16, 3)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert centroids.tolist() == means
    full = lloyd.with_inertia(got, centroids).collect()
    assert {r["inertia"] for r in full} == {sum(d for *_, d in want)}
    for r in full:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == sha256(",".join(map(str, means[r["cluster"]])).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.5, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, centroids = lloyd.cluster(table, size=2)
    want, means = plain(rows, 8, 10, 2, 1024, 3)
    assert sorted(map(tuple, got.collect())) == sorted(want) and centroids.tolist() == means
    none, centroids = lloyd.cluster(table.limit(0), size=2)
    assert none.count() == 0 and not len(centroids)
    assert lloyd.with_inertia(none, centroids).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_centroids_stay_where_no_vector_is(spark):
    rows = [(k, [float(k % 2), 0.0]) for k in range(20)]
    got, centroids = lloyd.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=2)
    want, means = plain(rows, 8, 10, 2, 1024, 3)
    assert sorted(map(tuple, got.collect())) == sorted(want) and centroids.tolist() == means
    assert len(np.unique(centroids, axis=0)) == 2
