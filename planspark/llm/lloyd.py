"""Centroid clustering by dimension-sharded Lloyd rounds (operator 13).

Vectors are cut into column blocks of ``BLOCK`` components; a shard row holds
one block of one vector. In each round, tasks over the shards compute exact
integer partial distances to the centroid slices of their block, a reduce by
vector adds the blocks and takes the nearest centroid, and the assignment goes
back to the shards, where each block sums its own slice of the centroids.
Only these sums (centroids x dimensions numbers, whatever the input) reach the
driver, and the new slices travel with the next round's tasks. Every round
starts from the stored shards, so plans stay short and a lost executor costs
the tasks it ran.

Components are ``floor(scale * x)`` in double precision, everything after that
is integer arithmetic; a sum or a distance beyond 64 bits is an error.

Cases: vectors that are null, of another length, or with a null or non-finite
component are left out; ties of distance go to the smaller centroid, ties of
the seeding hash to the smaller vector; repeated rows are vectors of their
own; a null id is hashed as an empty text; a centroid without vectors stays;
with fewer vectors than centroids each vector seeds one; an empty table gives
an empty result; extra columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.llm.common import sha256_hex
from planspark.session import cut, discard, stored

BLOCK = 16


def whole_components(vector: Column, size: int, scale: float) -> Column:
    """``floor(scale * x)`` of each component; null where the vector does not qualify."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return F.when((F.size(vector) == size) & finite, floors)


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The components of the ``k`` vectors with the smallest hashes of ``seed:id``, in the order of the hashes."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.select(sha256_hex(key).alias("h"), "comps").orderBy("h", "comps").limit(k).collect()
    return np.array([r["comps"] for r in first], dtype=np.int64)


def shards_of(vectors: DataFrame, size: int, block: int) -> DataFrame:
    """``vkey``, ``block`` and the ``slice`` of components of each column block."""
    starts = F.array(*[F.lit(s) for s in range(0, size, block)])
    return vectors.select(
        "vkey", F.posexplode(F.transform(starts, lambda s: F.slice("comps", s + 1, F.lit(block)))).alias("block", "slice")
    )


def _slices(column) -> list[np.ndarray]:
    """The rows of a list column as views of one buffer."""
    values, ends = np.asarray(column.flatten()), np.asarray(column.offsets)
    return values, ends - ends[0]


def _by_block(batch, block: int):
    """(block, row numbers, matrix of components) for each column block that the batch holds."""
    blocks = np.asarray(batch.column("block"))
    values, ends = _slices(batch.column("slice"))
    for b in np.unique(blocks):
        rows = np.flatnonzero(blocks == b)
        width = int(ends[rows[0] + 1] - ends[rows[0]])
        yield int(b), rows, values[ends[rows][:, None] + np.arange(width)[None, :]]


def distances(shards: DataFrame, centroids: np.ndarray, block: int) -> DataFrame:
    """``vkey``, ``cluster`` and ``distance`` of every vector: partial distances by block, added up by vector."""
    import pyarrow as pa

    k = len(centroids)
    names = [f"d{c}" for c in range(k)]

    def partial(batches: Iterator):
        for batch in batches:
            out = np.zeros((k, batch.num_rows), dtype=np.int64)
            for b, rows, x in _by_block(batch, block):
                own = centroids[:, b * block : b * block + x.shape[1]]
                for c in range(k):
                    gap = x - own[c]
                    out[c, rows] = np.einsum("ij,ij->i", gap, gap)
            yield pa.RecordBatch.from_arrays([batch.column("vkey"), *map(pa.array, out)], names=["vkey", *names])

    parts = shards.mapInArrow(partial, "vkey long, " + ", ".join(f"{n} long" for n in names))
    whole = parts.groupBy("vkey").agg(*[F.sum(n).alias(n) for n in names])
    nearest = F.array_min(F.array(*[F.struct(F.col(n).alias("distance"), F.lit(c).alias("cluster")) for c, n in enumerate(names)]))
    return whole.select("vkey", nearest.alias("near")).select("vkey", "near.cluster", "near.distance")


def moved(shards: DataFrame, assigned: DataFrame, centroids: np.ndarray, block: int) -> np.ndarray:
    """The next centroids: each block's tasks sum the slices of their vectors by cluster."""
    import pyarrow as pa

    k, size = centroids.shape
    blocks = -(-size // block)

    def sums(batches: Iterator):
        total = np.zeros((blocks, k, block), dtype=np.int64)
        count = np.zeros((blocks, k), dtype=np.int64)
        for batch in batches:
            cluster = np.asarray(batch.column("cluster"))
            for b, rows, x in _by_block(batch, block):
                np.add.at(total[b], (cluster[rows], slice(0, x.shape[1])), x)
                count[b] += np.bincount(cluster[rows], minlength=k)
        b, c = np.nonzero(count)
        at = [np.repeat(v, block) for v in (b, c)] + [np.tile(np.arange(block), len(b))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v.astype(np.int64)) for v in (*at, total[b, c].reshape(-1), np.repeat(count[b, c], block))],
            names=["block", "cluster", "at", "total", "n"],
        )

    joined = shards.join(assigned.select("vkey", "cluster"), "vkey")
    rows = (
        joined.mapInArrow(sums, "block long, cluster long, at long, total long, n long")
        .groupBy("block", "cluster", "at")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        .collect()
    )
    out = centroids.copy()
    for r in rows:
        if r["block"] * block + r["at"] < size:
            out[r["cluster"], r["block"] * block + r["at"]] = r["total"] // r["n"]
    return out


def cluster(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    size: int = 64,
    scale: float = 1024,
    seed: int = 3,
    block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``cluster`` and ``distance`` of every qualifying vector, and the final centroids (k x size)."""
    comps = whole_components(F.col(vector), size, scale)
    kept = rows.select(F.col(id).alias("vec_id"), comps.alias("comps")).where("comps is not null")
    # numbered in the table that is written, so the numbers are the same on every later read
    vectors = stored(kept.withColumn("vkey", F.monotonically_increasing_id()))
    centroids = seeds(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    shards = stored(shards_of(vectors, size, block))
    for _ in range(rounds):
        centroids = moved(shards, distances(shards, centroids, block), centroids, block)
    assigned = distances(shards, centroids, block)
    result = cut(vectors.select("vkey", "vec_id").join(assigned, "vkey").drop("vkey"))
    discard(shards)
    discard(vectors)
    return result, centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    """The sha256 of each centroid's components, as decimal numbers joined by commas."""
    from hashlib import sha256

    return [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the distance sums of each row's cluster and of all, and the digest of its centroid.

    The sums are one row per centroid and travel to the rows as such.
    """
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}

    def pick(values: dict, kind: str) -> Column:
        if not values:
            return F.lit(None).cast(kind)
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("cluster")].cast(kind)

    return (
        assigned.withColumn("cluster_inertia", pick(sums, "long"))
        .withColumn("inertia", F.lit(sum(sums.values())).cast("long"))
        .withColumn("centroid_sha256", pick(dict(enumerate(centroid_digests(centroids))), "string"))
    )
