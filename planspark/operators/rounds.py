"""Iterative operators as join rounds: components, greedy selection, pointer jumping.

Each round is a fixed number of joins and aggregations; the state is written
to the checkpoint folder after it, so plans stay short and a lost executor
costs one round at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.operators.local import CHUNK, closed_cycles, forest, plain
from planspark.operators.planar import dropped_small, least_small
from planspark.session import cut, shuffled


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def components(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], id: str = "id", name: str = "comp"
) -> DataFrame:
    """Label every node with the smallest id of its connected component.

    ``edges`` has the columns ``keys``, ``a``, ``b`` (either order). The rounds
    alternate two contractions towards the smallest neighbour until the edges
    form stars; the number of rounds grows with the logarithm of the size, not
    with the diameter. Neighbour minima are partial aggregates, so a hub does
    not gather its edges in one place. Before the rounds, chunks of edges are
    replaced by fewer that link the same nodes: as they come, and once more
    laid out in ranges of (keys, id). If no more are left then than a chunk
    holds, that chunk settles them, and no rounds follow. Groups with few
    links are settled by tasks before all that.
    """
    keys = list(keys)
    given = edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    if not keys or not all(plain(f.dataType) for f in given.schema):
        return _labelled(nodes, _least_by_rounds(given, keys), keys, id, name)
    least, large = least_small(given.dropna("any"), keys)
    if large is not None:
        least = least.unionByName(_least_by_rounds(large, keys))
    return _labelled(nodes, least, keys, id, name)


def _least_by_rounds(given: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``u``, ``m``): the smallest node linked with ``u``, by chunks and rounds."""
    ordered = (F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    fewer = cut(forest(given, keys).select(*keys, *ordered))
    if all(plain(f.dataType) for f in fewer.schema) and fewer.limit(CHUNK).count() < CHUNK:
        # one chunk: every node of a component is linked to the same one
        stars = cut(forest(fewer.coalesce(1), keys))
        low = stars.groupBy(*keys, "v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        ends = stars.join(shuffled(low), [*keys, "v"]).select(*keys, "u", "m").unionByName(low.select(*keys, F.col("v").alias("u"), "m"))
        return ends.where("u <> m")
    laid = fewer.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v")
    e = cut(forest(laid, keys).select(*keys, *ordered).distinct())
    seen = _fingerprint(e)
    while seen[0]:
        # every larger neighbour of a node points to the node's smallest neighbour
        both = e.select(*keys, "u", "v").union(e.select(*keys, F.col("v"), F.col("u")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u")
            .join(shuffled(low), [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # every smaller neighbour, and the node, points to the smallest of them
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(shuffled(low), [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select(*keys, "u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    return e.select(*keys, "u", F.col("v").alias("m"))


def _labelled(nodes: DataFrame, least: DataFrame, keys: list[str], id: str, name: str) -> DataFrame:
    """``nodes`` with ``name``: the ``m`` of ``least`` (keys, ``u``, ``m``), or their own id."""
    roots = least.select(*keys, F.col("u").alias(id), F.col("m").alias(name))
    return nodes.join(shuffled(roots), [*keys, id], "left").withColumn(
        name, F.coalesce(F.col(name), F.col(id))
    )


def greedy_dropped(conflicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows a "keep first, drop later conflicting ones" pass would drop.

    ``conflicts`` has ``keys``, ``win``, ``lose``: ``win`` comes before ``lose``
    in priority and both cannot be kept. A row that never loses to an
    undecided row is kept, which drops its losers; rounds repeat on the edges
    left between undecided rows. Groups with few conflicts are settled by
    tasks. Returns ``keys`` and ``lose``.
    """
    keys = list(keys)
    if not keys or not all(plain(conflicts.schema[c].dataType) for c in (*keys, "win", "lose")) or conflicts.schema["win"].dataType != conflicts.schema["lose"].dataType:
        return _dropped_by_rounds(conflicts, keys)
    small, large = dropped_small(conflicts, keys)
    return small if large is None else small.unionByName(_dropped_by_rounds(large, keys))


def _dropped_by_rounds(conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """``greedy_dropped`` by rounds alone."""
    open_edges = cut(conflicts.select(*keys, "win", "lose").distinct())
    dropped: list[DataFrame] = []
    while not open_edges.isEmpty():
        losers = open_edges.select(*keys, F.col("lose").alias("win")).distinct()
        out = cut(
            open_edges.join(shuffled(losers), [*keys, "win"], "left_anti").select(*keys, "lose").distinct()
        )
        dropped.append(out)
        open_edges = cut(
            open_edges.join(shuffled(out), [*keys, "lose"], "left_anti").join(
                shuffled(out.withColumnRenamed("lose", "win")), [*keys, "win"], "left_anti"
            )
        )
    if not dropped:
        return open_edges.select(*keys, "lose")
    result = dropped[0]
    for part in dropped[1:]:
        result = result.union(part)
    return result


def cycle_labels(links: DataFrame, keys: Sequence[str], place: Sequence[Column] = ()) -> DataFrame:
    """Label the cycles of a permutation and number their members.

    ``links`` has ``keys``, ``id``, ``nxt``, where every id is the ``nxt`` of
    exactly one row. Returns ``keys``, ``id``, ``cycle`` (smallest member) and
    ``pos`` (steps from that member). Cycles that a chunk of rows holds whole
    are labelled there; rows come in chunks of (keys, ``place``), expressions
    that tell near ids from far ones. The others take pointer doubling: after k
    rounds every row knows the minimum of the 2^k rows that follow it.
    """
    keys = list(keys)
    out = [*keys, "id", "cycle", "pos"]
    done = None
    links = links.select(*keys, "id", "nxt")
    if all(plain(f.dataType) for f in links.schema):
        if place:
            at = [f"__place{i}" for i in range(len(place))]
            tiled = links.withColumns(dict(zip(at, place)))
            links = tiled.repartition(*keys, *at).sortWithinPartitions(*keys, *at)
        rows = cut(closed_cycles(links, keys))
        done, links = rows.where("pos IS NOT NULL").select(*out), rows.where("pos IS NULL")
        if links.isEmpty():
            return done
    rest = _doubled(links, keys).select(*out)
    return rest if done is None else done.unionByName(rest)


def _doubled(links: DataFrame, keys: list[str]) -> DataFrame:
    """``cycle_labels`` by pointer doubling alone."""
    state = cut(
        links.select(
            *keys, "id", "nxt", F.col("id").alias("low"), F.lit(0).cast("long").alias("steps")
        )
    )
    span = 1
    while True:
        ahead = state.select(
            *keys,
            F.col("id").alias("nxt"),
            F.col("nxt").alias("nxt2"),
            F.col("low").alias("low2"),
            F.col("steps").alias("steps2"),
        )
        better = F.col("low2") < F.col("low")
        state = cut(
            state.join(shuffled(ahead), [*keys, "nxt"]).select(
                *keys,
                "id",
                F.col("nxt2").alias("nxt"),
                F.when(better, F.col("low2")).otherwise(F.col("low")).alias("low"),
                F.when(better, F.col("steps2") + span).otherwise(F.col("steps")).alias("steps"),
                better.alias("moved"),
            )
        )
        moved = not state.where("moved").isEmpty()
        state = state.drop("moved")
        span *= 2
        if not moved:
            break
    size = state.groupBy(*keys, F.col("low").alias("cycle")).agg(F.count(F.lit(1)).alias("size"))
    return (
        state.select(*keys, "id", F.col("low").alias("cycle"), "steps")
        .join(shuffled(size), [*keys, "cycle"])
        .select(
            *keys,
            "id",
            "cycle",
            F.when(F.col("steps") == 0, F.lit(0))
            .otherwise(F.col("size") - F.col("steps"))
            .cast("long")
            .alias("pos"),
        )
    )
