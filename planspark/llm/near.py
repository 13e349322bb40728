"""Near copies by the Jaccard similarity of word shingles, for stages without a contract of their own.

Two texts are near copies when the sets of their runs of five words have a
Jaccard similarity of at least 0.8. At 0.8 the simhashes of two texts are
about ten bits apart and often more, which no pieces of 64 bits can select.
Candidates come from ``BANDS`` bands of ``ROWS`` MinHashes instead (a pair at
0.8 meets in one with probability 0.9994, at 0.85 with 0.99999), and every
link is confirmed on the full sets.

Each distinct set of shingles is one node. Nodes that meet in bands, directly
or through others, form a candidate group; a large group is split into blocks
and each pair of blocks is a cell of its own. Texts are read again for nodes
in company only. A cell counts common shingles through an inverted index and
returns a spanning set of the links that hold, so nothing of a group's square
leaves it.

Cases: words and short texts as in ``simhash``; texts with equal sets are
linked, and so are null, empty and blank texts with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planspark.llm.components import components
from planspark.llm.exact_dedup import BITMAP_ROWS, BITS
from planspark.llm.simhash import SEED, join, roots, shingles
from planspark.session import cut

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 40, 8
#: Nodes and shingles of a block, about.
BLOCK, WEIGHT = 512, 1 << 20
#: Shingles hashed at a time.
STEP = 512


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    from xxhash import xxh64_intdigest

    parts = set(shingles(text, size))
    hashes = np.fromiter((xxh64_intdigest(p, SEED) for p in parts), dtype=np.uint64, count=len(parts))
    hashes.sort()
    return hashes


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 1 << 32, size=(2, BANDS * ROWS, 1), dtype=np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def band_keys(hashes: np.ndarray, times: np.ndarray, plus: np.ndarray) -> list[int]:
    """One signed key per band of MinHashes."""
    from xxhash import xxh64_intdigest

    low = np.full(len(times), 0xFFFFFFFF, dtype=np.uint32)
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for start in range(0, len(short), STEP):
        np.minimum(low, (short[start : start + STEP] * times + plus).min(axis=1), out=low)
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def prints(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_key``, ``node`` (digest of the set), ``n`` (its size) and ``bands`` of every row."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    out = StructType(
        [StructField("doc_id", docs.schema[id].dataType)]
        + [StructField(c, LongType()) for c in ("text_key", "node", "n")]
        + [StructField("bands", ArrayType(LongType()))]
    )
    names = [f.name for f in out]

    def run(batches):
        from xxhash import xxh64_intdigest

        times, plus = multipliers()
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(2).to_pylist()]
            nodes = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            bands = pa.array([band_keys(s, times, plus) for s in sets], pa.list_(pa.int64()))
            counts = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), counts, bands], names=names)

    rows = docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, out)


def similar(sets: list[np.ndarray], side: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (positions) between sets whose similarity is ``least`` or more.

    Side 0 is compared with side 1 where both are there, and otherwise with itself.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    asks, asked = np.flatnonzero(side == side[0]), side == side[-1]
    # the asked sets that hold each code, one after the other
    owner = np.repeat(np.arange(n), sizes)
    held = asked[owner]
    order = np.argsort(codes[held], kind="stable")
    holders = owner[held][order]
    first = np.searchsorted(codes[held][order], np.arange(len(values) + 1))
    parent = np.arange(n)
    for i in asks:
        others = asked & (roots(parent) != parent[i]) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]))
        if not others.any():
            continue
        mine = codes[ends[i] - sizes[i] : ends[i]]
        spread = first[mine + 1] - first[mine]
        at = np.arange(int(spread.sum())) + np.repeat(first[mine] - np.cumsum(spread) + spread, spread)
        common = np.bincount(holders[at], minlength=n)
        # common / union >= least, in whole numbers as far as possible
        hits = np.flatnonzero(others & (common >= least * (sizes + sizes[i] - common) - 1e-9))
        if len(hits):
            join(parent, np.full(len(hits), i), hits)
    root = roots(parent)
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def cells(docs: DataFrame, nodes: DataFrame, text: str = "text", block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """``comp``, ``low``, ``high``, ``side``, ``node``, ``text`` of the nodes in company."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b")
    met = keyed.join(heads, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    grouped = cut(components(nodes.select("node", "text_key", "n"), met, id="node", name="comp"))
    sizes = grouped.groupBy("comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight")).where("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("weight") / weight))
    company = cut(grouped.join(sizes.select("comp", blocks.alias("blocks")), "comp"))

    # texts of nodes in company only are shuffled; the others are told apart by a bitmap of fixed size
    bit = F.pmod(F.xxhash64("text_key"), F.lit(BITMAP_ROWS * BITS))
    parts = (F.expr(f"bit div {BITS}").alias("map_row"), F.expr(f"bit % {BITS}").alias("at"))
    bitmap = company.select(bit.alias("bit")).select(*parts).groupBy("map_row").agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    texts = (
        docs.select(F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
        .withColumn("bit", bit)
        .select("text_key", "text", *parts)
        .join(F.broadcast(bitmap), "map_row")
        .where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1)
        .groupBy("text_key")
        .agg(F.any_value("text").alias("text"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    return (
        company.join(texts, "text_key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "comp",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).cast("long").alias("side"),
            "node",
            "text",
        )
    )


def links(laid: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Confirmed links (``a``, ``b``) that span the groups of similar nodes of every cell."""
    import pyarrow as pa

    def run(batches: Iterator):
        key, held = None, []
        a, b = [], []

        def solve():
            if len(held) > 1:
                side = np.array([h[0] for h in held])
                node = np.array([h[1] for h in held], dtype=np.int64)
                x, y = similar([shingle_set(h[2], size) for h in held], side, least)
                a.extend(node[x].tolist())
                b.extend(node[y].tolist())

        for batch in batches:
            for *at, side, node, text in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if at != key:
                    solve()
                    key, held = at, []
                held.append((side, node, text))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])
            a, b = [], []
        solve()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    order = ["comp", "low", "high"]
    placed = laid.repartition(*order).sortWithinPartitions(*order, "side", "node")
    return placed.mapInArrow(run, "a long, b long").distinct()


def near_copies(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = LEAST
) -> DataFrame:
    """``doc_id``, ``text_key``, ``node``, ``component_id`` and ``component_key`` of every row.

    The last two are id and text key of the component's first row: by id, null last, then by text key.
    """
    rows = cut(prints(docs, id, text, size))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    nodes = cut(
        rows.groupBy("node").agg(
            F.min(first).alias("first"), F.min("text_key").alias("text_key"), F.max("n").alias("n"), F.any_value("bands").alias("bands")
        )
    )
    found = links(cells(docs, nodes, text), size, least)
    labelled = cut(components(nodes.select("node", "first"), found, id="node", name="comp"))
    lowest = labelled.groupBy("comp").agg(F.min("first").alias("best"))
    of_node = labelled.join(lowest, "comp").select(
        "node", F.col("best.id").alias("component_id"), F.col("best.key").alias("component_key")
    )
    return rows.join(of_node, "node").select("doc_id", "text_key", "node", "component_id", "component_key")
