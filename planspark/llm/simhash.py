"""SimHash near-duplicates with bit-sliced comparison (operator 8).

Every text becomes a 64-bit fingerprint of its word shingles. Two fingerprints
within ``RADIUS`` = 2 bits agree in at least two of four 16-bit pieces, so each
distinct fingerprint goes to the six buckets of its piece pairs; buckets of
one are dropped. A large bucket is split into blocks of ``BLOCK`` members and
each pair of blocks is a cell of its own, so no task gathers a whole bucket.

Within a cell the members stand in words of 64 lanes, stored as 64 bit planes.
For every (query, word) pair the planes are added bit by bit into carry-save
counters that saturate above the radius; pairs whose 64 lanes have all
exceeded it are abandoned. Cells return a spanning set of links, one per
member at most, and components are labelled by rounds of joins.

Cases: a null or empty text has no words and the fingerprint zero, which is
linked like any other; fewer than three words form one shingle; repeated
shingles count each time; repeated rows keep one result each; a component
without any id has a null component id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.llm.components import components
from planspark.session import cut

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCK = 4096
PIECES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
#: (query, word) pairs compared at a time.
STEP = 1 << 15
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Word shingles of the text, A-Z lower-cased, split at ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[k:] for k in range(size)])))


def fingerprint(parts: list[bytes]) -> int:
    """Bit by bit, 1 where more than half of the hashes have a 1; as a signed number."""
    from xxhash import xxh64_intdigest

    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(parts), 1 << 14):
        some = parts[start : start + (1 << 14)]
        hashes = np.fromiter((xxh64_intdigest(p, SEED) for p in some), dtype="<u8", count=len(some))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits(ones * 2 > len(parts), bitorder="little")
    return int(over.view("<i8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp`` (long) of every row."""
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    out = StructType([StructField("doc_id", docs.schema[id].dataType), StructField("fp", LongType())])

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingles(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id).alias("doc_id"), text).mapInArrow(run, out)


def compare(query: np.ndarray, word: np.ndarray, planes: np.ndarray, fps: np.ndarray, lanes: np.ndarray, radius: int = RADIUS):
    """The lanes of ``word`` within ``radius`` bits of each query; yields (query, word, lanes).

    ``planes`` is (64, words); ``lanes`` marks the lanes in use. Only counts up
    to 3 are needed, so two counter planes and a sticky overflow suffice.
    """
    if radius != 2:
        raise ValueError("the counters are made for a radius of 2")
    one = np.zeros(len(query), dtype=np.uint64)
    two = np.zeros_like(one)
    dead = ~lanes[word]
    values = fps[query]
    for bit in range(64):
        wanted = np.where((values >> np.uint64(bit)) & np.uint64(1), ALL, np.uint64(0))
        differ = planes[bit][word] ^ wanted
        carry = one & differ
        one ^= differ
        two |= carry
        dead |= one & two
        if bit % 8 == 7:
            open_ = dead != ALL
            if not open_.all():
                query, word, one, two, dead, values = (a[open_] for a in (query, word, one, two, dead, values))
                if not len(query):
                    break
    return query, word, ~dead


def link_cells(cell: np.ndarray, side: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within each cell; rows come sorted by cell and side.

    Side 0 and side 1 of a cell are compared with each other; a cell with one
    side only is compared with itself.
    """
    n = len(fps)
    if not n:
        return fps, fps
    start = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])])
    size = np.diff(np.r_[start, n])
    # lanes: each (cell, side) group fills words of its own
    group = np.repeat(np.arange(len(start)), size)
    words_of = (size + 63) // 64
    first_word = np.r_[0, np.cumsum(words_of)][:-1]
    at = np.arange(n) - start[group]
    word, lane = first_word[group] + at // 64, (at % 64).astype(np.uint64)
    total = int(words_of.sum())
    member = np.full((total, 64), -1, dtype=np.int64)
    member[word, lane.astype(np.int64)] = np.arange(n)
    planes = np.zeros((64, total), dtype=np.uint64)
    for bit in range(64):
        np.bitwise_or.at(planes[bit], word, ((fps >> np.uint64(bit)) & np.uint64(1)) << lane)
    lanes = np.zeros(total, dtype=np.uint64)
    np.bitwise_or.at(lanes, word, np.uint64(1) << lane)

    # the group that a group's members are compared with: itself, or the other side after it
    target = np.arange(len(start))
    pair = (cell[start[:-1]] == cell[start[1:]]) & (side[start[:-1]] != side[start[1:]])
    target[:-1][pair] += 1
    asks = np.ones(len(start), dtype=bool)
    asks[1:][pair] = False
    parent = np.arange(n)
    todo = np.flatnonzero(asks[group])
    spread = words_of[target[group[todo]]]
    ends = np.cumsum(spread)
    done = 0
    while done < len(todo):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + STEP, side="right")))
        rows, k = todo[done:upto], spread[done:upto]
        query = np.repeat(rows, k)
        offset = np.arange(len(query)) - np.repeat(np.cumsum(k) - k, k)
        q, w, hit = compare(query, first_word[target[group[query]]] + offset, planes, fps, lanes)
        if len(q):
            bits = np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(bits)
            join(parent, q[r], member[w[r], c])
        done = upto
    root = roots(parent)
    moved = root != np.arange(n)
    return fps[moved], fps[root[moved]]


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return up
        parent[:] = up


def join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the links a-b, all at once: hook larger roots on smaller ones until none differ."""
    while True:
        ra, rb = roots(parent)[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def cells(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``cell``, ``side``, ``fp``: the buckets with company, large ones cut into pairs of blocks."""

    def piece(k: int) -> Column:
        return F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))

    keys = F.array(
        *[F.struct(F.lit(s).alias("slot"), (piece(a) * 65536 + piece(b)).alias("key")) for s, (a, b) in enumerate(PIECES)]
    )
    spread = fps.select("fp", F.explode(keys).alias("k")).select("fp", (F.col("k.slot") * (1 << 32) + F.col("k.key")).alias("key"))
    counts = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    return (
        spread.join(counts, "key")
        .withColumn("blocks", F.ceil(F.col("n") / block))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
            "key",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "fp",
        )
    )


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Spanning links (``a``, ``b``) between distinct fingerprints within the radius."""
    import pyarrow as pa

    def run(batches: Iterator):
        held = None

        def solve(rows: np.ndarray):
            order = np.flatnonzero(
                np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]) | (rows[1:, 2] != rows[:-1, 2])]
            )
            ids = np.repeat(np.arange(len(order)), np.diff(np.r_[order, len(rows)]))
            a, b = link_cells(ids, rows[:, 3], np.ascontiguousarray(rows[:, 4]).view(np.uint64))
            return pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64), pa.int64()) for x in (a, b)], names=["a", "b"]
            )

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(5)], axis=1)
            if held is not None:
                rows = np.concatenate([held, rows])
            # all but the last cell are complete; a cell has at most about two blocks of rows
            last = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1)).max(initial=-1)) + 1
            held = rows[last:]
            if last:
                yield solve(rows[:last])
        if held is not None and len(held):
            yield solve(held)

    laid = (
        cells(fps, block)
        .repartition("cell")
        .sortWithinPartitions("key", "low", "high", "side", "fp")
        .select("key", "low", "high", "side", "fp")
    )
    return laid.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (smallest id of the component) of every row."""
    prints = cut(fingerprints(docs, id, text))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labelled = cut(components(distinct, links(distinct.select("fp")), id="fp", name="comp"))
    lowest = labelled.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_print = labelled.join(lowest, "comp").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
