"""Benchmark decontamination by word windows (operator 7, native).

Benchmark items become windows of consecutive normalised words. The set of
their hashes goes to every task as a table of ``SLOTS`` slots, of the same
size for every benchmark; each document's windows are scanned against it, in
the row, first by the hash of their leading words and then by that of the
whole window. Only hits leave the row, as window texts, and are confirmed by
an equi-join on the text itself, so a fuller table costs more confirmations
and never a result.

Cases: a null or empty text has no words and no hits; an item shorter than the
window is one window, an item without words none; repeated items count once
by id; hits of null item ids count as hits but name no item; repeated document
rows get the same result; an empty table on either side gives no hits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.llm.common import ascii_lower, in_rows_of
from planspark.llm.lines import text_key_of
from planspark.session import cut

WINDOW = 10
LEAD = 2
#: Slots of the hash set, a byte each: 256 KB in the plan, whatever the benchmark. A hash marks two of them.
SLOTS = 1 << 18
#: Bits of a row that the bitmap aggregate makes.
ROW_BITS = 32_768
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS, -1), "")


def window_hash(ws: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` words from position ``at`` (0-based)."""
    return F.xxhash64(*[F.get(ws, at + k) for k in range(length)])


def window_text(ws: Column, at: Column, length: int | Column) -> Column:
    return F.array_join(F.slice(ws, at + 1, length), " ")


def item_windows(items: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """Distinct ``size``, ``window``, ``item_id`` of the benchmark."""
    ws = items.select(F.col(id).alias("item_id"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(window))
    return (
        ws.withColumn("size", size)
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("size"))))
        .select("size", window_text(F.col("ws"), F.col("at"), F.col("size")).alias("window"), "item_id")
        .distinct()
    )


def places(h: Column, slots: int) -> list[Column]:
    """The two slots of a hash, from its upper and its lower bits."""
    bits = slots.bit_length() - 1
    return [F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND(F.lit(slots - 1))]


def hash_set(known: DataFrame, most: int, slots: int) -> bytearray:
    """A byte per slot, 1 where a window's hash or that of its leading words falls.

    Made as bitmaps in the cluster: what reaches the driver is ``slots`` / 8 bytes at most.
    """
    ws = F.split("window", " ")
    lead = F.when(F.size(ws) >= LEAD, window_hash(ws, F.lit(0), LEAD))
    # missing words are null and leave the hash as it is, so one expression serves all sizes up to ``most``
    whole = F.xxhash64(*[F.get(ws, F.lit(k)) for k in range(most)])
    rows = (
        known.select(F.explode(F.array(lead, whole)).alias("h"))
        .where("h is not null")
        .select(F.explode(F.array(*places(F.col("h"), slots))).alias("slot"))
        .groupBy(F.expr(f"slot div {ROW_BITS}").alias("row"))
        .agg(F.expr(f"bitmap_construct_agg(slot % {ROW_BITS})").alias("bits"))
        .collect()
    )
    out = np.zeros(max(slots, ROW_BITS), dtype=np.uint8)
    for r in rows:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), dtype=np.uint8), bitorder="little")
        out[r["row"] * ROW_BITS : (r["row"] + 1) * ROW_BITS] = bits[:ROW_BITS]
    return bytearray(out[:slots].tobytes())


def candidates(docs: DataFrame, known: DataFrame, sizes: list[int], slots: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_words`` and ``hits`` (array of at, size, window) by hash."""
    hits = F.array().cast("array<struct<at:int,size:int,window:string>>")
    if sizes:
        table, one = F.lit(hash_set(known, max(sizes), slots)), F.lit(bytearray(b"\x01"))

        def in_set(at: Column, length: int) -> Column:
            one_of, other = places(window_hash(F.col("ws"), at, length), slots)
            return (F.substring(table, one_of.cast("int") + 1, F.lit(1)) == one) & (F.substring(table, other.cast("int") + 1, F.lit(1)) == one)

        def found(size: int) -> Column:
            starts = F.when(F.size("ws") >= size, F.sequence(F.lit(0), F.size("ws") - size)).otherwise(F.array().cast("array<int>"))
            test = (lambda at: in_set(at, LEAD) & in_set(at, size)) if size >= LEAD else (lambda at: in_set(at, size))
            return F.transform(
                F.filter(starts, test),
                lambda at: F.struct(at.alias("at"), F.lit(size).alias("size"), window_text(F.col("ws"), at, size).alias("window")),
            )

        hits = F.concat(*[found(size) for size in sizes])
    return docs.select("doc_id", "text_key", F.size("ws").alias("n_words"), hits.alias("hits"))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slots: int = SLOTS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_key``, ``n_words``, ``n_hit``, ``items``, ``spans``.

    ``spans`` are the confirmed windows as (at, stop) in words, ``items`` the
    ids of the items with an occurring window.
    """
    known = cut(item_windows(items, item_id, item_text, window))
    sizes = [r[0] for r in known.select("size").distinct().orderBy("size").collect()]  # at most ``window`` values
    split = docs.select(
        F.col(id).alias("doc_id"), text_key_of(F.col(text)).alias("text_key"), words(F.col(text)).alias("ws")
    )
    found = cut(candidates(split, known, sizes, slots))
    hits = found.select("doc_id", "text_key", F.explode("hits").alias("hit")).select(
        "doc_id", "text_key", "hit.at", "hit.size", "hit.window"
    )
    confirmed = (
        hits.join(known, ["size", "window"])
        .groupBy("doc_id", "text_key")
        .agg(
            F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("stop")))).alias("spans"),
            F.array_sort(F.collect_set("item_id")).alias("items"),
        )
        .withColumn(
            "n_hit",
            F.aggregate(
                "spans",
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
                lambda s, x: F.struct(
                    (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["at"], s["reach"]))).alias("n"),
                    F.greatest(s["reach"], x["stop"]).alias("reach"),
                ),
            )["n"],
        )
    )
    rows = in_rows_of(found.drop("hits"), confirmed, ["doc_id", "text_key"])
    return rows.select(
        "doc_id",
        "text_key",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast(f"array<{items.schema[item_id].dataType.simpleString()}>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,stop:int>>")).alias("spans"),
    )


def remove_documents(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    leaks = find_leaks(docs, items, id, text).where("n_hit > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    ).distinct()
    on = docs[id].eqNullSafe(leaks["_id"]) & (text_key_of(docs[text]) == leaks["_key"])
    return docs.join(leaks, on, "left_anti")
