"""Exact dedup, line dedup, near-duplicates and decontamination against brute force."""

import brute
import numpy as np
from brute import PASSAGE
from pyspark.sql import functions as F

from planspark.llm import decontaminate, exact_dedup, lines, simhash


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_exact(docs, rows, no_docs):
    got = exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept")
    same(map(tuple, got.collect()), brute.exact(rows))
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_over_many_copies(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(300)] + [(1000 + i, f"t{i}") for i in range(100)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    same(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept").collect()), brute.exact(rows))


def test_lines(docs, rows, no_docs):
    got = lines.dedup_lines(docs)
    dropped = F.aggregate("_runs", F.lit(0), lambda s, r: s + r["length"])
    got = got.select("doc_id", F.size("_lines"), dropped, "_kept").collect()
    same(map(tuple, got), brute.kept_lines(rows))
    assert lines.dedup_lines(no_docs).count() == 0


def test_lines_with_a_common_line_over_many_partitions(spark):
    rows = [(i, f"the same line for all\nown line number {i}\nthe same line for all" if i % 3 else "the same line for all") for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))
        dropped = F.aggregate("_runs", F.lit(0), lambda s, r: s + r["length"])
        same(map(tuple, got.select("doc_id", F.size("_lines"), dropped, "_kept").collect()), brute.kept_lines(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


ITEMS = [(1, PASSAGE), (2, "own words"), (3, None), (4, ""), (5, "Hello World"), (5, "Hello World"), (6, PASSAGE[4:]), (None, "a second line here")]


def test_leaks(spark, docs, rows, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute.leaks(rows, ITEMS)
    for slots in (decontaminate.SLOTS, 64):
        got = decontaminate.find_leaks(docs, items, slots=slots)
        same(map(tuple, got.select("doc_id", "n_words", "n_hit", "items").collect()), want)
    assert decontaminate.find_leaks(no_docs, items).count() == 0
    none = decontaminate.find_leaks(docs, items.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(rows))
    left = decontaminate.remove_documents(docs, items)
    assert left.columns == docs.columns
    same([r[0] for r in left.select("doc_id").collect()], [d for d, _, n, _ in want if not n])


def test_simhash(docs, rows, no_docs):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex(F.col("fp")), "component_id")
    same(map(tuple, got.collect()), brute.near(rows))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_links_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, size=6)]
    fps = set()
    for _ in range(300):
        x = base[int(rng.integers(0, 6))] & (2**64 - 1)
        for _ in range(int(rng.integers(0, 5))):
            x ^= 1 << int(rng.integers(0, 64))
        fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)

    def components(pairs):
        label = {f: f for f in fps}
        while True:
            before = dict(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label

    want = components([(a, b) for a in fps for b in fps if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for block in (7, 64, 4096):
        got = [tuple(r) for r in simhash.links(table, block).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in got)
        assert components(got) == want
