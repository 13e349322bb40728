"""Near copies by five words and similarity 0.8 against brute force."""

import random

import brute
import corpus_pipeline
import numpy as np

from planspark.llm import near


def shingle_set(text, size=5):
    ws = brute.re.split(f"{brute.SPACE}+", brute.low(text or ""))
    ws = [w for w in ws if w]
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} - {()}


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def components(texts):
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]
    while True:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label


def edited(words, edits, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """Twelve originals with copies of few to many changed words, from clearly similar to clearly not."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 400))]
        texts += [edited(words, max(1, len(words) * k // 200), rng) for k in (0, 1, 2, 3, 4, 5, 8)]
    return texts


def test_edited_copies(spark):
    texts = corpus()
    want = components(texts)
    assert len(set(want)) < len(want) - 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(docs).collect()}
    assert [got[k] for k in range(len(texts))] == want
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies_out(spark, docs, "").collect()}
    assert kept == set(want)


def test_odd_rows(spark, docs, rows, no_docs):
    got = near.near_copies(docs).select("doc_id", "component_id").collect()
    label = components([t for _, t in rows])
    ids = {k: min((d for m, (d, _) in zip(label, rows) if m == k and d is not None), default=None) for k in label}
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, ids[k])) for k, (d, _) in zip(label, rows))
    assert near.near_copies(no_docs).count() == 0


def test_a_large_group_in_small_blocks(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    texts = [edited(words, 3 + k % 4, rng) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near.prints(docs)
    want, node = components(texts), {r["doc_id"]: r["node"] for r in rows.collect()}
    nodes = rows.select("node", "text_key", "n", "bands")
    for block in (5, 512):
        got = near.links(near.cells(docs, nodes, block=block)).collect()
        place = {v: k for k, v in node.items()}
        label = list(range(len(texts)))
        while True:
            before = list(label)
            for r in got:
                i, j = place[r["a"]], place[r["b"]]
                label[i] = label[j] = min(label[i], label[j])
            if label == before:
                break
        assert label == want


def test_links_within_a_cell():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 11, 22, 34, 500)]
    a, b = near.similar(sets, np.zeros(5, dtype=int))
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 0), (2, 0)]
    a, b = near.similar(sets, np.array([0, 0, 1, 1, 1]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 1)]


def test_one_row_of_each_component_stays(spark):
    one, other = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [
        (1, one), (2, one + " more"), (2, other), (3, "repeated row of a few words"), (3, "repeated row of a few words"),
        (None, "null ids with the same words"), (None, "Null ids with the same words"), (None, "alone"), (None, one + " end"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"].lower()) for r in corpus_pipeline.near_copies_out(spark, docs, "").collect()]
    want = [(1, one), (2, other), (3, "repeated row of a few words"), (None, "null ids with the same words"), (None, "alone")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
