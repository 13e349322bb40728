"""The pipeline's near-copy stage links by SimHash as well as by shared words."""

import corpus_pipeline
from planspark.llm import simhash


def near_prints():
    """Two texts within two bits of each other that share too few words for similarity 0.8."""
    base = [f"w{i}" for i in range(30)]
    for at in range(30):
        for new in range(400):
            words = base[:at] + [f"x{new}"] + base[at + 1 :]
            one, two = (simhash.fingerprint(simhash.shingles(" ".join(w))) for w in (base, words))
            if bin((one ^ two) & (2**64 - 1)).count("1") <= 2 and 4 <= at <= 25:
                return " ".join(base), " ".join(words)


def test_copies_within_two_bits_go(spark):
    one, two = near_prints()
    # the third has only the second as a copy, by its words
    rows = [(1, one), (2, two), (3, two + " more"), (4, "something else of its own that nobody repeats"), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies_out(spark, docs, "").collect()}
    assert kept == {1, 4}
