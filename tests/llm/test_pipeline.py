"""The pipeline against its brute-force version."""

from hashlib import sha256

import brute
import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from test_near import components

from planspark.llm import toxicity
from planspark.llm.queries import held_out


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").where(~held_out()))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    rows = [r for r, s in zip(rows, model.score([t for _, t in rows])) if s < toxicity.THRESHOLD]
    rows = [(d, kept) for d, _, _, kept in brute.kept_lines(rows)]
    # five words, similarity 0.8: the first row of each component stays
    rows = [r for k, (r, first) in enumerate(zip(rows, components([t for _, t in rows]))) if k == first]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r, (_, _, n, _) in zip(rows, brute.leaks(rows, items)) if not n]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        h = [sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.add((d, len(ids), *h))
    got = {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == want and len(got) > 50


def test_stages_keep_the_columns_and_odd_rows(spark, docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, no_docs, sf).count() == 0, name
        assert stage(spark, docs, sf).count() > 5, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
