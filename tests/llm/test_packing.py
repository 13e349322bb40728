"""Sentence-piece ids word by word, and packing of binary ids and of clashing columns."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from planspark.llm import packing

PATH = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"


def plain(texts):
    return SentencePieceProcessor(model_file=PATH).encode(texts)


def test_ids_of_words_equal_those_of_the_text(spark, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts += ["", " ", "  ", "a ", " a", "a  b   c ", "\n a\n\n  b", "\ta \t b", " 　x", "<s> </s> a", "▁ a ▁b", "é  ü ", "﷽ ﬁ x", "x" * 20000 + " y"]
    dice = random.Random(1)
    texts += ["".join(dice.choice("ab  \n\té漢😀▁ \xad.x") for _ in range(dice.randrange(20))) for _ in range(2000)]
    with open(PATH, "rb") as f:
        pieces = packing.Pieces(f.read())
    want = plain(texts)
    for most in (packing.Pieces.CACHE_WORDS, 50):
        monkeypatch.setattr(packing.Pieces, "CACHE_WORDS", most)
        got = [np.frombuffer(x, "<i4").tolist() for k in range(0, len(texts), 64) for x in pieces.encode(texts[k : k + 64])]
        assert got == want


def test_binary_ids_pack_like_arrays(spark, docs, rows, no_docs):
    wide, arrays = packing.encode(docs, PATH, wide=True), packing.encode(docs, PATH)
    want = dict(zip(map(repr, (d for d, _ in rows)), plain([t or "" for _, t in rows])))
    assert {repr(r["doc_id"]): list(r["ids"]) for r in arrays.collect()}.keys() == want.keys()
    for made in (wide, arrays):
        clash = made.select("doc_id", F.lit("x").alias("grp"), F.lit(1).alias("size"), F.lit(2).alias("k"), "ids", F.lit(3).alias("offset"))
        pieces = []
        for r in packing.pack(clash, length=64).collect():
            ids = np.frombuffer(r["ids"], "<i4")
            for a, b, d, o in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["offsets"]):
                pieces.append((repr(d), o, ids[a:b].tolist()))
        tokens = sorted((repr(d), o, i[o : o + 64]) for d, t in rows if (i := plain([t or ""])[0]) for o in range(0, len(i), 64))
        assert sorted(pieces) == tokens
    assert packing.pack(packing.encode(no_docs, PATH, wide=True)).count() == 0
