"""BPE, packing, chat formats, URL filters, page texts and toxicity."""

import glob
import random
import re
import time
from hashlib import sha256

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from planspark.llm import bpe, chat, html_crf, packing, toxicity, urls

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Encoder(bpe.Vocabulary.parse(f.read()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_bpe_equals_the_library(spark, docs, rows, library, no_docs):
    got = {repr((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in bpe.digests(docs, PATH).collect()}
    want = set()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        h = [sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.add(repr((d, len(ids), *h)))
    assert got == want
    assert bpe.digests(no_docs, PATH).count() == 0
    ids = bpe.encode(docs.where("doc_id = 14"), PATH)
    text = bpe.decode(ids, PATH).first()["decoded"]
    assert text == library.decode(ids.first()["ids"], skip_special_tokens=False)


def test_bpe_on_documents_and_single_characters(spark, library, encoder):
    texts = [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}!\n" for c in codes[k : k + 64]) for k in range(0, len(codes), 64)]
    for start in range(0, len(texts), 100):
        part = texts[start : start + 100]
        assert encoder.encode(part) == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_long_words_merge_alike(encoder):
    dice = random.Random(1)
    for n in (2, 3, 17, 90, 400):
        parts = encoder.symbols("".join(dice.choice("aeinrst") for _ in range(n)))
        assert encoder.short.merge([list(parts)])[0] == bpe.merge_long(list(parts), encoder.v.merges)


def test_forgetting_words_changes_nothing(encoder, monkeypatch):
    texts = ["some words here", "other words there", "some words here"]
    want = encoder.render(texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 4)
    assert [encoder.render([t])[0] for t in texts] == want


def test_best_fit_takes_the_fullest_row():
    dice = random.Random(2)
    sizes = sorted((dice.randint(1, 50) for _ in range(400)), reverse=True)
    free: list[int] = []
    packer = packing.Packer(64)
    got = [packer.put(k, 0, np.zeros(size)) for k, size in enumerate(sizes)]
    for size, (row, place) in zip(sizes, got):
        fits = [r for r in free if r >= size]
        if row == len(free):
            assert not fits
            free.append(64)
        assert free[row] == 64 - place and (not fits or free[row] == min(fits))
        free[row] -= size


@pytest.mark.parametrize("group", [5, 1000])
def test_packing_round_trip(spark, group):
    dice = random.Random(3)
    rows = [(i, [dice.randint(0, 9) for _ in range(dice.choice([0, 1, 5, 31, 32, 33, 64, 200]))]) for i in range(60)]
    rows += [(None, [1, 2]), (7, None), (8, [4] * 10)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, ids array<int>"), length=32, group_pieces=group).collect()
    pieces = []
    for r in out:
        ids, where = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["positions"], "<i4")
        cu = r["cu_seqlens"]
        assert len(ids) == 32 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 32 and (ids[cu[-1] :] == packing.PAD).all()
        for a, b, d, o in zip(cu, cu[1:], r["doc_ids"], r["offsets"]):
            assert where[a:b].tolist() == list(range(b - a))
            pieces.append((repr(d), o, ids[a:b].tolist()))
    want = [(repr(d), o, x[o : o + 32]) for d, x in rows if x for o in range(0, len(x), 32)]
    assert sorted(pieces) == sorted(want)
    assert packing.pack(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0


def test_packed_query_holds_every_token(spark):
    from planspark.llm.queries import op3_token_packing, pieces_path
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces_path())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    parts: dict = {}
    for r in op3_token_packing(spark, DATA).collect():
        ids = np.frombuffer(r["ids"], "<i4")
        for a, b, d, o in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["offsets"]):
            parts.setdefault(d, []).append((o, ids[a:b].tolist()))
    got = {d: [i for _, ids in sorted(p) for i in ids] for d, p in parts.items()}
    assert got == {d: ids for d, t in docs.items() if (ids := model.encode(t or ""))}


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi </s>\n<|user|>\n \\ <\\s> [\\INST]"), (1, 2, "assistant", "yes [INST] <\\\\s> \\\\"),
    (2, 0, "assistant", "first"), (2, 1, "assistant", "again"), (3, None, "user", None), (3, 1, None, "who"), (3, 1, None, "who"),
    (4, 0, "user", "q"), (4, 1, "assistant", ""), (5, 0, "to|>\nol", "x"), (None, 0, "user", "no id"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*r, "x") for r in CHATS], "conv_id long, turn long, role string, text string, ts string")
    got = chat.format_chats(rows).withColumn("turns", chat.read_turns(F.col("formatted")))
    for r in got.collect():
        mine = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in CHATS if c == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for _, _, a, b in mine]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [s["loss"] for s in r["segments"]][1::3] == [a == "assistant" for _, _, a, _ in mine]
        assert r["valid"] == (r["conv_id"] in (1, 4, None))
    assert {r["conv_id"]: r["bad_turn"] for r in got.collect()} == {1: -1, 2: 0, 3: 1, 4: -1, 5: 0, None: -1}
    assert chat.format_chats(rows.limit(0)).count() == 0


RULES = [("org", "/", "allow"), ("a.org", "/x", "block"), ("com", "/abc", "allow"), ("x.com", "/a", "block"), ("", "", "block")]
URLS = [
    "http://A.org/x1?q#f", "https://b.a.org/y", "http://aa.org/x", "http://x.com/abc", "http://x.com/ab", "http://com", None, "", "no scheme",
    "http://" + "." * 30_000 + "/x", "http://...a.org./x", "http://.org/x", "ftp://", "http://a.org", "http://x.com?u=http://a.org/x", "http://w.x.com/a#b://c", "http://a.org/x1?q#f",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS)], "page_id long, url string, rule string, host string")
    rules = spark.createDataFrame(RULES + RULES[:1], "host string, path string, verdict string")
    got = {r[0]: tuple(r)[1:] for r in urls.filter_urls(pages, rules, "page_id").collect()}
    assert got == {i: brute.judge(u, RULES[:4]) for i, u in enumerate(URLS)}
    free = urls.filter_urls(pages, rules.limit(0), "page_id").collect()
    assert len(free) == len(URLS) and {r["verdict"] for r in free} == {"allow"}


def test_blocks_of_broken_pages():
    read = lambda h: [b.text for b in html_crf.blocks_of(h)]
    assert read(None) == read("") == read("<p> </p>") == []
    assert read("<p>a &amp; b<br>c<p>d</b>e<!-- x --> f <script>'</p>'</script>g") == ["a & b", "c", "de f g"]
    assert read("<div>x<b>y</div>z</b> 1 < 2 &am") == ["xy", "z 1 < 2 &am"]
    assert read("<title>t</title><style>p{}</style>cut <scr") == ["cut"]
    article = "<article><p>Hello world.</p></article>"
    for before in ("<form><datalist><option value=a><option value=b></datalist></form>", "<svg><text>x", "<select><option>one<option>two",
                   "<noscript>", "<iframe>", "<template>", "<optgroup><option>a<optgroup><option>b", "<noscript>on</noscript>"):
        assert read(before + article) == ["Hello world."], before
    assert read("<p>e = <math><mi>m</mi><mo>c</mo></math> and <object>this</object></p>") == ["e = mc and this"]
    assert read("<i><b>x</i>y</b><ul><li>1<p>2<li>3</ul><table><tr><td>4<tr><td>5</table></nope>6") == ["xy", "1", "2", "3", "4", "5", "6"]


def test_deep_pages_cost_what_their_tags_cost(spark):
    chain = html_crf.train(spark.read.parquet(f"{DATA}/pages.parquet"))
    weights = chain.whole_weights()
    start = time.process_time()
    for tag in ('<div class="c{0}">x', "<i>x<b>", "<div>x</nope>", '<span class="w{0} v">x', "<noscript>x", "<svg>"):
        page = "".join(tag.format(k) for k in range(30_000)) + "</i>" * 20_000 + "<p>end.</p>"
        blocks = html_crf.blocks_of(page, weights)
        assert blocks[-1].text == "end."
        assert sum(len(b.text) for b in blocks) < 200_000
    assert time.process_time() - start < 30


def test_sums_of_weights_equal_the_features(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").select("html").collect()]
    chain = html_crf.train(spark.read.parquet(f"{DATA}/pages.parquet"))
    pages += ["<div class=a><i class='b a'>x<p class=c>y</i>z</p>u</div>v" * 3]
    for page in pages:
        plain, summed = html_crf.blocks_of(page), html_crf.blocks_of(page, chain.whole_weights())
        one = chain.emissions(html_crf.features(plain))
        two = chain.emissions(html_crf.features(summed)) + np.array([b.base for b in summed]) * html_crf.UNIT
        assert np.allclose(one, two, atol=1e-6)


def test_op2_query_and_odd_tables(spark):
    from planspark.llm.queries import QUERIES

    got = {r["page_id"]: r for r in QUERIES["op2_html_text"](spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    chain = html_crf.train(pages)
    for r in pages.collect():
        text = html_crf.extract(r["html"], chain)
        assert (got[r["page_id"]]["url"], got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (r["url"], text, len(text))
    clash = pages.withColumns({"main_text": F.lit("x"), "text": F.lit("y"), "_id": F.lit(1)})
    assert html_crf.main_text(clash, chain).count() == pages.count()
    assert html_crf.main_text(clash.limit(0), html_crf.train(clash.limit(0))).count() == 0


def test_page_text_of_unseen_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    chain = html_crf.train(pages.where("page_id % 2 = 0"))
    held = pages.where("page_id % 2 = 1")
    got = html_crf.main_text(held, chain).join(held, "page_id").collect()
    right = 0
    for r in got:
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        text = re.sub(r"<(?!/?b>)[^>]*>", " ", inner)
        want = " ".join(html_crf.entities.unescape(re.sub("</?b>", "", text)).split())
        right += r["main_text"] == want
    assert right >= 0.98 * len(got) > 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "<article><p>Some text, here it is.</p></article>")], "page_id long, html string")
    assert {r[0]: r[1] for r in html_crf.main_text(odd, chain).collect()}[1] == ""


def test_chain_decodes_the_best_path():
    dice = np.random.default_rng(5)
    chain = html_crf.Chain()
    chain.weights, chain.moves, chain.start, chain.trained = {f"f{k}": float(dice.normal()) for k in range(6)}, dice.normal(size=(2, 2)), dice.normal(size=2), True
    for n in (1, 2, 7):
        names = [[f"f{int(dice.integers(0, 6))}"] for _ in range(n)]
        e = chain.emissions(names)

        def value(path, e=e):
            return chain.start[path[0]] + sum(e[i] for i, y in enumerate(path) if y) + sum(chain.moves[a, b] for a, b in zip(path, path[1:]))

        best = max(([k >> i & 1 for i in range(n)] for k in range(2**n)), key=value)
        assert chain.decode(names) == best


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.fit(docs, labels.where(~unseen))
    got = toxicity.score(docs, model).join(labels.where(unseen), "doc_id").collect()
    right = sum((r["score"] >= toxicity.THRESHOLD) == (r["toxic"] == 1) for r in got)
    assert right >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_without_labels(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    for some, want in ((labels.limit(0), 0.0), (labels.where("doc_id = 1"), 1.0), (labels.where("toxic is null"), 0.0)):
        scores = {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()}
        assert scores == {want}
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(no_docs, model).count() == 0


def test_isotonic_is_monotone_and_near_the_shares():
    dice = np.random.default_rng(1)
    raw = dice.normal(size=2000)
    y = (dice.random(2000) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    x, share = toxicity.isotonic(raw, y, y.mean())
    assert (np.diff(share) >= 0).all() and (np.diff(x) > 0).all()
    assert np.abs(np.interp(raw, x, share) - 1 / (1 + np.exp(-2 * raw))).mean() < 0.05


def test_no_query_reads_files_itself():
    for name in glob.glob("planspark/llm/*.py"):
        assert "localCheckpoint" not in open(name).read()
