"""Language identification: gradients, both forms of the network, odd rows, held-out accuracy."""

from zlib import crc32

import numpy as np
import pytest

from planspark.llm import langid
from planspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def plain_labels(net, row):
    """The network on one window, number by number from its definition."""

    def states(side, codes):
        h = len(side.bias)
        state, out = np.zeros(h), []
        for b in codes:
            a, m = side.table[b].astype(float), state @ side.inner.astype(float)
            gate = 1 / (1 + np.exp(-(a + m)))
            n = np.tanh(a[2 * h :] + gate[:h] * (m[2 * h :] + side.bias))
            state = (1 - gate[h : 2 * h]) * n + gate[h : 2 * h] * state
            out.append(state)
        return out

    both = zip(states(net.ahead, row), states(net.behind, row[::-1])[::-1], strict=True)
    out = [np.exp(np.concatenate(s) @ net.out + net.bias) for s in both]
    return np.array([p / p.sum() for p in out])


@pytest.fixture(scope="module")
def net():
    return langid.Network.new(["a", "b", "c"], seed=3)


def test_both_forms_equal_the_definition(net):
    x = langid.windows("Ein Satz – mit Zeichen, 42 Zahlen und Ende.".encode() * 3)
    want = np.array([plain_labels(net, row) for row in x])
    assert np.allclose(net.labels(x), want, atol=1e-5)
    assert np.allclose(net.letter_sums(x), (want * langid.LETTER[x][:, :, None]).sum(1), atol=1e-4)


def test_gradients_equal_differences():
    net = langid.Network.new(["a", "b"], seed=1)
    for d in (net.ahead, net.behind):
        d.table, d.inner, d.bias = (w.astype(float) for w in d.weights())
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    x, y = langid.windows(b"some bytes to learn from" * 4, 8), np.arange(12) % 2
    _, grads = net.gradients(x, y)
    for w, g in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        around = []
        for step in (1e-4, -2e-4):
            w[at] += step
            around.append(net.gradients(x, y)[0])
        w[at] += 1e-4
        assert abs((around[0] - around[1]) / 2e-4 - g[at]) < 1e-4 * max(1, abs(g[at]))


def test_windows_cover_a_text():
    for n in (0, 1, 63, 64, 65, 1000):
        text = bytes(k % 251 for k in range(n))
        x = langid.windows(text)
        assert bytes(x[x != langid.PAD].astype(np.uint8)) == text
    assert langid.windows(b"").shape == (0, langid.WINDOW)


def test_the_rest_of_a_window_changes_nothing(net):
    long, short = langid.windows(b"short", 64), langid.windows(b"short", 8)
    assert np.allclose(net.labels(long)[:, :5], net.labels(short)[:, :5], atol=1e-6)


def test_odd_rows(spark, net):
    rows = [
        (1, None, "fr"), (2, "", "fr"), (3, "12 !? 45", "fr"), (4, "x", None), (None, "no id", "fr"), (5, "same", "de"), (5, "same", "de"),
        (6, "very long " * 20000, "de"), (7, "漢字", "fr"),
    ]
    docs = spark.createDataFrame([(*r, "p", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = sorted(map(tuple, langid.identify(docs, net).collect()), key=repr)
    assert len(got) == len(rows) and got.count(next(r for r in got if r[0] == 5)) == 2
    by_id = {r[0]: r for r in got}
    for k in (1, 2, 3):
        assert by_id[k][1:] == ("und", 0.0)
    for k in (4, None, 6, 7):
        assert by_id[k][1] in net.languages and 0 < by_id[k][2] <= 1
    assert langid.identify(docs.limit(0), net).count() == 0
    assert langid.fit(docs.where("doc_id < 4")) is None or langid.fit(docs.where("doc_id < 4")).languages == ["fr"]
    assert langid.fit(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 40, "some text " * 100, "de" if k % 4 else "fr") for k in range(400)], "doc_id long, text string, lang string")
    got = langid.labelled_windows(docs, "doc_id", "text", "lang", rows=7, each=3).collect()
    assert sorted((n, sum(r["lang"] == n for r in got)) for n in ("de", "fr")) == [("de", 21), ("fr", 21)]
    assert {r["lang"] for r in langid.labelled_windows(docs, "doc_id", "text", "lang", languages=1).collect()} == {"de"}


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op11_language_id"](spark, DATA).collect()
    assert {r["doc_id"] for r in got} == set(docs)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    unseen = [r for r in got if r["held_out"] and len(docs[r["doc_id"]]["text"]) > 100]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in unseen) > 0.98 * len(unseen) > 200
