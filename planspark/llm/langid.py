"""Language identification by a bidirectional gated recurrent network over bytes (operator 11).

The UTF-8 bytes of a whole text are cut into windows of ``WINDOW`` bytes, and
the network reads each window in both directions. A direction has reset and
update gates and a candidate state of ``HIDDEN`` numbers; its input weights
are a table with a row per byte. Every position gets a probability per
language from the states of both directions, and a document's probabilities
are the means over the positions of its letters.

The network is trained here with numpy: backpropagation through time over all
positions of a window, Adam steps, as many windows of each language in a
batch. It is fitted on at most ``TRAIN_DOCS`` documents of each of the
``LANGUAGES`` most common languages and ``TRAIN_WINDOWS`` windows of each of
them, chosen by hash from the whole text; scoring covers all rows and texts.

Cases: a null text and one without letters are ``und`` with the score 0; ties
go to the language first in the alphabet; without labelled documents all are
``und``; repeated rows get the same result, and one text of each id enters the
fit; an empty table gives an empty result; extra columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 64
HIDDEN = 8
#: Bounds of the sample that the network is fitted on.
LANGUAGES = 64
TRAIN_DOCS = 500
TRAIN_WINDOWS = 12
STEPS = 320
BATCH = 256
RATE = 0.02
#: Windows that go through the network at a time.
AT_ONCE = 2048
#: The byte after the end of a text; the state passes through it unchanged.
PAD = 256
UNKNOWN = "und"
LETTER = np.zeros(PAD + 1, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes of a text as rows of ``size``, the last one filled up with ``PAD``."""
    values = np.frombuffer(text, dtype=np.uint8)
    out = np.full((-(-len(values) // size), size), PAD, dtype=np.int16)
    out.reshape(-1)[: len(values)] = values
    return out


@dataclass
class Direction:
    """Weights of one direction; gates in the order reset, update, candidate."""

    table: np.ndarray  # (PAD + 1, 3 * hidden), by byte
    inner: np.ndarray  # (hidden, 3 * hidden)
    bias: np.ndarray  # (hidden,), on the inner part of the candidate

    @staticmethod
    def new(hidden: int, rng: np.random.Generator) -> Direction:
        table = rng.normal(0, 0.3, (PAD + 1, 3 * hidden)).astype(np.float32)
        inner = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        return Direction(table, inner, np.zeros(hidden, dtype=np.float32)).padded()

    def padded(self) -> Direction:
        """Close the update gate at ``PAD``."""
        h = len(self.bias)
        self.table[PAD] = 0
        self.table[PAD, h : 2 * h] = 30
        return self

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias]

    def run(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each of the bytes ``x`` (steps, rows), and what the way back needs."""
        h, kept = len(self.bias), []
        state = np.zeros((x.shape[1], h), dtype=np.float32)
        out = np.empty((*x.shape, h), dtype=np.float32)
        for t in range(len(x)):
            a, m = self.table[x[t]], state @ self.inner
            gates = sigmoid(a[:, : 2 * h] + m[:, : 2 * h])
            r, z, inner = gates[:, :h], gates[:, h:], m[:, 2 * h :] + self.bias
            n = np.tanh(a[:, 2 * h :] + r * inner)
            kept.append((state, r, z, n, inner))
            state = n + z * (state - n)
            out[t] = state
        return out, kept

    def back(self, x: np.ndarray, kept: list, by_state: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights from those of the states, from the last step to the first."""
        h = len(self.bias)
        table, inner, bias = (np.zeros_like(w) for w in self.weights())
        carry = np.zeros_like(by_state[0])
        of_input = np.empty((*x.shape, 3 * h), dtype=np.float32)
        for t in range(len(x) - 1, -1, -1):
            state, r, z, n, through = kept[t]
            d = by_state[t] + carry
            of_n = d * (1 - z) * (1 - n * n)
            of_z = d * (state - n) * z * (1 - z)
            of_r = of_n * through * r * (1 - r)
            gates = np.concatenate([of_r, of_z, of_n * r], axis=1)
            of_input[t, :, : 2 * h], of_input[t, :, 2 * h :] = gates[:, : 2 * h], of_n
            inner += state.T @ gates
            bias += gates[:, 2 * h :].sum(0)
            carry = d * z + gates @ self.inner.T
        np.add.at(table, x.reshape(-1), of_input.reshape(-1, 3 * h))
        table[PAD] = 0
        return [table, inner, bias]


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    out: np.ndarray  # (2 * hidden, languages)
    bias: np.ndarray  # (languages,)

    @staticmethod
    def new(languages: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        n = len(languages)
        ahead, behind = (Direction.new(hidden, rng) for _ in range(2))
        out = rng.normal(0, 0.5, (2 * hidden, n)).astype(np.float32)
        return Network(languages, ahead, behind, out, np.zeros(n, dtype=np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.ahead.weights(), *self.behind.weights(), self.out, self.bias]

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows, positions, languages) of windows of bytes, step by step as in training."""
        steps = x.T
        states = np.concatenate([self.ahead.run(steps)[0], self.behind.run(steps[::-1])[0][::-1]], axis=2)
        logits = states @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        return (p / p.sum(axis=2, keepdims=True)).transpose(1, 0, 2)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions of the windows ``x`` with the languages ``y``, and its gradients."""
        steps = x.T
        one, kept_one = self.ahead.run(steps)
        two, kept_two = self.behind.run(steps[::-1])
        states = np.concatenate([one, two[::-1]], axis=2)
        logits = states @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        used = (steps != PAD)[:, :, None] / max(1, int((steps != PAD).sum()))
        right = p[:, np.arange(len(y)), y]
        loss = float(-(np.log(np.maximum(right, 1e-20)) * used[:, :, 0]).sum())
        p[:, np.arange(len(y)), y] -= 1
        d = (p * used).astype(np.float32)
        by_state = d @ self.out.T
        h = len(self.ahead.bias)
        flat = states.reshape(-1, 2 * h)
        return loss, [
            *self.ahead.back(steps, kept_one, by_state[:, :, :h]),
            *self.behind.back(steps[::-1], kept_two, by_state[::-1, :, h:]),
            flat.T @ d.reshape(-1, d.shape[2]),
            d.sum((0, 1)),
        ]

    def letter_sums(self, x: np.ndarray) -> np.ndarray:
        """Per window, the sums of the probabilities over the positions of letters; rows are windows.

        The same network as ``labels``, one column per window so that each gate
        is one contiguous array, with signs folded into the weights.
        """
        n, steps = x.shape
        h, count = len(self.ahead.bias), len(self.languages)
        x = np.ascontiguousarray(x.T)
        logits = np.empty((steps, count, n), dtype=np.float32)
        a, m = (np.empty((3 * h, n), dtype=np.float32) for _ in range(2))
        gates, candidate = np.empty((2 * h, n), dtype=np.float32), np.empty((h, n), dtype=np.float32)
        sums = np.zeros((count, n), dtype=np.float32)
        p = np.empty((count, n), dtype=np.float32)
        for side, order in ((self.ahead, range(steps)), (self.behind, range(steps - 1, -1, -1))):
            first = side is self.ahead
            table, inner = side.table.T.copy(), side.inner.T.copy()
            table[: 2 * h] *= -1
            inner[: 2 * h] *= -1
            bias = side.bias[:, None]
            out = np.ascontiguousarray(self.out[:h].T if first else self.out[h:].T)
            state = np.zeros((h, n), dtype=np.float32)
            for t in order:
                np.take(table, x[t], axis=1, out=a, mode="clip")
                np.matmul(inner, state, out=m)
                np.add(a[: 2 * h], m[: 2 * h], out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.add(m[2 * h :], bias, out=candidate)
                candidate *= gates[:h]
                candidate += a[2 * h :]
                np.tanh(candidate, out=candidate)
                state -= candidate
                state *= gates[h:]
                state += candidate
                if first:
                    np.matmul(out, state, out=logits[t])
                else:
                    np.matmul(out, state, out=p)
                    p += logits[t]
                    p += self.bias[:, None]
                    p -= p.max(axis=0)
                    np.exp(p, out=p)
                    p *= LETTER[x[t]] / p.sum(axis=0)
                    sums += p
        return sums.T


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = BATCH, seed: int = 0) -> Network:
    """Adam steps over batches that hold as many windows of each language."""
    net, rng = Network.new(languages, seed=seed), np.random.default_rng(seed)
    of = [np.flatnonzero(y == k) for k in range(len(languages))]
    weights = net.weights()
    mean, square = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(own, -(-batch // len(of))) for own in of])
        _, grads = net.gradients(x[rows], y[rows])
        rate = RATE * (1 - 0.95 * step / steps)
        for w, g, m, s in zip(weights, grads, mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    net.ahead.padded()
    net.behind.padded()
    return net


def labelled_windows(
    docs: DataFrame, id: str, text: str, lang: str, languages: int = LANGUAGES, rows: int = TRAIN_DOCS, each: int = TRAIN_WINDOWS
) -> DataFrame:
    """``lang`` and ``bytes`` of the windows of the sample: bounded numbers of languages, documents and windows."""
    known = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "doc_id is not null AND text is not null AND lang is not null"
    )
    counts = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
    # only hashes that leave about four times the rows wanted reach the sort
    near = place < F.ceil(F.least(F.lit(1.0), F.lit(4.0 * rows) / F.col("n")) * F.lit(2.0**32))
    some = known.join(F.broadcast(counts), "lang").where(near)
    one = some.groupBy("lang", "doc_id").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    first = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = one.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= rows)

    def cut_up(batches: Iterator):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            langs, parts = [], []
            for name, doc, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                body = body.encode("utf-8", "replace")
                starts = range(0, len(body), WINDOW)
                # by the hash of their place, so from all parts of the text
                kept = sorted(starts, key=lambda s: (xxh64_intdigest(f"{doc}:{s}"), s))[:each]
                langs += [name] * len(kept)
                parts += [body[s : s + WINDOW] for s in kept]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], names=["lang", "bytes"])

    return chosen.select("lang", "doc_id", "text").mapInArrow(cut_up, "lang string, bytes binary")


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network fitted on the bounded sample of ``docs``; None if no document has an id, a text and a language."""
    rows = sorted((r["lang"], bytes(r["bytes"])) for r in labelled_windows(docs, id, text, lang).collect())
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    x = np.concatenate([windows(b) for _, b in rows])
    return train(x, np.array([languages.index(name) for name, _ in rows]), languages)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and the mean probability of each text."""
    bodies = [t.encode("utf-8", "replace") if t and has_letter(t) else b"" for t in texts]
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    joined = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    counts = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(bodies)), counts)
    begin = starts[doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts))
    end = (starts + sizes)[doc]
    pooled = np.zeros((len(bodies), len(net.languages)))
    for k in range(0, len(doc), AT_ONCE):
        at = begin[k : k + AT_ONCE, None] + np.arange(WINDOW)
        x = np.where(at < end[k : k + AT_ONCE, None], joined[np.minimum(at, len(joined) - 1)], PAD)
        np.add.at(pooled, doc[k : k + AT_ONCE], net.letter_sums(x))
    total = pooled.sum(axis=1)
    best = pooled.argmax(axis=1)
    # rounded far below what decides, so that the order of sums does not show
    score = np.round(pooled[np.arange(len(bodies)), best] / np.maximum(total, 1e-30), 6)
    found = [net.languages[b] if n > 0 else UNKNOWN for b, n in zip(best, total)]
    return found, np.minimum(1.0, np.where(total > 0, score, 0.0)).tolist()


def identify(docs: DataFrame, net: Network | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = StructType([rows.schema["doc_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            found, scores = [], []
            # a few hundred texts at a time, whatever the batch holds
            for k in range(0, batch.num_rows, 256):
                own, p = predict(net, batch.column("text").slice(k, 256).to_pylist())
                found += own
                scores += p
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, kind)
