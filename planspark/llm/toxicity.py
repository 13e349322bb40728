"""Toxicity scores by gradient-boosted trees over dense features (operator 6).

The lexicon is learnt from labelled texts: words and word stems that occur in
many toxic and in hardly any other texts. Features are lexicon densities and
clustering, second-person words near lexicon words, capitals, punctuation and
obfuscation rates. The trees are fitted on histograms of a bounded sample of
labelled rows (``TRAIN_ROWS``); a part of the sample that the trees do not see
calibrates the scores by isotonic regression. All documents are then scored in
Arrow batches.

Cases: null texts count as empty; texts without words get a score as well;
labels repeated for one id count once, toxic if any says so; null labels are
left out; with no label, or labels of one kind only, every score is the share
of toxic labels (0 without labels); repeated rows get equal results; extra
columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planspark.llm.common import smallest_hashes
from planspark.session import cut

#: Most labelled rows that a model is fitted on; the rows with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
#: Most lexicon entries taken; the strongest ones.
LEXICON_TERMS = 3_000
#: An entry occurs in at least this many toxic texts, or this share of them; a word stands before that many different
#: words there, a stem begins that many: near copies of one text lend no further support to its words.
TEXTS_LEAST, OTHERS_LEAST, LEAST_SHARE = 2, 4, 0.005
#: Least log odds ratio of an entry.
LOG_ODDS = 3.0
STEM_SIZES = (4, 5, 6, 7, 8)
NEAR = 6
CALIBRATION_FOLD, CALIBRATION_FOLDS = 0, 4
THRESHOLD = 0.3

# Second-person words of the languages in the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner euch euer eure ihr tu te toi ton ta tes vous votre vos"
    " tú ti tuyo usted ustedes vosotros su".split()
)
LEET = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W_]+")
# starts at the first letter of a run only, and takes runs whole, so that plain words are passed over once
MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$!*.\-_]++[^\W\d_][\w@$!*.\-]*|[0-9@$]++[^\W\d_][\w@$!]*")
MARK_RUN = re.compile(r"[!?]{2,}")

FEATURES = (
    "words hits hit_rate kinds kind_rate close_hits near_second second_rate capitals capital_words exclaims questions"
    " marks mark_runs masked masked_hits long_runs digits"
).split()


def unmask(token: str) -> str:
    """Read digits and signs as the letters they stand for, drop other signs."""
    return "".join(c for c in token.translate(LEET) if c.isalpha())


def stems(word: str) -> Iterator[str]:
    """The word as an entry and its stems, marked as such."""
    yield word
    for n in STEM_SIZES:
        if len(word) > n:
            yield word[:n] + "~"


@dataclass
class Lexicon:
    """Words and stems; ``first`` holds their beginnings for a quick test."""

    entries: frozenset[str]
    first: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        self.first = frozenset(e.rstrip("~")[:4] for e in self.entries)

    def entry(self, word: str) -> str | None:
        """The longest stem of the word in the lexicon, or the word itself."""
        if word in self.entries:
            return word
        return next((s for n in STEM_SIZES if (s := word[:n] + "~") in self.entries and len(word) > n), None)


def long_runs(text: str) -> int:
    """Runs of one letter, three or more times."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    same = code[1:] == code[:-1]
    three = same[1:] & same[:-1]
    starts = np.flatnonzero(three & ~np.r_[False, three[:-1]]) if three.any() else []
    return sum(text[i].isalpha() for i in starts)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    raw = text or ""
    low = raw.lower()
    words = WORD.findall(low)
    n = max(1, len(words))
    first = lexicon.first
    found = [(i, e) for i, w in enumerate(words) if w[:4] in first and (e := lexicon.entry(w))]
    masked = MASKED.findall(low)
    masked_hits = sum(1 for t in masked if (w := unmask(t))[:4] in first and lexicon.entry(w))
    hits = len(found) + masked_hits
    kinds = len({e for _, e in found})
    spots = [i for i, _ in found]
    close = sum(1 for a, b in zip(spots, spots[1:]) if b - a <= NEAR)
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if spots and second:
        at = np.asarray(spots)
        k = np.searchsorted(at, np.asarray(second))
        gap = np.minimum(
            np.abs(at[np.minimum(k, len(at) - 1)] - second), np.abs(at[np.maximum(k - 1, 0)] - second)
        )
        near = int((gap <= NEAR).sum())
    size = max(1, len(raw))
    tokens = raw.split()
    shouted = sum(1 for t in tokens if len(t) > 2 and t.isupper())
    upper = sum(map(raw.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = sum(map(raw.count, ".,;:!?-*#"))
    return [
        np.log1p(len(words)), np.log1p(hits), hits / n, np.log1p(kinds), kinds / n, close / n, near / n,
        len(second) / n, upper / size, shouted / n, raw.count("!") / size, raw.count("?") / size, marks / size,
        len(MARK_RUN.findall(raw)) / n, len(masked) / n, masked_hits / n, long_runs(low) / n,
        sum(map(raw.count, "0123456789")) / size,
    ]


class Boosted:
    """Gradient-boosted regression trees on histograms, logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, leaf: float = 5.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf, self.ridge = trees, depth, rate, bins, leaf, ridge
        self.base = 0.0
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # rare values beyond the quantiles get cuts of their own
        cuts = [np.unique(np.r_[q, np.quantile(c[c > 0], np.linspace(0, 1, 17)[:-1])]) if (c > 0).any() else q for q, c in zip(cuts, x.T)]
        binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree, node = self._tree(binned, cuts, y - p, p * (1 - p))
            self.model.append(tree)
            score += tree[2][node]
        return self

    def _tree(self, binned, cuts, gradient, weight):
        """Grow level by level; arrays (feature, cut, value) over a full binary tree."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut_at, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(gradient), dtype=np.int64)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            if not len(rows):
                continue
            g, h = gradient[rows].sum(), weight[rows].sum()
            value[k] = self.rate * g / (h + self.ridge)
            if k >= 2**self.depth - 1 or len(rows) < 2 * self.leaf:
                continue
            best = (1e-6, -1, 0)
            for f, q in enumerate(cuts):
                if not len(q):
                    continue
                b = binned[rows, f]
                gs = np.cumsum(np.bincount(b, gradient[rows], len(q) + 1))[:-1]
                hs = np.cumsum(np.bincount(b, weight[rows], len(q) + 1))[:-1]
                ns = np.cumsum(np.bincount(b, minlength=len(q) + 1))[:-1]
                gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
                gain[(ns < self.leaf) | (len(rows) - ns < self.leaf)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at)
            if best[1] >= 0:
                feature[k], cut_at[k] = best[1], cuts[best[1]][best[2]]
                node[rows] = np.where(binned[rows, best[1]] <= best[2], 2 * k + 1, 2 * k + 2)
        return (feature, cut_at, value), node

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for feature, cut_at, value in self.model:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut_at[node], 2 * node + 1, 2 * node + 2)
                node = np.where(f >= 0, down, node)
            score += value[node]
        return score


def isotonic(raw: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots of a monotone map from raw scores to shares.

    Each pool is drawn towards the prior by one row's weight, so small pools
    do not claim certainty.
    """
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, sum of raw
    for r, t in zip(raw[order].tolist(), y[order].tolist()):
        pools.append([t, 1.0, r])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    shares = np.array([(s + prior) / (n + 1) for s, n, _ in pools])
    return np.array([r / n for _, n, r in pools]), np.maximum.accumulate(shares)


@dataclass
class Model:
    lexicon: Lexicon
    prior: float
    trees: Boosted | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.prior)
        raw = self.trees.raw(np.array([features(t, self.lexicon) for t in texts]))
        if self.knots is None:
            return 1 / (1 + np.exp(-raw))
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int) -> DataFrame:
    """``text``, ``y``, ``fold`` of at most ``rows`` labelled ids with the smallest hashes, one row each.

    Of several texts under one id, the one with the smallest hash counts.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id).isNotNull())
        .groupBy(F.col(id).alias("_id"))
        .agg((F.max(F.col(label)) > 0).cast("int").alias("y"))
    )
    chosen = smallest_hashes(chosen, "_id", rows)
    found = docs.select(F.col(id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    one = found.groupBy("_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"))
    return one.select(
        "text", "y", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(CALIBRATION_FOLDS)).cast("int").alias("fold")
    )


def learn_lexicon(sample: DataFrame, terms: int) -> Lexicon:
    """Entries counted by Spark over the fitting part of the sample; at most ``terms`` come back."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = (t or "").lower()
                words = WORD.findall(low)
                pairs = {*zip(words, [*words[1:], ""]), *((unmask(m), "") for m in MASKED.findall(low))}
                seen = {(s, n if s == w else w) for w, n in pairs if len(w) > 2 for s in stems(w)}
                rows += [(s, n, y, 0) for s, n in seen] if y else []
                rows += [(s, "", y, 1) for s in {s for s, _ in seen}]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["entry", "other", "y", "texts"]
            )

    fitting = sample.where(F.col("fold") != CALIBRATION_FOLD)
    toxic, all_rows = fitting.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    if not toxic or toxic == all_rows:
        return Lexicon(frozenset())
    share = int(LEAST_SHARE * toxic)
    counted = (
        fitting.select("text", "y")
        .mapInArrow(run, "entry string, other string, y int, texts int")
        .groupBy("entry", "other")
        .agg(
            F.sum(F.col("texts") * F.col("y")).alias("bad"),
            F.sum("texts").alias("n"),
            F.max(F.col("y") * (1 - F.col("texts"))).alias("with_other"),
        )
        .groupBy("entry")
        .agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.sum("with_other").alias("others"))
        .where((F.col("bad") >= max(TEXTS_LEAST, share)) & (F.col("others") >= max(OTHERS_LEAST, share)))
    )
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (all_rows - toxic + 1))
    strong = counted.withColumn("odds", odds).where(F.col("odds") >= LOG_ODDS)
    taken = strong.orderBy(F.desc("odds"), "entry").limit(terms).select("entry").collect()
    return Lexicon(frozenset(r["entry"] for r in taken))


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = TRAIN_ROWS, terms: int = LEXICON_TERMS,
) -> Model:
    """Fit on a bounded sample: features are made by Spark, the trees on the driver."""
    import pyarrow as pa

    sample = cut(labelled_sample(docs, labels, id, text, label, rows))
    lexicon = learn_lexicon(sample, terms)

    def run(batches):
        for batch in batches:
            found = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.float64())), batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.int32())],
                names=["x", "y", "fold"],
            )

    got = sample.select("text", "y", "fold").mapInArrow(run, "x array<double>, y int, fold int").toPandas()
    if not len(got):
        return Model(lexicon, 0.0)
    # one order, whatever order the tasks ended in
    x, y, fold = np.array(got["x"].tolist(), dtype=float), got["y"].to_numpy(float), got["fold"].to_numpy()
    order = np.lexsort((y, *x.T))
    x, y, fold = x[order], y[order], fold[order]
    fitting = fold != CALIBRATION_FOLD
    prior = float(y.mean())
    if len(set(y[fitting].tolist())) < 2:
        return Model(lexicon, prior)
    trees = Boosted().fit(x[fitting], y[fitting])
    held = ~fitting
    knots = isotonic(trees.raw(x[held]), y[held], prior) if len(set(y[held].tolist())) == 2 else None
    return Model(lexicon, prior, trees, knots)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    out = StructType([StructField("doc_id", docs.schema[id].dataType), StructField("score", DoubleType())])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                scores = model.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id).alias("doc_id"), text).mapInArrow(run, out)


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "_score") -> DataFrame:
    """``docs`` with the score beside the other columns."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.score(texts.where(texts.notna(), None).tolist()))

    return docs.withColumn(name, scored(F.col(text)))
