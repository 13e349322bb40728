"""BPE encoding and decoding with a contiguous rank array per word (operator 5).

A word is a row of parts; beside it lies the row of merge ranks of adjacent
parts. The smallest rank is looked up by scanning, its boundary is deleted and
the two neighbouring ranks are refreshed. The words that a slice of texts
brings are merged together, one array row each. Words longer than ``SHORT``
parts (long runs of letters or punctuation) keep their ranks in a heap over
linked parts instead, since scanning would be quadratic there; both give the
same parts. Each task keeps the encodings of the words it has met, up to
``CACHE_WORDS`` of them, so a frequent word is merged once.

Cases: null and empty texts have no tokens and an empty decoded text; strings
of special tokens inside a text become these tokens; a repeated row gives a
repeated result row; extra columns are left out of the result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

SHORT = 96
CACHE_WORDS = 400_000
SLICE_ROWS = 256
#: The Unicode property White_Space; Python's own class also holds U+001C to U+001F.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Letters, numbers and lower-case mappings of Unicode 16 and 17 that the library knows and Python's tables
#: may not yet; (first, last), and for the mappings (first, last, distance to the lower-case letter).
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
NEWER_LOWER = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
LOWER = {c: c + step for a, b, step in NEWER_LOWER for c in range(a, b + 1)}
FIRST_NEWER = chr(min(LOWER))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {b: chr(b) for b in kept}
    spare = 256
    for b in range(256):
        if b not in symbol:
            symbol[b] = chr(spare)
            spare += 1
    return [symbol[b] for b in range(256)]


@dataclass
class Vocabulary:
    ids: dict[str, int]
    tokens: list[str]
    merges: dict[int, tuple[int, int]]  # left id << 32 | right id -> (rank, id of the merged part)
    suffix: str
    special: dict[str, int]
    words: str
    symbols: list[str]

    @classmethod
    def parse(cls, content: str) -> "Vocabulary":
        """From a tokenizer file with word-end BPE, NFC and lower-casing, split by one pattern."""
        spec = json.loads(content)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed":
            raise ValueError("not a word-end BPE tokenizer file")
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in [*ids.items(), *special.items()]:
            tokens[i] = token
        return cls(ids, tokens, merges, model["end_of_word_suffix"] or "", special, split["pattern"]["Regex"], byte_symbols())


class RankArrays:
    """Merges many short words at once: one row of parts and one row of adjacent ranks per word.

    In each step the smallest rank of every row is found by scanning the row,
    its boundary is deleted from both rows, and the two neighbouring ranks are
    looked up again. Rows without a rank left are done.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, merges: dict[int, tuple[int, int]]) -> None:
        self.keys = np.array(sorted(merges), dtype=np.int64)
        self.rank = np.array([merges[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.made = np.zeros(int(self.rank.max(initial=0)) + 1, dtype=np.int64)
        for rank, made in merges.values():
            self.made[rank] = made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; a part below 0 is no part."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where((self.keys[at] == pair) & (left >= 0) & (right >= 0), self.rank[at], self.NONE)

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in words]
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            width = len(words[order[start]])
            end = start
            while end < len(order) and len(words[order[end]]) <= width + width // 2 + 2:
                end += 1
            rows = order[start:end]
            for i, parts in zip(rows, self._block([words[i] for i in rows])):
                out[i] = parts
            start = end
        return out

    def _block(self, words: list[list[int]]) -> list[list[int]]:
        n, width = len(words), max(2, max(map(len, words)) + 1)
        parts = np.full((n, width), -1, dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        parts[np.arange(width) < sizes[:, None]] = np.fromiter(chain.from_iterable(words), dtype=np.int64)
        done = parts.copy()
        found = self.ranks(parts[:, :-1], parts[:, 1:])
        live, column = np.arange(n), np.arange(width)
        while len(live):
            at = found.argmin(axis=1)
            best = found[np.arange(len(live)), at]
            open_ = best < self.NONE
            if not open_.all():
                done[live[~open_]] = parts[~open_]
                live, parts, found, at, best = live[open_], parts[open_], found[open_], at[open_], best[open_]
            if not len(live):
                break
            row = np.arange(len(live))
            parts[row, at] = self.made[best]
            parts[:, :-1] = np.where(column[:-1] > at[:, None], parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            found[:, :-1] = np.where(column[:-2] >= at[:, None], found[:, 1:], found[:, :-1])
            found[:, -1] = self.NONE
            found[row, at] = self.ranks(parts[row, at], parts[row, at + 1])
            inner = at > 0
            r, c = row[inner], at[inner]
            found[r, c - 1] = self.ranks(parts[r, c - 1], parts[r, c])
        keep = done >= 0
        flat, ends = done[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [flat[s:e] for s, e in zip([0, *ends], ends)]


def merge_long(parts: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """The same for long words: a heap of (rank, position) over linked parts."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (hit := merges.get(parts[i] << 32 | parts[j])):
            heapq.heappush(heap, (hit[0], i, parts[i], parts[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue
        parts[i] = merges[left << 32 | right][1]
        parts[j] = -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in parts if p >= 0]


def letters_and_digits(top: int) -> tuple[str, str]:
    """Regex ranges of the letters and of the numbers below code point ``top``."""
    found: dict[str, list[list[int]]] = {"L": [], "N": []}
    newer = {c: k for k, rows in (("L", NEWER_LETTERS), ("N", NEWER_NUMBERS)) for a, b in rows for c in range(a, b + 1)}
    for c in range(top):
        runs = found.get(newer.get(c) or unicodedata.category(chr(c))[0])
        if runs is not None:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    text = ["".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) for runs in found.values()]
    return text[0], text[1]


class Splitter:
    """The file's word pattern with its letter and number classes written out, which scans faster."""

    def __init__(self, pattern: str) -> None:
        self.pattern = pattern
        self.plain = self._compile(0x10000)
        self.wide: re.Pattern | None = None

    def _compile(self, top: int) -> re.Pattern:
        letters, numbers = letters_and_digits(top)
        filled = self.pattern.replace("\\p{L}", letters).replace("\\p{N}", numbers)
        return re.compile(filled.replace("\\s", WHITE))

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or max(text) < "\U00010000":
            return self.plain.findall(text)
        if self.wide is None:
            self.wide = self._compile(0x110000)
        return self.wide.findall(text)


class Encoder:
    """Encodes and decodes texts; keeps the parts of the words it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.split = Splitter(vocabulary.words)
        self.short = RankArrays(vocabulary.merges)
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.known: dict[str, tuple[int, str, str]] = {
            s: (1, str(i), s) for s, i in vocabulary.special.items()
        }
        self.always = dict(self.known)

    def symbols(self, word: str) -> list[int]:
        v = self.v
        found = [v.symbols[b] for b in word.encode("utf-8", "replace")]
        found[-1] += v.suffix
        return [v.ids[s] for s in found if s in v.ids]

    def learn(self, words: set[str]) -> None:
        """Merge words not met before; beyond ``CACHE_WORDS`` the older ones are forgotten."""
        if len(self.known) > CACHE_WORDS:
            self.known = dict(self.always)
        short, long = [], []
        for word in words:
            parts = self.symbols(word)
            (short if len(parts) <= SHORT else long).append((word, parts))
        merged = self.short.merge([p for _, p in short]) + [merge_long(p, self.v.merges) for _, p in long]
        tokens = self.v.tokens
        for (word, _), ids in zip(short + long, merged):
            self.known[word] = len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])

    def words(self, text: str | None) -> list[str]:
        """Normalised words, and special tokens as they stand.

        Special tokens are found before anything else; lower-casing goes
        character by character, so there is no final sigma.
        """
        if not text:
            return []
        if self.special and "<|" in text:
            pieces = self.special.split(text)
            return [w for k, p in enumerate(pieces) for w in ([p] if k % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if max(text, default="") >= FIRST_NEWER:
                text = text.translate(LOWER)
        return self.split(text.lower())

    def entries(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, str]]]:
        """For each text, (number of tokens, ids, tokens) of each of its words."""
        split = [self.words(t) for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = dict(self.always)
            new = {w for words in split for w in words if w not in self.known}
        if new:
            self.learn(new)
        for words in split:
            known = self.known
            yield [e for w in words if (e := known[w])[0]]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(i) for e in found for i in e[1].split()] for found in self.entries(texts)]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces; the file names no decoder."""
        return " ".join([self.v.tokens[i] for i in ids])

    def render(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of tokens, decimal ids joined by a space, and the decoded text."""
        return [
            (sum([e[0] for e in found]), " ".join([e[1] for e in found]), " ".join([e[2] for e in found]))
            for found in self.entries(texts)
        ]


def shared_vocabulary(df: DataFrame, path: str):
    """The tokenizer file as a broadcast: read by the driver once, of a size fixed by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def over_texts(
    df: DataFrame, path: str, id: str, text: str, schema: str, rows: Callable[[Encoder, list], Iterable[tuple]]
) -> DataFrame:
    """``rows(encoder, values of text)`` beside ``id`` for every row, in Arrow batches; one encoder per task."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    content = shared_vocabulary(df, path)
    out = StructType([StructField(id, df.schema[id].dataType), *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        encoder = Encoder(Vocabulary.parse(content.value))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                columns = zip(*rows(encoder, part.column(1).to_pylist()))
                arrays = [pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow[0].type), *arrays], schema=arrow)

    return df.select(id, text).mapInArrow(run, out)


def encode(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text: ``id``, ``ids`` (array<int>)."""
    return over_texts(df, path, id, text, "ids array<int>", lambda e, texts: [(x,) for x in e.encode(texts)])


def decode(df: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of token ids: ``id``, ``decoded``."""
    return over_texts(df, path, id, ids, "decoded string", lambda e, lists: [(e.decode(x or []),) for x in lists])


def digests(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of the ids and of the decoded text, made where the text is encoded."""

    def rows(e: Encoder, texts: list) -> Iterator[tuple]:
        for n, ids, decoded in e.render(texts):
            yield n, sha256(ids.encode()).hexdigest(), sha256(decoded.encode("utf-8", "replace")).hexdigest()

    return over_texts(df, path, id, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
