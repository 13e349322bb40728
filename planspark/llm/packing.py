"""Packing token ids into rows of fixed length, best fit decreasing (operator 3).

Documents are cut into pieces of at most ``length`` tokens, losslessly. Pieces
are dealt by hash over groups of about ``group_pieces`` pieces, and a group is
packed where its pieces arrive, in descending order of size: each goes to the
fullest row that has room, which a segment tree over free capacities finds in
logarithmic time. Ids are shuffled once; the number of groups follows from a
count of the pieces, or from a bound of it where ids are costly to make twice. A group that turns out twice as large as
meant (one row repeated very often) is closed and begun anew, so a task never
holds more than two groups' worth of ids.

A row holds ``ids`` (little-endian int32, padded), ``cu_seqlens`` (cumulative
segment lengths from 0), ``positions`` (restarting at 0 in every segment) and
the documents of its segments with their offsets.

Cases: null and empty lists of ids take no place; an id list longer than a row
is cut and every piece keeps its offset, so the list can be put together
again; repeated rows are packed each; null document ids are packed as such; an
empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

LENGTH = 2048
PAD = -1
#: Pieces per group, whatever the input's size: at most ``GROUP_PIECES * LENGTH`` ids of 4 bytes, 67 MB.
GROUP_PIECES = 8192


class FreeRooms:
    """Segment tree over capacities 1..length: which ones have a row with that much room left."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, taken out."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, row


def pieces_of(docs: DataFrame, id: str, ids: str, length: int) -> DataFrame:
    """``doc_id``, ``offset``, ``size``, ``ids`` of the pieces of every id list.

    ``ids`` is an array of integers or binary with little-endian int32 numbers, and the pieces are alike.
    """
    wide = isinstance(docs.schema[ids].dataType, BinaryType)
    size = ids_in(F.col("all_ids"), wide)
    starts = F.sequence(F.lit(0), F.floor((size - 1) / length).cast("int"))
    if wide:
        cuts = F.transform(starts, lambda k: F.substring("all_ids", k * (4 * length) + 1, F.lit(4 * length)))
    else:
        cuts = F.transform(starts, lambda k: F.slice("all_ids", k * length + 1, length))
    # a list that fits in a row is handed on as it is
    parts = F.when(size <= length, F.array("all_ids")).otherwise(cuts)
    return (
        docs.select(F.col(id).alias("doc_id"), F.col(ids).alias("all_ids"))
        .where(size > 0)
        .select("doc_id", F.posexplode(parts).alias("k", "ids"))
        .select("doc_id", (F.col("k") * length).alias("offset"), ids_in(F.col("ids"), wide).alias("size"), "ids")
    )


def ids_in(ids: Column, wide: bool) -> Column:
    return (F.octet_length(ids) / 4).cast("int") if wide else F.size(ids)


def numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """All ids of an Arrow column of lists or of binary, and the limits of its rows among them."""
    import pyarrow as pa

    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        _, ends, data = column.buffers()
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        limits = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data or b"", np.uint8)[limits[0] : limits[-1]].view("<i4"), (limits - limits[0]) // 4
    limits = np.asarray(column.offsets)
    return np.asarray(column.flatten()), limits - limits[0]


class Packer:
    """Rows of one group under way."""

    def __init__(self, length: int) -> None:
        self.length, self.rooms = length, FreeRooms(length)
        self.rows: list[list[tuple]] = []
        self.count = 0

    def put(self, doc: object, offset: int, part: np.ndarray) -> tuple[int, int]:
        """Place a piece; returns its row and its place there."""
        found = self.rooms.take(len(part))
        if found is None:
            found = self.length, len(self.rows)
            self.rows.append([])
        room, row = found
        self.rows[row].append((doc, offset, part))
        self.count += 1
        if room > len(part):
            self.rooms.add(room - len(part), row)
        return row, self.length - room

    def built(self, grp: int, batch: int, pad: int) -> Iterator[tuple]:
        for number, segments in enumerate(self.rows):
            row, where = np.full(self.length, pad, dtype="<i4"), np.zeros(self.length, dtype="<i4")
            ends = [0]
            for _, _, part in segments:
                stop = ends[-1] + len(part)
                row[ends[-1] : stop], where[ends[-1] : stop] = part, np.arange(len(part))
                ends.append(stop)
            docs, offsets = [s[0] for s in segments], [s[1] for s in segments]
            yield grp, batch, number, row.tobytes(), ends, where.tobytes(), docs, offsets, ends[-1]


def pack(
    docs: DataFrame, id: str = "doc_id", ids: str = "ids", length: int = LENGTH, pad: int = PAD, group_pieces: int = GROUP_PIECES,
    pieces: int | None = None,
) -> DataFrame:
    """One row per packed row, named by ``grp``, ``batch`` and ``row``:

    ``ids``, ``cu_seqlens``, ``positions``, ``doc_ids``, ``offsets``, ``n_tokens``.
    ``pieces`` is a number that the pieces do not exceed; without it they are counted.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    if pieces is None:
        wide = isinstance(docs.schema[ids].dataType, BinaryType)
        counts = docs.select(F.ceil(ids_in(F.col(ids), wide) / length).alias("n")).where("n > 0")
        pieces = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-pieces // group_pieces))
    out = StructType(
        [
            StructField("grp", LongType()), StructField("batch", LongType()), StructField("row", LongType()),
            StructField("ids", BinaryType()), StructField("cu_seqlens", ArrayType(IntegerType())),
            StructField("positions", BinaryType()), StructField("doc_ids", ArrayType(docs.schema[id].dataType)),
            StructField("offsets", ArrayType(IntegerType())), StructField("n_tokens", LongType()),
        ]
    )
    arrow = to_arrow_schema(out)

    def run(batches: Iterator):
        def shown(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        def closed():
            done: list[tuple] = []
            for row in packer.built(key, number, pad):
                done.append(row)
                if len(done) == 256:
                    yield shown(done)
                    done = []
            if done:
                yield shown(done)

        key, number, packer = None, 0, Packer(length)
        for batch in batches:
            values, limits = numbers(batch.column(3))
            limits = limits.tolist()
            for i, (grp, doc, offset) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if grp != key or packer.count >= 2 * group_pieces:
                    yield from closed()
                    number = number + 1 if grp == key else 0
                    key, packer = grp, Packer(length)
                # a copy, so that the batch need not be kept
                packer.put(doc, offset, values[limits[i] : limits[i + 1]].copy())
        yield from closed()

    return (
        pieces_of(docs, id, ids, length)
        .withColumn("grp", F.pmod(F.xxhash64("doc_id", "offset", "ids"), F.lit(groups)))
        .repartition("grp")
        .sortWithinPartitions("grp", F.desc("size"), "doc_id", "offset")
        .select("grp", "doc_id", "offset", "ids")
        .mapInArrow(run, out)
    )


def most_pieces(docs: DataFrame, text: str = "text", length: int = LENGTH) -> int:
    """A bound of the pieces of the texts: no token is shorter than a byte, but for one at the start of a text."""
    size = F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / length) + 1
    return docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


class Pieces:
    """Encodes texts word by word with a sentence-piece model that never joins words.

    A segment is a word with the spaces before it. No piece of such a model
    goes on after a space, so the ids of a text are those of its segments,
    which are made once and kept, up to ``CACHE_WORDS`` of them. New plain
    words are encoded many at a time, as texts that are cut where a word begins.
    """

    SEGMENT = re.compile(" *[^ ]+| +")
    CACHE_WORDS = 600_000
    TOGETHER = 64

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=model)
        pieces = [self.processor.id_to_piece(k) for k in range(self.processor.vocab_size())]
        self.apart = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        self.begins = np.array([p.startswith("\u2581") for p in pieces])
        one_word = [chr(c) for c in range(0x250) if self.words_in(f"a{chr(c)}b") == 1 and self.words_in(chr(c)) == 1]
        self.plain = re.compile(f"[{re.escape(''.join(one_word))}]+")
        self.space = np.array([pieces.index("\u2581")], "<i4").tobytes() if "\u2581" in pieces else b""
        self.known: dict[str, bytes] = {}

    def words_in(self, text: str) -> int:
        return int(self.begins[self.processor.encode(text)].sum())

    def segments(self, text: str) -> list[str]:
        """The segments of a text without the first space of each, which the processor puts there itself."""
        if not text:
            return []
        if "\u2581" in text:  # the sign for a space itself would join the spaces around it
            return [text]
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [s[1:] for s in self.SEGMENT.findall(" " + text)]
        return text.split(" ")

    def learn(self, words: list[str]) -> None:
        known, plain = self.known, [w for w in words if self.plain.fullmatch(w)]
        odd = set(words).difference(plain)
        for start in range(0, len(plain), self.TOGETHER * 64):
            groups = [plain[k : k + self.TOGETHER] for k in range(start, min(len(plain), start + self.TOGETHER * 64), self.TOGETHER)]
            found = self.processor.encode([" ".join(own) for own in groups], num_threads=1)
            for own, ids in zip(groups, found):
                ids = np.array(ids, dtype="<i4")
                limits = [4 * k for k in np.flatnonzero(self.begins[ids]).tolist()]
                if len(limits) != len(own):
                    odd.update(own)
                    continue
                data = ids.tobytes()
                known.update(zip(own, [data[a:b] for a, b in zip(limits, [*limits[1:], len(data)])]))
        odd = list(odd)
        for word, ids in zip(odd, self.processor.encode(odd, num_threads=1)):
            known[word] = np.array(ids, dtype="<i4").tobytes()
        known[""] = self.space

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian int32 numbers."""
        if not self.apart:
            return [np.array(ids, dtype="<i4").tobytes() for ids in self.processor.encode(texts, num_threads=1)]
        split = [self.segments(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if len(self.known) + len(new) > self.CACHE_WORDS:
            self.known = {}
            new = set(chain.from_iterable(split))
        if new:
            self.learn(list(new))
        found = self.known.__getitem__
        return [b"".join(map(found, own)) for own in split]


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", wide: bool = False) -> DataFrame:
    """``id`` and ``ids`` of every text by a sentence-piece model file; null counts as empty.

    ``ids`` is an array of integers, or with ``wide`` binary with little-endian int32 numbers.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    with open(path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = BinaryType() if wide else ArrayType(IntegerType())
    out = StructType([StructField(id, docs.schema[id].dataType), StructField("ids", kind)])

    def run(batches: Iterator):
        pieces = Pieces(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = pieces.encode([t or "" for t in part.column(1).to_pylist()])
                if wide:
                    ids = pa.array(found, pa.binary())
                else:
                    ends = np.cumsum([0, *[len(x) // 4 for x in found]], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id, "ids"])

    return docs.select(id, text).mapInArrow(run, out)


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; ``ids`` and ``positions`` are matrices' rows as little-endian int32."""
    rows.select("grp", "batch", "row", "ids", "cu_seqlens", "positions", "doc_ids", "offsets", "n_tokens").write.parquet(path)
