"""Conversation structure repair by an auction over the edit lattice (operator 12).

A conversation is repaired by keeping, re-roling, deleting and inserting turns
so that the initials of its roles read ``(s?(ua)+)?``. Its lattice has a node
for each (row, automaton state) and an integer cost on each edit. Nodes carry
prices, from zero; a path grows from the entry node. While the last node's
price is below the cheapest way on, the price is raised to it and the path
contracts by one node; otherwise the path is extended. When it reaches the
sink, the prices are an optimal dual: every cheapest path runs along arcs
whose cost equals the difference of prices. Among these tight arcs the edits
are traced by their least initials.

Rows are numbered by a range partition with carried totals and cut into blocks
of ``BLOCK`` rows; a block is one short string of codes, texts stay behind.
Where a conversation has more than one block, the least costs between the
states at both ends of each block (again by auction) are chained backward into
the prices of the block's sink, so blocks are solved apart however long the
conversation is. Only what grows with rows / ``BLOCK`` meets per conversation,
and its edits as one letter a row, which are the result.

Cases: null roles and texts are one space; null turns come first, rows of one
turn by role and text; null ids are one conversation; of equal rows the first
stays; repeated rows are duplicates; a conversation without rows gets no edits;
an empty table gives an empty result; extra columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planspark.llm.common import SPACE
from planspark.operators.ordering import ranked
from planspark.session import cut

BLOCK = 32
DELETE, INSERT, REROLE, UNFINISHED = 4, 3, 3, 3
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; a conversation may end in 0 and 3.
STATES, ENDS = 4, (0, 3)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after a turn whose role is chosen: user, but assistant after a user.
CHOSEN = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: Codes of a row: its initial (x: none of the three) as it is, in capitals if the text is unfinished, as a digit if it must go.
INITIALS, UNFINISHED_CODES, GONE_CODES = "suax", "SUAX", "0123"


# The auction


def arcs_of(codes: str, inserts_at_end: bool) -> list[list[tuple[str, int, int]]]:
    """The arcs (letter, cost, node) of each node ``row * STATES + state``; the sink's are the caller's."""
    n = len(codes)
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range((n + 1) * STATES)]
    for i, code in enumerate(codes):
        gone = code in GONE_CODES
        extra = UNFINISHED if code in UNFINISHED_CODES else 0
        for s in range(STATES):
            out = arcs[i * STATES + s]
            out.append(("D", DELETE, (i + 1) * STATES + s))
            if not gone:
                to = KEPT.get((s, code.lower()))
                if to is not None:
                    out.append(("K", extra, (i + 1) * STATES + to))
                out.append(("R", REROLE + extra, (i + 1) * STATES + CHOSEN[s]))
    for i in range(n + inserts_at_end):
        for s in range(STATES):
            arcs[i * STATES + s].append(("I", INSERT, i * STATES + CHOSEN[s]))
    return arcs


class Auction:
    """Cheapest paths to one sink; prices stay feasible from one entry to the next."""

    def __init__(self, codes: str, sink: dict[int, int], inserts_at_end: bool):
        self.n, self.arcs = len(codes), arcs_of(codes, inserts_at_end)
        self.sink = len(self.arcs)
        for state, cost in sink.items():
            self.arcs[self.n * STATES + state].append(("", cost, self.sink))
        self.arcs.append([])
        self.price = [0] * (self.sink + 1)
        self.live = self._leads_on(tight=False)
        # arcs into nodes from which the sink cannot be reached would be priced up without end
        self.arcs = [[a for a in out if self.live[a[2]]] for out in self.arcs]

    def _leads_on(self, tight: bool) -> list[bool]:
        """The nodes from which the sink can be reached, along tight arcs only if so asked."""
        on = [False] * (self.sink + 1)
        on[self.sink] = True
        for i in range(self.n, -1, -1):
            row = range(i * STATES, (i + 1) * STATES)
            for _ in range(STATES):  # insertions lead from state to state within a row
                for v in row:
                    if not on[v]:
                        on[v] = any(on[j] and (not tight or self.price[v] == c + self.price[j]) for _, c, j in self.arcs[v])
        return on

    def cost(self, entry: int) -> int | None:
        """The least cost from an entry state to the sink, None if there is no way; makes the prices optimal for it."""
        if not self.live[entry]:
            return None
        price, arcs, path = self.price, self.arcs, [entry]
        while path[-1] != self.sink:
            at = path[-1]
            best, to = min((c + price[j], j) for _, c, j in arcs[at])
            if price[at] < best:
                price[at] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[entry] - price[self.sink]

    def trace(self, entry: int) -> tuple[str, int, int]:
        """The least edits among the cheapest from ``entry``, their cost within the rows, and the state they end in."""
        self.cost(entry)
        leads, at, letters, cost = self._leads_on(tight=True), entry, [], 0
        while True:
            letter, c, to = min(
                (x for x in self.arcs[at] if leads[x[2]] and self.price[at] == x[1] + self.price[x[2]]), key=lambda x: x[0]
            )
            if to == self.sink:
                return "".join(letters), cost, at % STATES
            letters.append(letter)
            cost, at = cost + c, to


@lru_cache(maxsize=1 << 16)
def between(codes: str) -> tuple[int | None, ...]:
    """The least costs between the states before and after a block, row by row."""
    found = [[None] * STATES for _ in range(STATES)]
    for end in range(STATES):
        auction = Auction(codes, {end: 0}, inserts_at_end=False)
        for entry in range(STATES):
            found[entry][end] = auction.cost(entry)
    return tuple(c for row in found for c in row)


@lru_cache(maxsize=1 << 16)
def solve(codes: str, sink: tuple[int | None, ...] | None, entries: tuple[int, ...]) -> tuple[tuple[str, int, int], ...]:
    """(edits, cost, last state) from each entry state; ``sink`` has the prices after the block, None if it is the last."""
    ends = dict.fromkeys(ENDS, 0) if sink is None else {s: c for s, c in enumerate(sink) if c is not None}
    auction = Auction(codes, ends, inserts_at_end=sink is None)
    return tuple(auction.trace(e) for e in entries)


def sinks(blocks: list[tuple[int | None, ...]], last: str) -> list[tuple[int | None, ...]]:
    """The sink prices of all blocks but the last, from the costs between the states of these blocks and the last one's codes."""
    auction = Auction(last, dict.fromkeys(ENDS, 0), inserts_at_end=True)
    after = tuple(auction.cost(s) for s in range(STATES))
    out = []
    for m in reversed(blocks):
        out.append(after)
        ways = [[m[s * STATES + e] + after[e] for e in range(STATES) if m[s * STATES + e] is not None and after[e] is not None] for s in range(STATES)]
        after = tuple(min(w) if w else None for w in ways)
    return out[::-1]


def edits_by_row(codes: str, letters: str, entry: int) -> tuple[list[str], int]:
    """The edits of each row as (letter, role) pairs, insertions before it included, after the last row those behind it."""
    out, own, state, row = [], "", entry, 0
    for letter in letters:
        if letter == "K":
            state = KEPT[state, codes[row].lower()]
            own += "Kx"
        elif letter == "D":
            own += "Dx"
        else:
            state = CHOSEN[state]
            own += letter + ROLES[state][0]
        if letter != "I":
            out.append(own)
            own, row = "", row + 1
    if own:
        out[-1] += own
    return out, state


# The tables


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv:turn`` mod 20: dropped, emptied, without stops, repeated, said by the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    rows = rows.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("_kind"),
    ).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"),
    ).drop("_copy")


def _key(conv: Column) -> Column:
    """Conversation ids as texts, so that null ids meet in joins."""
    return F.when(conv.isNull(), "-").otherwise(F.concat(F.lit("="), conv.cast("string")))


def with_faults(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``conv_id``, ``turn``, ``role``, ``text``, ``pos`` (from 1) and ``fault`` (blank, duplicate, truncated or null)."""
    named = rows.select(
        _key(F.col(conv)).alias("conv"),
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = cut(ranked(named, ["conv"], order, name="pos", bounded=False).withColumn("_digest", F.unhex(F.sha2("text", 256))))
    said = ["conv", "role", "_digest"]
    repeated = (
        placed.groupBy(*said).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    )
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(F.length(trimmed) == 0, "blank")
        .when(F.col("pos") > F.col("_first"), "duplicate")
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return placed.join(repeated, said, "left").withColumn("fault", fault).drop("_first", "_digest")


def blocks_of(faults: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv``, ``block``, ``codes`` (a character per row) and ``last``, the number of the conversation's last block."""
    at = F.greatest(F.lit(1), F.instr(F.lit(INITIALS), F.substring("role", 1, 1)))
    at = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), at).otherwise(4)
    codes = {None: INITIALS, "truncated": UNFINISHED_CODES}
    own = F.lit(GONE_CODES)
    for fault, letters in codes.items():
        own = F.when(F.col("fault").isNull() if fault is None else F.col("fault") == fault, letters).otherwise(own)
    coded = faults.select(
        "conv", F.floor((F.col("pos") - 1) / block).alias("block"), "pos", F.substring(own, at, F.lit(1)).alias("code")
    )
    strings = coded.groupBy("conv", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda r: r["code"]), "").alias("codes")
    )
    return strings.join(strings.groupBy("conv").agg(F.max("block").alias("last")), "conv")


_PATH = "array<struct<edits:string,cost:long,state:int>>"
_PRICES = "array<long>"


def solved(blocks: DataFrame) -> DataFrame:
    """``conv``, ``edits``, ``cost``, ``illegal`` and per row ``by_row`` (pos, edits) of each conversation."""
    import pyarrow as pa

    def matrices(batches: Iterator):
        for batch in batches:
            found = [list(between(c)) for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("block"), pa.array(found, pa.list_(pa.int64()))], names=["conv", "block", "m"]
            )

    def chain(batches: Iterator):
        for batch in batches:
            for conv, ms, last in zip(*[batch.column(c).to_pylist() for c in ("conv", "ms", "codes")], strict=True):
                prices = sinks([tuple(m["m"]) for m in ms], last)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([conv] * len(ms), pa.string()),
                        pa.array([m["block"] for m in ms], pa.int64()),
                        pa.array([list(p) for p in prices], pa.list_(pa.int64())),
                    ],
                    names=["conv", "block", "sink"],
                )

    def paths(batches: Iterator):
        kind = pa.list_(pa.struct([("edits", pa.string()), ("cost", pa.int64()), ("state", pa.int32())]))
        for batch in batches:
            out = []
            for block, codes, sink in zip(*[batch.column(c).to_pylist() for c in ("block", "codes", "sink")], strict=True):
                entries = (0,) if block == 0 else tuple(range(STATES))
                out.append([dict(zip(("edits", "cost", "state"), p)) for p in solve(codes, None if sink is None else tuple(sink), entries)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("block"), batch.column("codes"), pa.array(out, kind)],
                names=["conv", "block", "codes", "paths"],
            )

    def compose(batches: Iterator):
        rows_kind = pa.list_(pa.struct([("pos", pa.int64()), ("edits", pa.string())]))
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                state, letters, cost, by_row, illegal, before = 0, [], 0, [], 0, ""
                for part in parts:
                    path = part["paths"][state]
                    own, _ = edits_by_row(part["codes"], path["edits"], state)
                    by_row += [{"pos": len(by_row) + k + 1, "edits": e} for k, e in enumerate(own)]
                    letters.append(path["edits"])
                    cost, state = cost + path["cost"], path["state"]
                    initials = before + part["codes"].lower().translate(str.maketrans(GONE_CODES, INITIALS))
                    illegal += sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
                    before = initials[-1]
                out.append(("".join(letters), cost, illegal, by_row))
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), rows_kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["conv", "edits", "cost", "illegal", "by_row"],
            )

    blocks = cut(blocks)
    inner = blocks.where("block < last").select("conv", "block", "codes").mapInArrow(matrices, "conv string, block long, m array<long>")
    ends = blocks.where("block = last AND last > 0").select("conv", "codes")
    chained = inner.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("ms")).join(ends, "conv")
    priced = chained.select("conv", "ms", "codes").mapInArrow(chain, f"conv string, block long, sink {_PRICES}")
    tried = (
        blocks.join(priced, ["conv", "block"], "left")
        .select("conv", "block", "codes", "sink")
        .mapInArrow(paths, f"conv string, block long, codes string, paths {_PATH}")
    )
    whole = tried.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "codes", "paths"))).alias("parts"))
    return whole.mapInArrow(compose, "conv string, edits string, cost long, illegal long, by_row array<struct<pos:long,edits:string>>")


def repaired_turns(faults: DataFrame, repairs: DataFrame) -> DataFrame:
    """One row per edit: ``conv``, ``conv_id``, ``pos``, ``step``, ``edit``, ``role``, ``text``; deleted turns keep theirs."""
    by_row = repairs.select("conv", F.explode("by_row").alias("r")).select("conv", "r.pos", "r.edits")
    steps = F.sequence(F.lit(1), F.length("edits"), F.lit(2))
    pairs = F.transform(steps, lambda k: F.struct(F.substring("edits", k, F.lit(2)).alias("e")))
    rows = faults.join(by_row, ["conv", "pos"]).select("conv", "conv_id", "pos", "role", "text", F.posexplode(pairs).alias("step", "p"))
    edit, chosen = F.substring("p.e", 1, 1), F.substring("p.e", 2, 1)
    role = F.when(chosen == "u", "user").when(chosen == "a", "assistant").otherwise(F.col("role"))
    text = F.when(edit == "I", "").otherwise(F.col("text"))
    return rows.select("conv", "conv_id", "pos", "step", edit.alias("edit"), role.alias("role"), text.alias("text"))


def text_digests(turns: DataFrame) -> DataFrame:
    """``conv`` and the sha256 of ``role:text`` of its remaining turns, joined by line feeds.

    A digest is made in one pass over its conversation in order; only the state of the hash is held.
    """
    import pyarrow as pa

    def run(batches: Iterator):
        from hashlib import sha256

        held, state = None, None
        for batch in batches:
            done = []
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if conv != held:
                    if state is not None:
                        done.append((held, state.hexdigest()))
                    held, state = conv, sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["conv", "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([state.hexdigest()])], names=["conv", "digest"])

    lines = turns.where("edit <> 'D'").select("conv", "pos", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    return (
        lines.repartition("conv")
        .sortWithinPartitions("conv", "pos", "step")
        .select("conv", "line")
        .mapInArrow(run, "conv string, digest string")
    )


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK):
    """The rows with their faults, the repair of each conversation, and the turns after it."""
    faults = cut(with_faults(rows, conv, turn, role, text))
    repairs = cut(solved(blocks_of(faults, block)))
    return faults, repairs, repaired_turns(faults, repairs)


def report(ids: DataFrame, faults: DataFrame, repairs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per id in ``ids`` (``conv_id``): gaps, counts of faults, cost, edits and digest of the repaired turns."""
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    counts = faults.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    from hashlib import sha256

    found = (
        ids.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
        .join(counts, "conv", "left")
        .join(repairs.select("conv", "illegal", "cost", F.col("edits").alias("audit")), "conv", "left")
        .join(text_digests(turns), "conv", "left")
    )
    zero = F.lit(0).cast("long")
    return found.select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
