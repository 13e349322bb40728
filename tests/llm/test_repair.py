"""Conversation repair against a plain dynamic program and a plain reading of the contract."""

import random
import re
from hashlib import sha256
from zlib import crc32

import pytest

from planspark.llm import repair
from planspark.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
CHOICE = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def best(rows):
    """(cost, audit, repaired lines) by the whole table of suffixes; rows are (role, text, must go, extra)."""

    def with_inserts(base):
        for _ in range(4):
            for s in base:
                t = CHOICE[s]
                c, a, o = base[t]
                base[s] = min(base[s], (c + 3, "I" + a, [NAMES[t] + ":", *o]))
        return base

    far = (10**9, "", [])
    v = with_inserts({"": (0, "", []), "s": far, "u": far, "a": (0, "", [])})
    for role, text, gone, extra in reversed(rows):
        base = {}
        for s in v:
            c, a, o = v[s]
            ways = [(c + 4, "D" + a, o)]
            if not gone:
                t = NEXT.get((s, role[:1]))
                if t:
                    c, a, o = v[t]
                    ways.append((c + extra, "K" + a, [f"{role}:{text}", *o]))
                t = CHOICE[s]
                c, a, o = v[t]
                ways.append((c + extra + 3, "R" + a, [f"{NAMES[t]}:{text}", *o]))
            base[s] = min(ways)
        v = with_inserts(base)
    return v[""]


def plain_report(rows):
    """The report over (conv_id, turn, role, text) rows."""
    out, damaged = {}, {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in damaged.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, *_ in own if t is not None]
        n = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        seen, lattice = set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            lattice.append((role, text, fault in ("blank", "duplicate"), 3 * (fault == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = best(lattice)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *n.values(), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


CODES = repair.INITIALS + repair.UNFINISHED_CODES + repair.GONE_CODES


def code_rows(codes):
    return [("suax"[CODES.index(c) % 4], c, c in repair.GONE_CODES, 3 * (c in repair.UNFINISHED_CODES)) for c in codes]


def test_the_auction_finds_the_least_edits():
    dice = random.Random(2)
    for _ in range(1500):
        codes = "".join(dice.choice(CODES + "uauaua") for _ in range(dice.randrange(1, 14)))
        edits, cost, state = repair.solve(codes, None, (0,))[0]
        assert (cost, edits) == best(code_rows(codes))[:2] and state in repair.ENDS
        by_row, last = repair.edits_by_row(codes, edits, 0)
        assert last == state and "".join(e[::2] for e in by_row) == edits and len(by_row) == len(codes)


def test_prices_are_an_optimal_dual():
    dice = random.Random(3)
    for _ in range(50):
        codes = "".join(dice.choice(CODES) for _ in range(30))
        auction = repair.Auction(codes, {0: 0, 3: 0}, True)
        cost = auction.cost(0)
        assert all(auction.price[v] <= c + auction.price[j] for v, out in enumerate(auction.arcs) if auction.live[v] for _, c, j in out)
        assert auction.price[0] - auction.price[auction.sink] == cost


def text(k):
    return ["Whole sentence.", "cut off", "", " \n ", "Ends! ", "x" * 40000 + "?", "Why?", "so. not"][k]


@pytest.fixture(scope="module")
def conversations():
    dice = random.Random(4)
    rows = [
        (c, dice.choice([None, *range(9)]), dice.choice(["user", "assistant", "system", "tool", "", None]), text(dice.randrange(5)))
        for c in range(60)
        for _ in range(dice.randrange(1, 7))
    ]
    rows += [(100, k, ("user", "assistant")[k % 2] if k % 7 else "tool", text(dice.randrange(8)) + f" {k}.") for k in range(150)]
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", None), (101, None, "user", "Only."), (101, None, "user", "Only.")]
    return rows


@pytest.mark.parametrize("block", [4, repair.BLOCK])
def test_report(spark, conversations, block):
    schema = "conv_id long, turn long, role string, text string, conv string, pos long, fault string, edits string"
    table = spark.createDataFrame([(*r, "c", 1, "f", "e") for r in conversations], schema)
    parts = repair.repair(repair.damage(table), block=block)
    got = {r[0]: tuple(r)[1:] for r in repair.report(table, *parts).collect()}
    assert got == plain_report(conversations)


def test_cases_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert repair.report(empty, *repair.repair(repair.damage(empty))).count() == 0
    dropped = next(k for k in range(1000) if crc32(f"{k}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Gone.")], schema)
    got = repair.report(one, *repair.repair(repair.damage(one))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, sf).collect()}
    assert got == plain_report(rows)
