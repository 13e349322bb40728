"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict
from hashlib import sha256

from xxhash import xxh64_intdigest

SPACE = "[\x20\x09-\x0d]"
PASSAGE = "the quick brown fox jumps over the lazy dog and then it sleeps until the morning comes again"

#: Rows that have given trouble: nulls, empty texts, ties, copies, repeated rows, a long text, odd characters.
ROWS = [
    (1, "Hello World, this is one line.\nAnd a second line here.\nshort"),
    (2, "hello world, this is one line.  \nOwn words of the second text"),
    (3, "Hello World, this is one line.\nAnd a second line here.\nshort"),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, f"Start {PASSAGE.upper()}, end. 1 2 3"),
    (8, "x" * 5000 + "\n" + "word " * 4000),
    (9, "Ünïcödé ßtraße ΑΣ Σ ǅ İ\x00\x1c\u2028 😀 'S we'RE 1234"),
    (9, "Ünïcödé ßtraße ΑΣ Σ ǅ İ\x00\x1c\u2028 😀 'S we'RE 1234"),
    (None, "Hello World, this is one line.\nAnd a second line here.\nshort"),
    (None, "a text without an id"),
    (10, "Hello  World, this is one line.\nAnd a second line here.\nshort"),
    (11, "a b"),
    (12, "<|startoftext|>tokens<|endoftext|> as text"),
    (13, "And a second line here.\nAnd a second line here.\n\nAnd a second line here."),
    (14, " ".join(f"tok{i}" for i in range(300))),
    (15, " ".join(f"tok{i}" for i in range(299)) + " other"),
]


def sha(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def low(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def last(doc_id):
    """Order of ids: null last."""
    return (doc_id is None, doc_id if doc_id is not None else 0)


def exact(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept) of (doc_id, text) rows."""
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), last(d), i))
    out = []
    for members in groups.values():
        members.sort()
        keep = rows[members[0][2]][0]
        out += [(rows[i][0], keep, len(members), k == 0) for k, (_, _, i) in enumerate(members)]
    return out


def kept_lines(rows: list[tuple], least: int = 10) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept text)."""
    key = lambda line: low(re.sub(rf"^{SPACE}+|{SPACE}+$", "", line))
    first: dict = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), (True, 10**30)), last(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < least or first[key(x)] == last(d)]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text or ""))


def leaks(rows: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, items)."""
    known = defaultdict(set)
    for i, t in items:
        ws = words(t)
        k = min(window, len(ws))
        for a in range(len(ws) - k + 1 if ws else 0):
            known[tuple(ws[a : a + k])].add(i)
    out = []
    for d, t in rows:
        ws, hit, found = words(t), set(), set()
        for k in {len(w) for w in known}:
            for a in range(len(ws) - k + 1):
                if (w := tuple(ws[a : a + k])) in known:
                    hit |= set(range(a, a + k))
                    found |= known[w]
        out.append((d, len(ws), len(hit), sorted(i for i in found if i is not None)))
    return out


def simhash(text: str | None, size: int = 3) -> int:
    ws = [w for w in re.split(f"{SPACE}+", low(text or "")) if w]
    parts = [" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] if len(ws) >= size else [" ".join(ws)] if ws else []
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows: list[tuple], radius: int = 2) -> list[tuple]:
    """(doc_id, fingerprint, component_id)."""
    fps = [simhash(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    ids = defaultdict(list)
    for k, (d, _) in zip(label, rows):
        ids[k] += [d] if d is not None else []
    return [(d, f"{fp:016x}", min(ids[k], default=None)) for (d, _), fp, k in zip(rows, fps, label)]


def judge(url: str | None, rules: list[tuple]) -> tuple:
    """(host, path, rule, verdict)."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = low(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
    fits = [
        (len(h) + len(p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))
