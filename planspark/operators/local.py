"""What a bounded chunk of rows settles on its own, before rounds of joins link the chunks.

Spark lays the rows out; a task takes ``CHUNK`` rows at a time and never holds
more. Chunks only shorten the work: links that leave a chunk are left to the
rounds, so the result does not depend on where chunks end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planspark.session import cut, shuffled

#: Rows that a task looks at together, and their bytes, about.
CHUNK, CHUNK_BYTES = 1 << 16, 1 << 26
#: Rows of a group that a task settles whole.
GROUP = 1 << 10

_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.StringType)


def plain(kind: T.DataType) -> bool:
    """Whether equal values and their order are the same here and in Spark: whole numbers, texts and structs of them."""
    if isinstance(kind, T.StructType):
        return all(plain(f.dataType) for f in kind)
    return isinstance(kind, _PLAIN)


def _in_chunks(work: Callable, columns: Sequence[str], keys: Sequence[str] = ()) -> Callable:
    """``work`` over chunks of the batches; a chunk reaches it as one array per column.

    The rows at the end of a chunk that have the same ``keys`` wait for the next
    one, so where rows come group by group, only a group larger than a chunk is cut.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        held, rows = [], 0

        def done(table):
            table = table.combine_chunks()
            return work([table.column(c).combine_chunks() if table.num_rows else None for c in columns])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                table, upto = pa.Table.from_batches(held), rows
                if keys:
                    number = _numbers([table.column(k).combine_chunks() for k in keys])
                    upto = int(np.append(np.flatnonzero(number != number[-1]), -1).max()) + 1 or rows
                yield done(table.slice(0, upto))
                held, rows = table.slice(upto).combine_chunks().to_batches(), rows - upto
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def _flat(arrays: list) -> list:
    """The arrays with structs replaced by their fields."""
    import pyarrow as pa

    out = []
    for a in arrays:
        out += _flat(a.flatten()) if pa.types.is_struct(a.type) else [a]
    return out


def _numbers(arrays: list) -> np.ndarray:
    """One number per row, equal for equal rows."""
    number = None
    for a in _flat(arrays):
        code = a.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if number is None:
            number = code
        else:
            number = np.unique(number * (int(code.max()) + 1) + code, return_inverse=True)[1].reshape(-1)
    return number


def _places(arrays: list) -> np.ndarray:
    """The place of each row in ascending order of the arrays, nulls first."""
    import pyarrow as pa
    import pyarrow.compute as pc

    flat = _flat(arrays)
    table = pa.table({f"c{i}": a for i, a in enumerate(flat)})
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names], null_placement="at_start").to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place


def _whole(arrays: list) -> np.ndarray:
    """Rows without a null."""
    return ~np.logical_or.reduce([a.is_null().to_numpy(zero_copy_only=False) for a in arrays])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each number's part, of ``n`` numbers linked by a-b."""
    parent = np.arange(n)
    while True:
        up = parent[parent]
        if not np.array_equal(up, parent):
            parent = up
            continue
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def forest(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fewer links (keys, ``u``, ``v``) that hold the same nodes together, at most one per node of a chunk.

    Rows with a null link nothing and are left out.
    """
    keys = list(keys)
    links = links.select(*keys, "u", "v").dropna("any")
    if not all(plain(f.dataType) for f in links.schema):
        return links
    names = [*keys, "u", "v"]

    def work(arrays: list):
        import pyarrow as pa

        *at, u, v = arrays
        n = len(u)
        number = _numbers([*[pa.concat_arrays([k, k]) for k in at], pa.concat_arrays([u, v])])
        a, b = number[:n], number[n:]
        root = _roots(int(number.max()) + 1, a, b)
        node, first = np.unique(number, return_index=True)
        moved = node[root[node] != node]
        spot = np.zeros(len(root), dtype=np.int64)
        spot[node] = first
        nodes = pa.concat_arrays([u, v])
        one, other = spot[moved], spot[root[moved]]
        return pa.RecordBatch.from_arrays(
            [*[k.take(pa.array(one % n)) for k in at], nodes.take(pa.array(one)), nodes.take(pa.array(other))], names=names
        )

    return links.mapInArrow(_in_chunks(work, names), links.schema)


def closed_cycles(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``links`` (keys, ``id``, ``nxt``) with ``cycle`` and ``pos`` where a chunk holds the whole cycle, else null.

    ``nxt`` is kept for the other rows only.
    """
    keys = list(keys)
    names = [*keys, "id", "nxt"]
    links = links.select(*names)
    id_ = links.schema["id"].dataType
    schema = T.StructType(
        [*[T.StructField(f.name, f.dataType) for f in links.schema], T.StructField("cycle", id_), T.StructField("pos", T.LongType())]
    )

    def work(arrays: list):
        import pyarrow as pa

        *at, ids, nxt = arrays
        n = len(ids)
        number = _numbers([*[pa.concat_arrays([k, k]) for k in at], pa.concat_arrays([ids, nxt])])
        a, b = number[:n], number[n:]
        row = np.full(int(number.max()) + 1, n)
        row[a] = np.arange(n)
        once = (np.bincount(a, minlength=len(row)) == 1) & (np.bincount(b, minlength=len(row)) == 1)
        # row n stands for whatever is not in the chunk, or in it twice
        ahead = np.r_[np.where(once[b] & once[a] & _whole(arrays), row[b], n), n]
        low = np.r_[_places([ids]), -1]
        own = low.copy()
        steps, span = np.zeros(n + 1, dtype=np.int64), 1
        while True:
            better = low[ahead] < low
            if not better.any():
                break
            steps = np.where(better, steps[ahead] + span, steps)
            low, ahead, span = np.where(better, low[ahead], low), ahead[ahead], span * 2
        low, steps = low[:n], steps[:n]
        whole = low >= 0
        size = np.bincount(low[whole], minlength=n)
        pos = np.where(steps == 0, 0, size[low] - steps)
        of_place = np.empty(n, dtype=np.int64)
        of_place[own[:n]] = np.arange(n)
        first = of_place[low]
        return pa.RecordBatch.from_arrays(
            [
                *at, ids, nxt.take(pa.array(np.arange(n), mask=whole)),
                ids.take(pa.array(first, mask=~whole)), pa.array(pos, mask=~whole),
            ],
            names=[*names, "cycle", "pos"],
        )

    return links.mapInArrow(_in_chunks(work, names, keys), schema)


# --- groups that a chunk holds whole ------------------------------------------------


def by_size(rows: DataFrame, keys: Sequence[str], weight: Column | None = None, limit: int = GROUP) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of groups of at most ``limit`` rows (or sum of ``weight``), and the others, if there are any.

    The others are the rows of larger groups and those whose keys have a null.
    """
    keys = list(keys)
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    null = " OR ".join(f"`{k}` IS NULL" for k in keys)
    large = cut(rows.groupBy(*keys).agg(amount.alias("__n")).where((F.col("__n") > limit) | F.expr(null)).select(*keys))
    if large.isEmpty():
        return rows, None
    small = rows.where(f"NOT ({null})").join(shuffled(large), keys, "left_anti")
    return small, rows.join(shuffled(large), keys).unionByName(rows.where(null))


def in_whole_groups(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable, schema: T.StructType, laid: bool = False, ordered: bool = False
) -> DataFrame:
    """``work(table, group)`` over chunks that hold groups whole, as ``schema``.

    ``table`` has the rows of a chunk in the order of (keys, ``order``),
    ``group`` their groups' numbers from 0. Groups must be small (``by_size``).
    ``laid``: a partition holds its groups whole already; ``ordered``: one after the other, too.
    """
    keys = list(keys)

    def groups(table) -> np.ndarray:
        number = _numbers([table.column(k).combine_chunks() for k in keys])
        return np.cumsum(np.r_[False, number[1:] != number[:-1]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, n, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n < CHUNK and size < CHUNK_BYTES:
                continue
            table = pa.Table.from_batches(held)
            group = groups(table)
            # the last group may go on
            upto = int(np.searchsorted(group, group[-1]))
            if upto:
                yield work(table.slice(0, upto), group[:upto])
            held, n, size = table.slice(upto).combine_chunks().to_batches(), table.num_rows - upto, 0
        if held:
            table = pa.Table.from_batches(held)
            yield work(table, groups(table))

    rows = rows if laid else rows.repartition(*keys)
    return (rows if ordered else rows.sortWithinPartitions(*keys, *order)).mapInArrow(run, schema)


def _firsts(group: np.ndarray) -> np.ndarray:
    """Positions where a group begins."""
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=np.int64)


def grown_doors(group: np.ndarray, box: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaders (rows) and bounds of the doors of every group; rows are leaves in order of (group, id).

    All groups go through the loop side by side: in a step the leader of each
    takes its first free near leaf, or the next free leaf leads.
    """
    lead = _firsts(group)
    group = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    door, took = box[:, lead].copy(), np.zeros(len(lead), dtype=bool)
    rest = np.ones(len(group), dtype=bool)
    rest[lead] = False
    rest = np.flatnonzero(rest)
    leaders, doors = [], []
    while len(rest):
        g = group[rest]
        a, b = door[:, g], box[:, rest]
        near = (a[0] - gap <= b[2]) & (a[2] + gap >= b[0]) & (a[1] - gap <= b[3]) & (a[3] + gap >= b[1])
        twin = ((a[0] == b[0]) & (a[2] == b[2])) | ((a[1] == b[1]) & (a[3] == b[3]))
        hit = np.flatnonzero(near & ~twin)
        hit = hit[_firsts(g[hit])]
        got = g[hit]
        alone = np.ones(len(lead), dtype=bool)
        alone[got] = False
        done = np.flatnonzero(alone & took)
        leaders.append(lead[done])
        doors.append(door[:, done])
        took[alone] = False
        nxt = _firsts(g)
        nxt = nxt[alone[g[nxt]]]
        new = g[nxt]
        lead[new], door[:, new] = rest[nxt], box[:, rest[nxt]]
        taken = box[:, rest[hit]]
        door[:2, got] = np.minimum(door[:2, got], taken[:2])
        door[2:, got] = np.maximum(door[2:, got], taken[2:])
        took[got] = True
        left = np.ones(len(rest), dtype=bool)
        left[hit] = left[nxt] = False
        rest = rest[left]
    return np.concatenate([*leaders, lead[took]]), np.concatenate([*doors, door[:, took]], axis=1)


def settled_doors(leaves: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Sliding doors of small groups: keys, ``id``, x1..y2, ``open``.

    ``leaves`` (keys, ``id``, x1..y2, whole numbers without nulls). Equal rows
    are one leaf, whose door comes once for each. The rows of a group in which
    different leaves have one id, or a leaf's ends are turned round, come back
    as they are, ``open``.
    """
    keys = list(keys)
    columns = ("id", "x1", "y1", "x2", "y2")
    leaves = leaves.select(*keys, *columns)

    def work(table, group: np.ndarray):
        import pyarrow as pa

        id_, *sides = (table.column(c).to_numpy() for c in columns)
        box = np.stack(sides)
        again = np.r_[False, (group[1:] == group[:-1]) & (id_[1:] == id_[:-1])]
        other = again & np.r_[False, (box[:, 1:] != box[:, :-1]).any(axis=0)]
        odd = np.zeros(int(group[-1]) + 1, dtype=bool)
        odd[group[other | (box[0] > box[2]) | (box[1] > box[3])]] = True
        is_open = odd[group]
        one = np.flatnonzero(~again & ~is_open)
        times = np.bincount(np.cumsum(~again) - 1)[np.cumsum(~again)[one] - 1]
        lead, door = grown_doors(group[one], box[:, one], gap)
        back = np.flatnonzero(is_open)
        rows = np.r_[np.repeat(one[lead], times[lead]), back]
        out = np.concatenate([np.repeat(door, times[lead], axis=1), box[:, back]], axis=1)
        flag = np.arange(len(rows)) >= len(rows) - len(back)
        held = table.select([*keys, "id"]).take(pa.array(rows)).combine_chunks()
        arrays = [c.combine_chunks() for c in held.columns]
        return pa.RecordBatch.from_arrays([*arrays, *[pa.array(v, pa.int64()) for v in out], pa.array(flag)], names=[*keys, *columns, "open"])

    schema = T.StructType([*leaves.schema.fields, T.StructField("open", T.BooleanType())])
    return in_whole_groups(leaves, keys, columns, work, schema)


def covered_sets(owner: np.ndarray, code: np.ndarray, size: np.ndarray, n: int, step: int = 1 << 20) -> np.ndarray:
    """Whether each of ``n`` sets lies in another one; of equal sets the one of largest ``size``, then the first, does not.

    Set ``owner[i]`` holds ``code[i]``, each once, in order of the sets. A set
    meets only the sets that hold its rarest code, ``step`` comparisons at a time.
    """
    uses = np.bincount(code)
    many = np.bincount(owner, minlength=n)
    start = np.cumsum(many) - many
    order = np.lexsort((code, uses[code], owner))
    rare = np.full(n, -1)
    rare[owner[order][_firsts(owner[order])]] = code[order][_firsts(owner[order])]
    holders = owner[np.argsort(code, kind="stable")]
    at = np.cumsum(uses) - uses
    held = np.sort(owner * len(uses) + code)
    gone = np.zeros(n, dtype=bool)
    asks = np.flatnonzero(many)
    block = np.cumsum(uses[rare[asks]] * many[asks]) // step
    for a in np.split(asks, _firsts(block)[1:]):
        times = uses[rare[a]]
        one = np.repeat(a, times)
        two = holders[spread(at[rare[a]], times)]
        equal = many[one] == many[two]
        loses = (size[one] < size[two]) | ((size[one] == size[two]) & (one > two))
        fits = (one != two) & (many[one] <= many[two]) & (~equal | loses)
        one, two = one[fits], two[fits]
        asked = code[spread(start[one], many[one])]
        key = np.repeat(two, many[one]) * len(uses) + asked
        found = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
        missing = np.zeros(len(one), dtype=bool)
        missing[np.repeat(np.arange(len(one)), many[one])[~found]] = True
        gone[one[~missing]] = True
    return gone


def spread(start: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``times[i]`` numbers from ``start[i]`` on, one run after the other."""
    ends = np.cumsum(times)
    return np.arange(int(times.sum())) + np.repeat(start - ends + times, times)


def settled_sets(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Point sets of small groups that lie in no other one: keys, ``id``, ``spots``, ``size``, ``open``.

    ``sets`` has keys, ``id``, ``spots`` (array of distinct x, y) and ``size``.
    Equal rows are one set and stay or go together. Rows of a group with a null
    or a number that is none, or with different sets of one id, come back ``open``.
    """
    keys = list(keys)
    names = [*keys, "id", "spots", "size"]
    sets = sets.select(*names)

    def work(table, group: np.ndarray):
        import pyarrow as pa
        import pyarrow.compute as pc

        n = table.num_rows
        ids, spots, size = (table.column(c).combine_chunks() for c in ("id", "spots", "size"))
        many = pc.fill_null(pc.list_value_length(spots), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        points = spots.flatten()
        x, y = (points.field(c).to_numpy(zero_copy_only=False) + 0.0 for c in (0, 1))
        row = np.repeat(np.arange(n), many)
        size_ = size.to_numpy(zero_copy_only=False)
        whole = _whole([*[table.column(k).combine_chunks() for k in keys], ids, spots]) & np.isfinite(size_)
        whole[row[~(np.isfinite(x) & np.isfinite(y) & ~points.is_null().to_numpy(zero_copy_only=False))]] = False
        # points in numbers, then each set's sorted numbers
        code = group[row]
        for v in (x, y):
            number = np.unique(v, return_inverse=True)[1].reshape(-1)
            code = np.unique(code * (len(v) + 1) + number, return_inverse=True)[1].reshape(-1)
        same_id = np.r_[False, (group[1:] == group[:-1]) & (_numbers([ids])[1:] == _numbers([ids])[:-1])]
        at = np.cumsum(many) - many
        alike = np.r_[False, (many[1:] == many[:-1]) & (size_[1:] == size_[:-1])]
        pair = np.flatnonzero(same_id & alike)
        mine, theirs = code[spread(at[pair], many[pair])], code[spread(at[pair - 1], many[pair])]
        alike[pair[np.repeat(np.arange(len(pair)), many[pair])[mine != theirs]]] = False
        odd = np.zeros(int(group[-1]) + 1, dtype=bool)
        odd[group[~whole | (same_id & ~alike)]] = True
        is_open = odd[group]
        one = ~same_id & ~is_open
        number = np.cumsum(one) - 1
        held = one[row]
        gone = np.zeros(n, dtype=bool)
        if held.any():
            used = np.unique(code[held], return_inverse=True)[1].reshape(-1)
            gone[~is_open] = covered_sets(number[row[held]], used, size_[one], int(one.sum()))[number[~is_open]]
        kept = table.filter(pa.array(~gone)).combine_chunks()
        arrays = [kept.column(c).combine_chunks() for c in names]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(is_open[~gone])], names=[*names, "open"])

    schema = T.StructType([*sets.schema.fields, T.StructField("open", T.BooleanType())])
    return in_whole_groups(sets, keys, ["id"], work, schema)
