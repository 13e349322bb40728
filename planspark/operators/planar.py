"""What tasks settle for drawings with few lines, boxes, links or runs, many drawings at a time.

A task takes chunks of whole groups (``local.in_whole_groups``), so rows are
shuffled once. Large groups, and those with nulls, slanted lines or numbers
that are not whole, go by joins; the result does not depend on the way taken.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planspark.operators.local import _firsts, _numbers, _places, _roots, by_size, in_whole_groups, plain, spread
from planspark.session import cut

SEG = ("x1", "y1", "x2", "y2")
#: Rows of a group that a task settles whole, pairs looked at together, and coordinates up to which keys fit a number.
FEW, STEP, FAR = 1 << 12, 1 << 20, 1 << 30

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBER = (*_WHOLE, T.FloatType, T.DoubleType)


def few(rows: DataFrame, keys: Sequence[str], fine: Column, weight: Column | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` of groups of at most ``limit`` rows (or sum of ``weight``), laid out in whole groups and all ``fine``, and the others, if any."""
    keys, limit = list(keys), limit or FEW
    held = cut(rows.repartition(*keys))
    one = F.lit(1) if weight is None else weight
    small, large = by_size(held, keys, F.when(F.coalesce(fine, F.lit(False)), one).otherwise(limit + 1), limit)
    return (small, None) if large is None else (cut(small.repartition(*keys)), large)


def whole(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether keys and ends are of kinds that tasks can compare."""
    return all(plain(df.schema[k].dataType) for k in keys) and all(isinstance(df.schema[c].dataType, _WHOLE) for c in SEG)


def near_zero() -> Column:
    return F.greatest(*[F.abs(c) for c in SEG]) < FAR


def ends_known() -> Column:
    """No end is null or too far away."""
    known = F.lit(True)
    for c in SEG:
        known = known & F.col(c).isNotNull()
    return known & near_zero()


def _blocks(times: np.ndarray, step: int = STEP) -> list[np.ndarray]:
    """The positions of ``times`` in blocks of about ``step`` in all, those of nothing left out."""
    at = np.flatnonzero(times)
    if not len(at):
        return []
    return np.split(at, _firsts(np.cumsum(times[at]) // step)[1:])


def _once(*columns: np.ndarray) -> np.ndarray:
    """Positions of the rows that come first of their equals, in ascending order of the columns."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order[new]


def _ends(table) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype(np.int64) for c in SEG]


def _batch(table, keys: list[str], rows: np.ndarray, arrays: list, names: Sequence[str]):
    """``arrays`` beside the keys of ``rows``."""
    import pyarrow as pa

    at = pa.array(rows)
    held = [table.column(k).combine_chunks().take(at) for k in keys]
    return pa.RecordBatch.from_arrays([*held, *arrays], names=[*keys, *names])


def _fields(df: DataFrame, keys: Sequence[str]) -> list:
    return [df.schema[k] for k in keys]


# --- splitting -------------------------------------------------------------------------


def split_lines(group: np.ndarray, ends: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The pieces of lines along the axes between their crossings, each once: (row of a line of the group, ends)."""
    x1, y1, x2, y2 = np.minimum(ends[0], ends[2]), np.minimum(ends[1], ends[3]), np.maximum(ends[0], ends[2]), np.maximum(ends[1], ends[3])
    proper = np.flatnonzero((x1 != x2) | (y1 != y2))
    one = proper[_once(group[proper], x1[proper], y1[proper], x2[proper], y2[proper])]
    g, x1, y1, x2, y2 = group[one], x1[one], y1[one], x2[one], y2[one]
    if not len(one):
        return one, [x1, y1, x2, y2]
    flat = np.flatnonzero(y1 == y2)
    upright = np.flatnonzero(x1 == x2)
    upright = upright[np.lexsort((x1[upright], g[upright]))]
    low = int(x1.min())
    span = int(x2.max()) - low + 1
    place = g[upright] * span + x1[upright] - low
    first = np.searchsorted(place, g[flat] * span + x1[flat] - low, "left")
    times = np.searchsorted(place, g[flat] * span + x2[flat] - low, "right") - first
    lines, stops = [np.arange(len(one)), np.arange(len(one))], [np.where(y1 == y2, x1, y1), np.where(y1 == y2, x2, y2)]
    for at in _blocks(times):
        a, b = np.repeat(flat[at], times[at]), upright[spread(first[at], times[at])]
        hit = (y1[b] <= y1[a]) & (y1[a] <= y2[b])
        a, b = a[hit], b[hit]
        lines += [a, b]
        stops += [x1[b], y1[a]]
    line, stop = np.concatenate(lines), np.concatenate(stops)
    at = _once(line, stop)
    line, stop = line[at], stop[at]
    piece = np.flatnonzero(line[1:] == line[:-1])
    line, p, q = line[piece], stop[piece], stop[piece + 1]
    level = y1[line] == y2[line]
    out = [np.where(level, p, x1[line]), np.where(level, y1[line], p), np.where(level, q, x2[line]), np.where(level, y2[line], q)]
    at = _once(g[line], *out)
    return one[line[at]], [c[at] for c in out]


def split_small(lines: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The split edges (keys, x1..y2) of drawings with few lines, all along the axes, and the lines of the others."""
    keys = list(keys)
    straight = (F.col("x1") == F.col("x2")) | (F.col("y1") == F.col("y2"))
    small, large = few(lines.select(*keys, *SEG), keys, ends_known() & straight)

    def work(table, group: np.ndarray):
        import pyarrow as pa

        rows, ends = split_lines(group, _ends(table))
        return _batch(table, keys, rows, [pa.array(c, pa.int64()) for c in ends], SEG)

    schema = T.StructType([*_fields(lines, keys), *[T.StructField(c, T.LongType()) for c in SEG]])
    return in_whole_groups(small, keys, SEG, work, schema, laid=True), large


# --- walking round -------------------------------------------------------------------


def fans_small(edges: DataFrame, keys: Sequence[str], laid: bool = True) -> DataFrame:
    """``faces.half_edges`` of groups that lie whole in the partitions: keys, ``id``, ``nxt``, in the order of the groups."""
    keys = list(keys)

    def work(table, group: np.ndarray):
        import pyarrow as pa

        x1, y1, x2, y2 = _ends(table)
        swap = (x1 > x2) | ((x1 == x2) & (y1 > y2))
        x1, x2 = np.where(swap, x2, x1), np.where(swap, x1, x2)
        y1, y2 = np.where(swap, y2, y1), np.where(swap, y1, y2)
        one = _once(group, x1, y1, x2, y2)
        out = [np.concatenate([a[one], b[one]]) for a, b in ((x1, x2), (y1, y2), (x2, x1), (y2, y1))]
        row = np.concatenate([one, one])
        g, angle = group[row], np.arctan2((out[3] - out[1]).astype(float), (out[2] - out[0]).astype(float))
        order = np.lexsort((out[3], out[2], angle, out[1], out[0], g))
        row, g, out = row[order], g[order], [c[order] for c in out]
        new = np.r_[True, (g[1:] != g[:-1]) | (out[0][1:] != out[0][:-1]) | (out[1][1:] != out[1][:-1])] if len(row) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        before = np.arange(len(row)) - 1
        before[first] = np.r_[first[1:], len(row)] - 1
        edge = lambda cs: pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cs], names=list(SEG))
        return _batch(table, keys, row, [edge([out[2], out[3], out[0], out[1]]), edge([c[before] for c in out])], ["id", "nxt"])

    edge = T.StructType([T.StructField(c, T.LongType()) for c in SEG])
    schema = T.StructType([*_fields(edges, keys), T.StructField("id", edge), T.StructField("nxt", edge)])
    return in_whole_groups(edges, keys, SEG, work, schema, laid=laid)


def with_loose(walked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``walked`` (keys, face, pos, x1..y2; rows in the order of the groups) with ``loose``: the way back is in the same face."""
    keys = list(keys)
    names = [*keys, "face", "pos", *SEG]

    def work(table, group: np.ndarray):
        import pyarrow as pa

        x1, y1, x2, y2 = _ends(table)
        face = _numbers([table.column("face").combine_chunks()])
        swap = (x1 > x2) | ((x1 == x2) & (y1 > y2))
        a, b, c, d = np.where(swap, x2, x1), np.where(swap, y2, y1), np.where(swap, x1, x2), np.where(swap, y1, y2)
        order = np.lexsort((d, c, b, a, group))
        alike = np.ones(max(len(order) - 1, 0), dtype=bool)
        for v in (group, a, b, c, d, face):
            alike &= v[order[1:]] == v[order[:-1]]
        loose = np.zeros(len(order), dtype=bool)
        loose[order[1:][alike]] = loose[order[:-1][alike]] = True
        arrays = [table.column(n).combine_chunks() for n in names]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(loose)], names=[*names, "loose"])

    schema = T.StructType([*[walked.schema[n] for n in names], T.StructField("loose", T.BooleanType())])
    return in_whole_groups(walked.select(*names), keys, (), work, schema, laid=True, ordered=True)


def _edges_of(out: list) -> object:
    import pyarrow as pa

    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in out], names=list(SEG))


def _links_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    edge = T.StructType([T.StructField(c, T.LongType()) for c in SEG])
    return T.StructType([*_fields(df, keys), T.StructField("id", edge), T.StructField("nxt", edge)])


def loop_links_small(directed: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Links (keys, ``id``, ``nxt``) that cut walks at repeated vertices, of drawings with few edges, and the edges of the others.

    The edge that arrives for a visit of a vertex goes on with the one that left at the visit before.
    """
    keys = list(keys)
    small, large = few(directed.select(*keys, "face", "pos", *SEG), keys, ends_known() & F.col("pos").isNotNull() & F.col("face").isNotNull())

    def work(table, group: np.ndarray):
        ends, pos = _ends(table), table.column("pos").to_numpy()
        face = _numbers([table.column("face").combine_chunks()])
        walk = np.lexsort((pos, face, group))
        new = np.r_[True, (group[walk][1:] != group[walk][:-1]) | (face[walk][1:] != face[walk][:-1])]
        first = np.flatnonzero(new)
        before = np.arange(len(walk)) - 1
        before[first] = np.r_[first[1:], len(walk)] - 1
        arrives = np.empty(len(walk), dtype=np.int64)
        arrives[walk] = walk[before]
        visit = np.lexsort((pos, ends[1], ends[0], face, group))
        new = np.r_[True, np.logical_or.reduce([c[visit][1:] != c[visit][:-1] for c in (group, face, ends[0], ends[1])])]
        first = np.flatnonzero(new)
        before = np.arange(len(visit)) - 1
        before[first] = np.r_[first[1:], len(visit)] - 1
        one, two = arrives[visit], visit[before]
        return _batch(table, keys, one, [_edges_of([c[one] for c in ends]), _edges_of([c[two] for c in ends])], ["id", "nxt"])

    return in_whole_groups(small, keys, ("face", "pos"), work, _links_schema(directed, keys), laid=True), large


def border_links_small(borders: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Links (keys, ``id``, ``nxt``) of directed borders round their parts, of groups with few of them, and the borders of the others.

    Whoever arrives at a node leaves by the border before it, where that one leaves.
    """
    keys = list(keys)
    proper = (F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))
    small, large = few(borders.select(*keys, *SEG), keys, ends_known() & proper)

    def work(table, group: np.ndarray):
        ends = _ends(table)
        n = len(group)
        nx, ny = np.concatenate([ends[0], ends[2]]), np.concatenate([ends[1], ends[3]])
        fx, fy = np.concatenate([ends[2], ends[0]]), np.concatenate([ends[3], ends[1]])
        leaves = np.arange(2 * n) < n
        g, edge = np.concatenate([group, group]), np.concatenate([np.arange(n), np.arange(n)])
        order = np.lexsort((leaves, np.arctan2((fy - ny).astype(float), (fx - nx).astype(float)), ny, nx, g))
        new = np.r_[True, np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (g, nx, ny)])]
        first = np.flatnonzero(new)
        before = np.arange(2 * n) - 1
        before[first] = np.r_[first[1:], 2 * n] - 1
        one, two = order, order[before]
        met = ~leaves[one] & leaves[two]
        one, two = edge[one[met]], edge[two[met]]
        by = np.argsort(group[one], kind="stable")
        one, two = one[by], two[by]
        return _batch(table, keys, one, [_edges_of([c[one] for c in ends]), _edges_of([c[two] for c in ends])], ["id", "nxt"])

    return in_whole_groups(small, keys, SEG, work, _links_schema(borders, keys), laid=True), large


# --- points ---------------------------------------------------------------------------


def inside_rings(point: tuple, edge: tuple, times: np.ndarray, border: bool, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (point, ring) of points inside rings.

    ``point`` has (group, x, y) and ``edge`` (group, ring, x1..y2) in the order
    of (group, ring); a point counts ``times``, as equal points do together.
    """
    pg, px, py = point
    eg, ring, x1, y1, x2, y2 = edge
    start = _firsts(ring)
    if not len(start) or not len(pg):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    many = np.diff(np.r_[start, len(ring)])
    lx, ly = np.minimum.reduceat(np.minimum(x1, x2), start), np.minimum.reduceat(np.minimum(y1, y2), start)
    hx, hy = np.maximum.reduceat(np.maximum(x1, x2), start), np.maximum.reduceat(np.maximum(y1, y2), start)
    rg = eg[start]
    first = np.searchsorted(rg, pg, "left")
    rings = np.searchsorted(rg, pg, "right") - first
    points, owners = [], []
    for at in _blocks(rings, step):
        p, r = np.repeat(at, rings[at]), spread(first[at], rings[at])
        near = (px[p] >= lx[r]) & (px[p] <= hx[r]) & (py[p] >= ly[r]) & (py[p] <= hy[r])
        p, r = p[near], r[near]
        for part in _blocks(many[r], step):
            a, b = p[part], r[part]
            pair = np.repeat(np.arange(len(part)), many[b])
            e = spread(start[b], many[b])
            x, y = px[a][pair], py[a][pair]
            dx, dy = x2[e] - x1[e], y2[e] - y1[e]
            with np.errstate(divide="ignore", invalid="ignore"):
                side = x1[e] + (y - y1[e]) * dx / dy
            crosses = ((y1[e] > y) != (y2[e] > y)) & (x < side)
            cross = dx * (y - y1[e]) - dy * (x - x1[e])
            on = (cross == 0) & (x >= np.minimum(x1[e], x2[e])) & (x <= np.maximum(x1[e], x2[e])) & (y >= np.minimum(y1[e], y2[e])) & (y <= np.maximum(y1[e], y2[e]))
            odd = np.bincount(pair, weights=crosses, minlength=len(part)).astype(np.int64) * times[a] % 2 == 1
            met = np.bincount(pair, weights=on, minlength=len(part)) > 0
            held = odd | met if border else odd & ~met
            points.append(a[held])
            owners.append(b[held])
    if not points:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(points), start[np.concatenate(owners)]


def comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(comparable(f.dataType) for f in kind)
    return plain(kind) or isinstance(kind, _NUMBER)


def points_small(points: DataFrame, edges: DataFrame, keys: Sequence[str], owner: str, border: bool) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Points in rings of drawings that have few of both, with the points and the edges of the others; None if kinds do not fit.

    The first has keys, the points' columns and ``owner``; the others are None where there are no others.
    """
    keys = list(keys)
    rest = [c for c in points.columns if c not in keys]
    kinds = [points.schema[c].dataType for c in ("x", "y")] + [edges.schema[c].dataType for c in SEG]
    if not all(plain(points.schema[k].dataType) and points.schema[k].dataType == edges.schema[k].dataType for k in keys):
        return None
    if not (all(isinstance(k, _NUMBER) for k in kinds) and plain(edges.schema[owner].dataType) and all(comparable(points.schema[c].dataType) for c in rest)):
        return None
    spot = F.struct(*rest)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    at = lambda *cs: [F.col(c).cast("double").alias(n) for c, n in zip(cs, SEG)]
    asked = points.dropna(subset=[*keys, "x", "y"]).select(*keys, F.lit(True).alias("__point"), spot.alias("__p"), none(edges, owner).alias("__o"), *at("x", "y", "x", "y"))
    empty = F.lit(None).cast(asked.schema["__p"].dataType)
    listed = edges.dropna(subset=[*keys, owner]).select(*keys, F.lit(False).alias("__point"), empty.alias("__p"), F.col(owner).alias("__o"), *at(*SEG))
    fine = F.lit(True)
    for c in SEG:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c)
    small, large = few(asked.unionByName(listed), keys, fine)

    def work(table, group: np.ndarray):
        import pyarrow as pa

        is_point = table.column("__point").to_numpy().astype(bool)
        box = [table.column(c).to_numpy() for c in SEG]
        p, e = np.flatnonzero(is_point), np.flatnonzero(~is_point)
        owners, spots = table.column("__o").combine_chunks(), table.column("__p").combine_chunks()
        at = pa.array(p)
        number = _numbers([spots.take(at)]) if len(p) else np.zeros(0, dtype=np.int64)
        one = _once(group[p], number)
        order = np.lexsort((number, group[p]))
        same = np.r_[True, (group[p][order[1:]] != group[p][order[:-1]]) | (number[order[1:]] != number[order[:-1]])] if len(p) else np.zeros(0, dtype=bool)
        times = np.bincount(np.cumsum(same) - 1, minlength=len(one)) if len(p) else np.zeros(0, dtype=np.int64)
        q = p[one]
        code = _numbers([owners.take(pa.array(e))]) if len(e) else np.zeros(0, dtype=np.int64)
        by = np.lexsort((code, group[e]))
        e, code = e[by], code[by]
        ring = np.cumsum(np.r_[False, (group[e][1:] != group[e][:-1]) | (code[1:] != code[:-1])]) if len(e) else np.zeros(0, dtype=np.int64)
        a, b = inside_rings((group[q], box[0][q], box[1][q]), (group[e], ring, *[c[e] for c in box]), times, border)
        found = spots.take(pa.array(q[a]))
        held = [owners.take(pa.array(e[b]))] if owner not in rest else []
        return _batch(table, keys, q[a], [*found.flatten(), *held], [*rest, *([owner] if held else [])])

    schema = T.StructType([*_fields(points, keys), *_fields(points, rest), edges.schema[owner]])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    found = in_whole_groups(small, keys, ("__point",), work, schema, laid=True)
    if large is None:
        return found, None, None
    return found, large.where("__point").select(*keys, "__p.*"), large.where("NOT __point").select(*keys, F.col("__o").alias(owner), *SEG)


# --- doors at walls -------------------------------------------------------------------


def wall_stretches(door: tuple, edge: tuple, times: np.ndarray, step: int = STEP):
    """Where bands of boxes meet wall edges, block by block: (box, lo, hi) along the band.

    ``door`` has (group, flat, reach, x1..y2) and ``edge`` (group, ring, x1..y2) in the order of (group, ring). A box
    whose first corner lies inside a ring is met all along; boxes that are equal count ``times`` together.
    """
    dg, flat, reach, *box = door
    eg, ring, *ends = edge
    first = np.searchsorted(eg, dg, "left")
    many = np.searchsorted(eg, dg, "right") - first
    start, stop = np.where(flat, box[0], box[1]), np.where(flat, box[2], box[3])
    low, high = np.where(flat, box[1], box[0]), np.where(flat, box[3], box[2])
    for at in _blocks(many, step):
        d, e = np.repeat(at, many[at]), spread(first[at], many[at])
        f = flat[d]
        u1, v1, u2, v2 = (np.where(f, ends[i][e], ends[j][e]) for i, j in ((0, 1), (1, 0), (2, 3), (3, 2)))
        near = (np.maximum(v1, v2) >= low[d]) & (np.minimum(v1, v2) <= high[d])
        near &= (np.maximum(u1, u2) >= start[d] - reach[d]) & (np.minimum(u1, u2) <= stop[d] + reach[d])
        d, u1, v1, u2, v2 = (c[near] for c in (d, u1, v1, u2, v2))
        level = v1 == v2
        with np.errstate(divide="ignore", invalid="ignore"):
            one = np.where(level, u1, u1 + (np.maximum(low[d], np.minimum(v1, v2)) - v1) * (u2 - u1) / (v2 - v1))
            two = np.where(level, u2, u1 + (np.minimum(high[d], np.maximum(v1, v2)) - v1) * (u2 - u1) / (v2 - v1))
        yield d, np.minimum(one, two), np.maximum(one, two)
    held, _ = inside_rings((dg, box[0], box[1]), (eg, ring, *ends), times, False, step)
    yield held, start[held], stop[held]


def _at_walls(doors: DataFrame, edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None] | None:
    """Boxes and wall edges of drawings that have few, in whole groups, and the rest; None if kinds do not fit."""
    kinds = [doors.schema[c].dataType for c in SEG]
    if not (all(plain(doors.schema[k].dataType) and doors.schema[k].dataType == edges.schema[k].dataType for k in keys) and all(isinstance(k, _WHOLE) for k in kinds)):
        return None
    if not all(isinstance(edges.schema[c].dataType, _NUMBER) for c in SEG) or not plain(doors.schema["id"].dataType) or not plain(edges.schema["wall"].dataType):
        return None
    at = [F.col(c).cast("double").alias(c) for c in SEG]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    one = doors.dropna(subset=keys).select(*keys, F.lit(True).alias("__door"), F.col("id").alias("__id"), none(edges, "wall").alias("__wall"), *at)
    two = edges.dropna(subset=[*keys, "wall"]).select(*keys, F.lit(False).alias("__door"), none(doors, "id").alias("__id"), F.col("wall").alias("__wall"), *at)
    known = ends_known() & (~F.col("__door") | F.col("__id").isNotNull())
    for c in SEG:
        known = known & ~F.isnan(c)
    turned = F.col("__door") & ((F.col("x1") > F.col("x2")) | (F.col("y1") > F.col("y2")))
    return few(one.unionByName(two), keys, known & ~turned)


def fitted_small(doors: DataFrame, edges: DataFrame, keys: Sequence[str], shifts: Sequence[int], limit: int | None, extra: int, along_x: bool = False):
    """(keys, id, best) of the doors of drawings with few doors and walls: the first turn that meets a wall, and how far both ends go.

    ``edges`` has keys, ``wall`` and x1..y2. ``limit`` is how far a door reaches, by default its longer side and ``extra``.
    A door goes along its longer side, or along x.
    Also the keys of the other drawings, if there are any; None if kinds do not fit.
    """
    keys = list(keys)
    parts = _at_walls(doors, edges, keys)
    if parts is None:
        return None
    small, large = parts

    def work(table, group: np.ndarray):
        import pyarrow as pa

        is_door = table.column("__door").to_numpy().astype(bool)
        box = [table.column(c).to_numpy() for c in SEG]
        d, e = np.flatnonzero(is_door), np.flatnonzero(~is_door)
        ids, walls = table.column("__id").combine_chunks(), table.column("__wall").combine_chunks()
        code = _numbers([walls.take(pa.array(e))]) if len(e) else np.zeros(0, dtype=np.int64)
        by = np.lexsort((code, group[e]))
        e, code = e[by], code[by]
        ring = np.cumsum(np.r_[False, (group[e][1:] != group[e][:-1]) | (code[1:] != code[:-1])])[: len(e)]
        edge = (group[e], ring, *[c[e] for c in box])
        number = _numbers([ids.take(pa.array(d))]) if len(d) else np.zeros(0, dtype=np.int64)
        columns = (group[d], number, *[c[d] for c in box])
        one = _once(*columns)
        order = np.lexsort(columns[::-1])
        same = np.ones(len(order), dtype=bool)
        same[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns]) if len(order) > 1 else same[1:]
        times = np.bincount(np.cumsum(same) - 1, minlength=len(one)) if len(one) else np.zeros(0, dtype=np.int64)
        d, number = d[one], number[one]
        x1, y1, x2, y2 = (c[d] for c in box)
        wide, high = x2 - x1, y2 - y1
        flat = np.ones(len(d), dtype=bool) if along_x else wide > high
        reach = np.maximum(wide, high) + extra if limit is None else np.full(len(d), float(limit))
        # doors of one id are fitted together
        owner = np.cumsum(np.r_[False, (group[d][1:] != group[d][:-1]) | (number[1:] != number[:-1])])[: len(d)]
        first = _firsts(owner)
        n = len(first)
        turn, low, up = np.full(n, -1), np.full(n, np.inf), np.full(n, np.inf)
        for k, shift in enumerate(shifts):
            left = np.flatnonzero(turn[owner] < 0)
            if not len(left):
                break
            move = [np.where(flat[left], 0, shift), np.where(flat[left], shift, 0)]
            moved = [c[left] + move[i % 2] for i, c in enumerate((x1, y1, x2, y2))]
            start, stop = np.where(flat[left], moved[0], moved[1]), np.where(flat[left], moved[2], moved[3])
            most = reach[left]
            back_, ahead_ = np.full(n, np.inf), np.full(n, np.inf)
            for at, lo, hi in wall_stretches((group[d][left], flat[left], most, *moved), edge, times[left]):
                back = np.ceil(np.maximum(start[at] - hi, 0))
                fits = (lo <= stop[at]) & (back <= most[at])
                np.minimum.at(back_, owner[left][at][fits], back[fits])
                ahead = np.ceil(np.maximum(lo - stop[at], 0))
                fits = (hi >= start[at]) & (ahead <= most[at])
                np.minimum.at(ahead_, owner[left][at][fits], ahead[fits])
            met = np.isfinite(back_) | np.isfinite(ahead_)
            turn[met], low[met], up[met] = k, back_[met], ahead_[met]
        met = np.flatnonzero(turn >= 0)
        row = d[first[met]]
        far = lambda v: pa.array(np.where(np.isfinite(v[met]), v[met], 0).astype(np.int64), mask=~np.isfinite(v[met]))
        best = pa.StructArray.from_arrays([pa.array(turn[met].astype(np.int32), pa.int32()), far(low), far(up)], names=["turn", "low", "high"])
        return _batch(table, keys, row, [ids.take(pa.array(row)), best], ["id", "best"])

    best = T.StructType([T.StructField("turn", T.IntegerType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])
    schema = T.StructType([*_fields(doors, keys), T.StructField("id", doors.schema["id"].dataType), T.StructField("best", best)])
    found = in_whole_groups(small, keys, ("__door",), work, schema, laid=True)
    return found, None if large is None else large.select(*keys).distinct()


# --- masks ----------------------------------------------------------------------------


def slabs(runs: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """Runs (keys, owner, y, x0, x1) as boxes (keys, owner, y0, y1, x0, x1): equal runs of adjoining rows that come one after the other."""
    names = [*keys, owner, "y", "x0", "x1"]
    runs = runs.select(*names).dropna("any")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            number = _numbers([batch.column(c) for c in (*keys, owner, "x0", "x1")])
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (y[1:] != y[:-1] + 1)])
            last = np.r_[first[1:], len(y)] - 1
            at = pa.array(first)
            held = [batch.column(c).take(at) for c in (*keys, owner)]
            x0, x1 = (batch.column(c).take(at).cast(pa.int64()) for c in ("x0", "x1"))
            yield pa.RecordBatch.from_arrays([*held, pa.array(y[first]), pa.array(y[last]), x0, x1], names=[*keys, owner, "y0", "y1", "x0", "x1"])

    schema = T.StructType([*_fields(runs, [*keys, owner]), *[T.StructField(c, T.LongType()) for c in ("y0", "y1", "x0", "x1")]])
    return runs.mapInArrow(run, schema)


def common_small(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """(keys, a, b, c): common pixels of pairs of masks, in drawings with few of them; ``left`` and ``right`` have runs of ``a`` and ``b``.

    Also the keys of the other drawings, if there are any; None if kinds do not fit.
    """
    keys = list(keys)
    tables = (pairs.select(*keys, "a", "b"), left, right)
    same = all(len({t.schema[k].dataType.simpleString() for t in tables}) == 1 and plain(pairs.schema[k].dataType) for k in keys)
    named = all(plain(pairs.schema[c].dataType) and pairs.schema[c].dataType == t.schema[c].dataType for c, t in (("a", left), ("b", right)))
    if not same or not named or not all(isinstance(t.schema[c].dataType, _WHOLE) for t in (left, right) for c in ("y", "x0", "x1")):
        return None
    none = lambda c: F.lit(None).cast(pairs.schema[c].dataType).alias(c)
    box = ["y0", "y1", "x0", "x1"]
    empty = [F.lit(None).cast("long").alias(c) for c in box]
    rows = pairs.dropna(subset=[*keys, "a", "b"]).select(*keys, F.lit(0).alias("__of"), "a", "b", *empty)
    rows = rows.unionByName(slabs(left, keys, "a").select(*keys, F.lit(1).alias("__of"), "a", none("b"), *box))
    rows = rows.unionByName(slabs(right, keys, "b").select(*keys, F.lit(2).alias("__of"), none("a"), "b", *box))
    small, large = few(rows, keys, F.lit(True))

    def work(table, group: np.ndarray):
        import pyarrow as pa

        of = table.column("__of").to_numpy()
        pair, one, two = (np.flatnonzero(of == k) for k in range(3))
        a, b = table.column("a").combine_chunks(), table.column("b").combine_chunks()
        side = [table.column(c).to_numpy(zero_copy_only=False) for c in box]
        held = []
        for names_, rows_ in ((a, one), (b, two)):
            code = _numbers([names_.take(pa.array(np.r_[pair, rows_]))]) if len(pair) + len(rows_) else np.zeros(0, dtype=np.int64)
            asked, own = group[pair] * (len(table) + 1) + code[: len(pair)], group[rows_] * (len(table) + 1) + code[len(pair) :]
            by = np.argsort(own, kind="stable")
            own = own[by]
            first = np.searchsorted(own, asked, "left")
            held.append((asked, rows_[by], first, np.searchsorted(own, asked, "right") - first))
        (ka, ra, fa, na), (kb, rb, fb, nb) = held
        total = np.zeros(len(pair))
        for at in _blocks(na * nb):
            many = na[at] * nb[at]
            p = np.repeat(at, many)
            k = spread(np.zeros(len(at), dtype=np.int64), many)
            i, j = ra[fa[p] + k // nb[p]], rb[fb[p] + k % nb[p]]
            high = np.minimum(side[1][i], side[1][j]) - np.maximum(side[0][i], side[0][j]) + 1
            wide = np.minimum(side[3][i], side[3][j]) - np.maximum(side[2][i], side[2][j]) + 1
            total += np.bincount(p, weights=np.maximum(high, 0) * np.maximum(wide, 0), minlength=len(pair))
        # a pair that is listed twice counts twice
        rows_ = np.lexsort((kb, ka))
        new = np.r_[True, (ka[rows_][1:] != ka[rows_][:-1]) | (kb[rows_][1:] != kb[rows_][:-1])][: len(rows_)]
        total = np.bincount(np.cumsum(new) - 1, weights=total[rows_]) if len(rows_) else total
        at = pair[rows_[new]]
        met = total > 0
        at, total = at[met], total[met]
        return _batch(table, keys, at, [a.take(pa.array(at)), b.take(pa.array(at)), pa.array(total.astype(np.int64))], ["a", "b", "c"])

    schema = T.StructType([*_fields(pairs, [*keys, "a", "b"]), T.StructField("c", T.LongType())])
    found = in_whole_groups(small, keys, ("__of",), work, schema, laid=True)
    return found, None if large is None else large.select(*keys).distinct()


def rle_small(runs: DataFrame, keys: Sequence[str], height: int, limit: int) -> tuple[DataFrame, DataFrame | None] | None:
    """``masks.column_rle`` of masks of at most ``limit`` pixels, and the runs of the others; None if kinds do not fit."""
    keys = list(keys)
    names = ("y", "x0", "x1")
    if not all(plain(runs.schema[k].dataType) for k in keys) or not all(isinstance(runs.schema[c].dataType, _WHOLE) for c in names):
        return None
    inside = F.col("y").between(0, height - 1) & (F.col("x0") >= 0) & (F.col("x1") >= F.col("x0")) & (F.col("x1") < FAR)
    small, large = few(runs.select(*keys, *names), keys, inside, F.col("x1") - F.col("x0") + 1, limit)

    def work(table, group: np.ndarray):
        import pyarrow as pa

        y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in names)
        rows, begins, zeros, ones = [], [], [], []
        first = _firsts(group)
        many = np.add.reduceat(x1 - x0 + 1, first)
        upto = np.r_[first[1:], len(group)]
        for part in _blocks(many):  # whole masks
            a, b = first[part[0]], upto[part[-1]]
            wide = x1[a:b] - x0[a:b] + 1
            row = np.repeat(np.arange(a, b), wide)
            at = spread(x0[a:b], wide) * height + y[row]
            order = np.lexsort((at, group[row]))
            row, at = row[order], at[order]
            new = np.r_[True, group[row][1:] != group[row][:-1]]
            opens = np.flatnonzero(new | np.r_[True, at[1:] > at[:-1] + 1])
            close = np.r_[opens[1:], len(at)] - 1
            end = at[close] + 1
            before = np.r_[0, end[:-1]]
            before[new[opens]] = 0
            rows.append(row[opens])
            begins.append(at[opens])
            zeros.append(at[opens] - before)
            ones.append(end - at[opens])
        joined = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (rows, begins, zeros, ones)]
        return _batch(table, keys, joined[0], [pa.array(c, pa.int64()) for c in joined[1:]], ["start", "zeros", "ones"])

    schema = T.StructType([*_fields(runs, keys), *[T.StructField(c, T.LongType()) for c in ("start", "zeros", "ones")]])
    return in_whole_groups(small, keys, names, work, schema, laid=True), large


# --- links and boxes ------------------------------------------------------------------


def least_small(links: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(keys, ``u``, ``m``): the smallest node linked with ``u``, where that is another, of groups with few links; and the links of the others.

    ``links`` has keys, ``u``, ``v`` without nulls, of kinds that are ``plain``.
    """
    keys = list(keys)
    small, large = few(links.select(*keys, "u", "v"), keys, F.lit(True))

    def work(table, group: np.ndarray):
        import pyarrow as pa

        n = len(group)
        nodes = pa.concat_arrays([table.column(c).combine_chunks() for c in ("u", "v")])
        place = _places([nodes])
        name = _numbers([nodes])
        # nodes in the order of (group, id)
        low = np.full(int(name.max()) + 1, 2 * n)
        np.minimum.at(low, name, place)
        both = np.r_[group, group]
        _, number = np.unique(both * (2 * n) + low[name], return_inverse=True)
        number = number.reshape(-1)
        root = _roots(int(number.max()) + 1, number[:n], number[n:])
        spot = np.zeros(len(root), dtype=np.int64)
        spot[number] = np.arange(2 * n)
        moved = np.flatnonzero(root != np.arange(len(root)))
        one, other = spot[moved], spot[root[moved]]
        return _batch(table, keys, one % n, [nodes.take(pa.array(one)), nodes.take(pa.array(other))], ["u", "m"])

    schema = T.StructType([*_fields(links, keys), T.StructField("u", links.schema["u"].dataType), T.StructField("m", links.schema["u"].dataType)])
    return in_whole_groups(small, keys, (), work, schema, laid=True), large


def dropped_small(conflicts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """``rounds.greedy_dropped`` (keys, ``lose``) of groups with few conflicts, and the conflicts of the others; ids are ``plain``."""
    keys = list(keys)
    known = F.col("win").isNotNull() & F.col("lose").isNotNull()
    small, large = few(conflicts.select(*keys, "win", "lose"), keys, known)

    def work(table, group: np.ndarray):
        import pyarrow as pa

        n = len(group)
        nodes = pa.concat_arrays([table.column(c).combine_chunks() for c in ("win", "lose")])
        number = _once_each(np.r_[group, group], _numbers([nodes]))
        win, lose = number[:n], number[n:]
        gone = np.zeros(int(number.max()) + 1, dtype=bool)
        left = np.arange(n)
        while len(left):
            loses = np.zeros(len(gone), dtype=bool)
            loses[lose[left]] = True
            out = lose[left[~loses[win[left]]]]
            if not len(out):
                raise ValueError("conflicts without a first row")
            gone[out] = True
            left = left[~gone[lose[left]] & ~gone[win[left]]]
        spot = np.full(len(gone), -1)
        spot[lose] = np.arange(n)
        rows = spot[gone]
        return _batch(table, keys, rows, [nodes.take(pa.array(n + rows))], ["lose"])

    schema = T.StructType([*_fields(conflicts, keys), conflicts.schema["lose"]])
    return in_whole_groups(small, keys, (), work, schema, laid=True), large


def _once_each(*columns: np.ndarray) -> np.ndarray:
    """One number per row, equal for rows that are equal in all columns."""
    number = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        number = np.unique(number * (int(c.max()) + 1) + c, return_inverse=True)[1].reshape(-1)
    return number


def closed(group: np.ndarray, box: list[np.ndarray], gap: float | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The part of each box, and the bounds of all parts, when boxes that meet are joined until none do."""
    part = np.arange(len(group))
    while True:
        first = _firsts(group)
        upto = np.r_[first[1:], len(group)]
        after = np.repeat(upto, upto - first) - np.arange(len(group)) - 1
        a_, b_ = [], []
        for at in _blocks(after):
            a = np.repeat(at, after[at])
            b = spread(at + 1, after[at])
            wide = np.maximum(box[0][a], box[0][b]) - np.minimum(box[2][a], box[2][b])
            high = np.maximum(box[1][a], box[1][b]) - np.minimum(box[3][a], box[3][b])
            if gap is None:
                met = (box[2][a] > box[0][b]) & (box[2][b] > box[0][a]) & (box[3][a] > box[1][b]) & (box[3][b] > box[1][a])
            else:
                met = (wide <= gap) & (high <= gap)
            a_.append(a[met])
            b_.append(b[met])
        a, b = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (a_, b_))
        if not len(a):
            return part, box
        kept, number = np.unique(_roots(len(group), a, b), return_inverse=True)
        number = number.reshape(-1)
        bounds = [np.full(len(kept), v.max() if i < 2 else v.min()) for i, v in enumerate(box)]
        for i, v in enumerate(box):
            (np.minimum if i < 2 else np.maximum).at(bounds[i], number, v)
        part, group, box = number[part], group[kept], bounds


def closed_small(boxes: DataFrame, keys: Sequence[str], gap: float | None) -> tuple[DataFrame, DataFrame | None] | None:
    """``rects.close_boxes`` of groups with few boxes (keys, id, x1..y2, ``open``), and the boxes of the others; None if kinds do not fit.

    The rows of groups in which an id comes twice or a box is turned round come back as they are, ``open``.
    """
    keys = list(keys)
    boxes = boxes.select(*keys, "id", *SEG)
    if not all(plain(boxes.schema[c].dataType) for c in (*keys, "id")) or len({boxes.schema[c].dataType.simpleString() for c in SEG}) > 1:
        return None
    kind = boxes.schema["x1"].dataType
    if not isinstance(kind, (T.LongType, T.IntegerType)):
        return None
    small, large = few(boxes, keys, ends_known() & F.col("id").isNotNull())
    names = [*keys, "id", *SEG]

    def work(table, group: np.ndarray):
        import pyarrow as pa

        ids = table.column("id").combine_chunks()
        box = _ends(table)
        number = _numbers([ids])
        again = np.r_[False, (group[1:] == group[:-1]) & (number[1:] == number[:-1])]
        odd = np.zeros(int(group[-1]) + 1, dtype=bool)
        odd[group[again | (box[0] > box[2]) | (box[1] > box[3])]] = True
        is_open = odd[group]
        one, back = np.flatnonzero(~is_open), np.flatnonzero(is_open)
        part, bounds = closed(group[one], [c[one] for c in box], gap)
        first = one[np.unique(part, return_index=True)[1]]  # rows are in the order of ids
        rows = np.r_[first, back]
        ends = [pa.array(np.r_[v, c[back]]).cast(table.schema.field("x1").type) for v, c in zip(bounds, box)]
        flag = pa.array(np.arange(len(rows)) >= len(first))
        return _batch(table, keys, rows, [ids.take(pa.array(rows)), *ends, flag], ["id", *SEG, "open"])

    schema = T.StructType([*[T.StructField(n, boxes.schema[n].dataType) for n in names], T.StructField("open", T.BooleanType())])
    return in_whole_groups(small, keys, ("id",), work, schema, laid=True), large
