"""Scalar geometry as column expressions. Everything here stays inside codegen.

Pixels: one pixel is 10 mm, so area / 1e4 is in square metres and length / 1e2
in metres. Rounding is half to even (``rint``), truncation is a cast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]
EPS = 1e-5


class cols(Sequence):
    """Columns by name, looked up on use, so a box can be named before a session exists."""

    def __init__(self, names: str):
        self.names = names.split()

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, i):
        return F.col(self.names[i])


# --- model space to image ------------------------------------------------


@dataclass(frozen=True)
class Viewport:
    """A model-space range shown in the middle of an image, y pointing down."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column
    width: Column
    height: Column

    @classmethod
    def of(cls, prefix: str = "r", width: str = "img_w", height: str = "img_h") -> Viewport:
        return cls(*cols(f"{prefix}x1 {prefix}y1 {prefix}x2 {prefix}y2 {width} {height}"))

    @property
    def scale(self) -> Column:
        """Pixels per model unit: the side that fills the image decides."""
        wide, high = self.x2 - self.x1, self.y2 - self.y1
        return F.when(self.height / self.width > high / wide, self.width / wide).otherwise(
            self.height / high
        )

    def to_x(self, x: Column) -> Column:
        middle = (self.x2 + self.x1) / 2
        return F.rint(self.width / 2 + (x - middle) * self.scale).cast("long")

    def to_y(self, y: Column) -> Column:
        middle = (self.y2 + self.y1) / 2
        return self.height - F.rint(self.height / 2 + (y - middle) * self.scale).cast("long")

    def clip_x(self, x: Column) -> Column:
        px = self.to_x(x)
        return F.when(px.between(0, self.width), px)

    def clip_y(self, y: Column) -> Column:
        py = self.to_y(y)
        return F.when(py.between(0, self.height), py)

    def point(self, box: Box) -> dict[str, Column]:
        """A segment in pixels, end points in order; null when an end is outside."""
        ends = [self.clip_x(box[0]), self.clip_y(box[1]), self.clip_x(box[2]), self.clip_y(box[3])]
        inside = ends[0].isNotNull() & ends[1].isNotNull() & ends[2].isNotNull() & ends[3].isNotNull()
        return {n: F.when(inside, e) for n, e in zip(("x1", "y1", "x2", "y2"), ends)}

    def rect(self, box: Box) -> dict[str, Column]:
        """A rectangle in pixels with the y pair in order; null when outside."""
        p = self.point(box)
        return {
            "x1": p["x1"],
            "y1": F.least(p["y1"], p["y2"]),
            "x2": p["x2"],
            "y2": F.greatest(p["y1"], p["y2"]),
        }

    def padded_rect(self, box: Box, extend: int = 1) -> dict[str, Column]:
        r = self.rect(box)
        return {n: c - extend if n in ("x1", "y1") else c + extend for n, c in r.items()}

    def text(self, x: Column, y: Column) -> dict[str, Column]:
        """A text position: x and y are clipped on their own."""
        return {"x": self.clip_x(x), "y": self.clip_y(y)}


def mm_per_px(box: Box, width: float = 1600, height: float = 1280) -> Column:
    """Model units per pixel of an image of the given size."""
    wide, high = box[2] - box[0], box[3] - box[1]
    return F.when(F.lit(height) / F.lit(width) > high / wide, wide / F.lit(width)).otherwise(
        high / F.lit(height)
    )


def pdf_zoom(box: Box, unit: float = 10, width: float = 1684, height: float = 1191) -> Column:
    """Zoom that prints a paper box at ``unit`` mm per pixel on a 1684 x 1191 page."""
    return mm_per_px(box, width, height) / F.lit(unit)


# --- rectangles ----------------------------------------------------------


def rect_inside(inner: Box, outer: Box) -> Column:
    """``inner`` lies within ``outer``, borders included."""
    return (
        (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])
    )


def rects_overlap(a: Box, b: Box) -> Column:
    """The open interiors meet."""
    return (a[2] > b[0]) & (b[2] > a[0]) & (a[3] > b[1]) & (b[3] > a[1])


def rect_containment(a: Box, b: Box) -> Column:
    """1 when a holds b (equal included), 2 when b holds a, else 0."""
    return F.when(rect_inside(b, a), 1).when(rect_inside(a, b), 2).otherwise(0)


def rects_close(a: Box, b: Box, tolerance: float = 0.001) -> Column:
    test = F.abs(a[0] - b[0]) < tolerance
    for p, q in list(zip(a, b))[1:]:
        test = test & (F.abs(p - q) < tolerance)
    return test


def axis_gaps(a: Box, b: Box) -> tuple[Column, Column]:
    """Signed gaps on x and y; negative when the extents overlap."""
    return (
        F.greatest(a[0], b[0]) - F.least(a[2], b[2]),
        F.greatest(a[1], b[1]) - F.least(a[3], b[3]),
    )


def rect_distance(a: Box, b: Box) -> Column:
    gx, gy = (F.greatest(g.cast("double"), F.lit(0.0)) for g in axis_gaps(a, b))
    return F.sqrt(gx * gx + gy * gy)


def rect_area(a: Box) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def rect_intersection(a: Box, b: Box) -> Column:
    """Common area; null for rectangles that do not meet."""
    gx, gy = axis_gaps(a, b)
    return F.when((gx <= 0) & (gy <= 0), gx * gy)


def rect_iou(a: Box, b: Box) -> Column:
    common = rect_intersection(a, b)
    return common / (rect_area(a) + rect_area(b) - common)


def point_rect_distance(x: Column, y: Column, rect: Box) -> Column:
    dx = F.greatest(rect[0] - x, x - rect[2], F.lit(0)).cast("double")
    dy = F.greatest(rect[1] - y, y - rect[3], F.lit(0)).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def point_line_distance(x: Column, y: Column, line: Box) -> Column:
    """Distance to the infinite line; null when its ends coincide."""
    dx, dy = line[2] - line[0], line[3] - line[1]
    length = F.sqrt((dx * dx + dy * dy).cast("double"))
    area = F.abs(dy * x - dx * y + line[2] * line[1] - line[3] * line[0])
    return area / F.when(length > 0, length)


def farthest_corner(rect: Box, chord: Box) -> Column:
    """The corner with the largest distance to the chord; the first on ties."""
    corners = [(rect[0], rect[1]), (rect[2], rect[1]), (rect[2], rect[3]), (rect[0], rect[3])]
    options = [
        F.struct(
            point_line_distance(x, y, chord).alias("d"),
            F.lit(-i).alias("turn"),
            x.alias("x"),
            y.alias("y"),
        )
        for i, (x, y) in enumerate(corners)
    ]
    return F.array_max(F.array(*options))


def rotate_point(x: Column, y: Column, cx: Column, cy: Column, angle: Column) -> tuple[Column, Column]:
    """Rotate counter-clockwise about (cx, cy)."""
    c, s = F.cos(angle), F.sin(angle)
    return c * (x - cx) - s * (y - cy) + cx, s * (x - cx) + c * (y - cy) + cy


def swing_angle(pivot: tuple[Column, Column], source: tuple[Column, Column], target: tuple[Column, Column]) -> Column:
    """The turn about ``pivot`` that takes ``source`` towards ``target``."""
    px, py = pivot
    return F.atan2(target[1] - py, target[0] - px) - F.atan2(source[1] - py, source[0] - px)


def swung_corners(rect: Box, arc: Box) -> list[tuple[Column, Column]]:
    """The corners of a door leaf turned about its hinge along the arc.

    The hinge is the corner farthest from the chord; the turn starts at the
    arc end nearer to the leaf.
    """
    hinge = farthest_corner(rect, arc)
    pivot = hinge["x"], hinge["y"]
    first, second = (arc[0], arc[1]), (arc[2], arc[3])
    flip = point_rect_distance(*first, rect) > point_rect_distance(*second, rect)
    source = tuple(F.when(flip, s).otherwise(f) for f, s in zip(first, second))
    target = tuple(F.when(flip, f).otherwise(s) for f, s in zip(first, second))
    turn = swing_angle(pivot, source, target)
    corners = [(rect[0], rect[1]), (rect[2], rect[1]), (rect[2], rect[3]), (rect[0], rect[3])]
    return [rotate_point(x, y, *pivot, turn) for x, y in corners]


# --- directions ----------------------------------------------------------

# Compass codes of the offset between two centres.
WEST, NORTH_WEST, NORTH, NORTH_EAST = 0, 1, 2, 3
EAST, SOUTH_EAST, SOUTH, SOUTH_WEST = 4, 5, 6, 7
SAME = 8
OUTSIDE = 10


def direction_codes(a: Box, b: Box) -> tuple[Column, Column]:
    """Codes of b seen from a and of a seen from b.

    The code is the compass direction between the centres; ``OUTSIDE`` is
    added when the other centre is not within the rectangle.
    """
    ax, ay, bx, by = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    dx, dy = bx - ax, by - ay
    east, west = dx > EPS, dx < -EPS
    north, south = dy > EPS, dy < -EPS
    code = (
        F.when(north, F.when(west, NORTH_WEST).when(east, NORTH_EAST).otherwise(NORTH))
        .when(south, F.when(west, SOUTH_WEST).when(east, SOUTH_EAST).otherwise(SOUTH))
        .otherwise(F.when(west, WEST).when(east, EAST).otherwise(SAME))
    )
    back = F.when(code == SAME, SAME).otherwise((code + 4) % 8)
    out_a = ~(bx.between(a[0], a[2]) & by.between(a[1], a[3]))
    out_b = ~(ax.between(b[0], b[2]) & ay.between(b[1], b[3]))

    def marked(c: Column, outside: Column) -> Column:
        return F.when((code != SAME) & outside, c + OUTSIDE).otherwise(c)

    return marked(code, out_a), marked(back, out_b)


def rotated_code(code: Column, quarter_turns: Column | int) -> Column:
    """A direction code after quarter turns; the outside mark stays, SAME is fixed."""
    turned = code - code % 10 + (code % 10 + quarter_turns * 2) % 8
    return F.when(code == SAME, code).otherwise(turned)


# --- segments ------------------------------------------------------------


def seg_length(s: Box) -> Column:
    dx, dy = (s[2] - s[0]).cast("double"), (s[3] - s[1]).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def seg_orientation(s: Box, tolerance: float = 0) -> Column:
    """'h', 'v' or 'o' (other)."""
    return (
        F.when(F.abs(s[3] - s[1]) <= tolerance, "h")
        .when(F.abs(s[2] - s[0]) <= tolerance, "v")
        .otherwise("o")
    )


def seg_intersection(a: Box, b: Box) -> Column:
    """The common point of two segments (ends included), null when parallel or apart."""
    dx1, dy1 = a[2] - a[0], a[3] - a[1]
    dx2, dy2 = b[2] - b[0], b[3] - b[1]
    det = dx1 * dy2 - dy1 * dx2
    ox, oy = b[0] - a[0], b[1] - a[1]
    safe = F.when(det != 0, det)
    t = (ox * dy2 - oy * dx2) / safe
    u = (ox * dy1 - oy * dx1) / safe
    hit = t.between(0, 1) & u.between(0, 1)
    return F.when(hit, F.struct((a[0] + t * dx1).alias("x"), (a[1] + t * dy1).alias("y")))


def line_intersection(a: Box, b: Box) -> Column:
    """The common point of two infinite lines, truncated to integers."""
    dx1, dy1 = a[2] - a[0], a[3] - a[1]
    dx2, dy2 = b[2] - b[0], b[3] - b[1]
    det = dx1 * dy2 - dy1 * dx2
    t = ((b[0] - a[0]) * dy2 - (b[1] - a[1]) * dx2) / F.when(det != 0, det)
    return F.when(
        det != 0,
        F.struct((a[0] + t * dx1).cast("long").alias("x"), (a[1] + t * dy1).cast("long").alias("y")),
    )


def seg_steps(s: Box) -> Column:
    """The steps of a segment's pixels, 0, 1, ..., one per step of the longer axis."""
    steps = F.greatest(F.abs(s[2] - s[0]), F.abs(s[3] - s[1]))
    return F.sequence(F.lit(0).cast("long"), steps.cast("long"))


def seg_cell(s: Box, step: Column) -> tuple[Column, Column]:
    """The pixel of a segment at a step.

    The other axis moves when the accumulated error passes one half, ties
    going to the earlier pixel.
    """
    dx, dy = F.abs(s[2] - s[0]), F.abs(s[3] - s[1])
    sx, sy = F.when(s[0] < s[2], 1).otherwise(-1), F.when(s[1] < s[3], 1).otherwise(-1)

    def along(major: Column, minor: Column) -> Column:
        # ceil((2 i minor - major) / (2 major)) for the minor axis
        return F.when(
            major > 0, F.ceil((F.lit(2) * step * minor - major) / (F.lit(2) * major))
        ).otherwise(F.lit(0)).cast("long")

    x = s[0] + sx * F.when(dx >= dy, step).otherwise(along(dy, dx))
    y = s[1] + sy * F.when(dx >= dy, along(dx, dy)).otherwise(step)
    return x, y


def seg_cells(s: Box) -> Column:
    """The pixels of a segment as an array of (step, x, y)."""

    def cell(i: Column) -> Column:
        x, y = seg_cell(s, i)
        return F.struct(i.alias("step"), x.alias("x"), y.alias("y"))

    return F.transform(seg_steps(s), cell)


# --- rings: array<struct<x,y>> without the closing vertex --------------------


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where the value is computed once however often it is used.

    Spark puts the expression of a column in place of its name, inside lambda
    functions too, where it would be computed anew for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ring_of(points: Sequence[tuple[Column, Column]]) -> Column:
    return F.array(
        *[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points]
    )


def rect_to_ring(r: Box) -> Column:
    return ring_of([(r[0], r[1]), (r[2], r[1]), (r[2], r[3]), (r[0], r[3])])


def ring_bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {
        "x1": F.array_min(xs),
        "y1": F.array_min(ys),
        "x2": F.array_max(xs),
        "y2": F.array_max(ys),
    }


def ring_round(ring: Column) -> Column:
    return F.transform(
        ring, lambda p: F.struct(F.rint(p["x"]).alias("x"), F.rint(p["y"]).alias("y"))
    )


def ring_edges(ring: Column) -> Column:
    """array<struct<i,x1,y1,x2,y2>>, the last edge closing the ring."""

    def edges(r: Column) -> Column:
        def edge(p: Column, i: Column) -> Column:
            to = F.get(r, (i + 1) % F.size(r))
            return F.struct(
                i.alias("i"), p["x"].alias("x1"), p["y"].alias("y1"), to["x"].alias("x2"), to["y"].alias("y2")
            )

        return F.transform(r, edge)

    return bound(ring, edges)


def ring_signed_area(ring: Column) -> Column:
    return (
        F.aggregate(
            ring_edges(ring),
            F.lit(0.0),
            lambda acc, e: acc + e["x1"] * e["y2"] - e["x2"] * e["y1"],
        )
        / 2
    )


def ring_area(ring: Column) -> Column:
    return F.abs(ring_signed_area(ring))


def ring_perimeter(ring: Column) -> Column:
    return F.aggregate(
        ring_edges(ring),
        F.lit(0.0),
        lambda acc, e: acc
        + F.sqrt(F.pow(e["x2"] - e["x1"], F.lit(2.0)) + F.pow(e["y2"] - e["y1"], F.lit(2.0))),
    )


def _crosses(e: Column, x: Column, y: Column) -> Column:
    """A ray from (x, y) to the right crosses the edge."""
    at = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(
        e["y1"] != e["y2"], e["y2"] - e["y1"]
    )
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)


def edge_distance(e: Column, x: Column, y: Column) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    length = dx * dx + dy * dy
    t = F.when(
        length > 0,
        F.greatest(
            F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / length)
        ),
    ).otherwise(0.0)
    ex, ey = e["x1"] + t * dx - x, e["y1"] + t * dy - y
    return F.sqrt(ex * ex + ey * ey)


def boundary_distance(ring: Column, x: Column, y: Column) -> Column:
    def nearest(p: Column) -> Column:
        return F.array_min(F.transform(ring_edges(ring), lambda e: edge_distance(e, p["x"], p["y"])))

    return bound(F.struct(x.alias("x"), y.alias("y")), nearest)


def point_on_boundary(ring: Column, x: Column, y: Column, tolerance: float = 1e-6) -> Column:
    return boundary_distance(ring, x, y) < tolerance


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (
        (cross == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def on_edges(edges: Column, x: Column, y: Column) -> Column:
    """Exactly on one of the edges."""
    return F.exists(edges, lambda e: _on_edge(e, x, y))


def point_in_edges(edges: Column, x: Column, y: Column) -> Column:
    """Strictly inside the ring of the edges: even-odd rule, the boundary does not count."""
    odd = F.size(F.filter(edges, lambda e: _crosses(e, x, y)))
    return (odd % 2 == 1) & ~on_edges(edges, x, y)


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    at = F.struct(x.alias("x"), y.alias("y"))
    return bound(at, lambda p: bound(ring_edges(ring), lambda e: point_in_edges(e, p["x"], p["y"])))


def vertex_turns(ring: Column) -> Column:
    """array<struct<i,x,y,turn,angle>>: cross product and interior corner angle in degrees."""

    def corner(ring: Column, p: Column, i: Column) -> Column:
        n = F.size(ring)
        a, c = F.get(ring, (i - 1 + n) % n), F.get(ring, (i + 1 + n) % n)
        ux, uy, vx, vy = p["x"] - a["x"], p["y"] - a["y"], c["x"] - p["x"], c["y"] - p["y"]
        norm = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
        cosine = -(ux * vx + uy * vy) / F.when(norm > 0, norm)
        return F.struct(
            i.alias("i"),
            p["x"].alias("x"),
            p["y"].alias("y"),
            (ux * vy - uy * vx).alias("turn"),
            F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))).alias("angle"),
        )

    return bound(ring, lambda r: F.transform(r, lambda p, i: corner(r, p, i)))


def ring_letterbox(ring: Column, width: Column, height: Column, size: int = 640) -> Column:
    """Pad to a square, then scale: round((x + left) * s), round((y + top) * s)."""
    side = F.greatest(width, height)
    left, top = F.floor((side - width) / 2), F.floor((side - height) / 2)
    s = F.lit(float(size)) / side
    return F.transform(
        ring,
        lambda p: F.struct(
            F.rint((p["x"] + left) * s).alias("x"), F.rint((p["y"] + top) * s).alias("y")
        ),
    )


def ring_normalise(ring: Column, width: Column, height: Column) -> Column:
    """Truncate to integers and divide by the image size."""
    return F.transform(
        ring,
        lambda p: F.struct(
            (p["x"].cast("long") / width).alias("x"), (p["y"].cast("long") / height).alias("y")
        ),
    )
