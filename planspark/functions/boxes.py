"""YOLO, pixel and COCO box expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = Sequence[Column]


def yolo_corners(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def yolo_to_pixel(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corner form in pixels, truncated toward zero."""
    x1, y1, x2, y2 = yolo_corners(cx * width, cy * height, w * width, h * height)
    return {n: c.cast("long") for n, c in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))}


def pixel_to_yolo(box: Box, width: Column, height: Column) -> dict[str, Column]:
    return {
        "cx": (box[0] + box[2]) / 2 / width,
        "cy": (box[1] + box[3]) / 2 / height,
        "w": (box[2] - box[0]) / width,
        "h": (box[3] - box[1]) / height,
    }


def yolo_to_coco(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """[left, top, width, height] in pixels and the box area."""
    pw, ph = w * width, h * height
    return {
        "bx": (cx - w / 2) * width,
        "by": (cy - h / 2) * height,
        "bw": pw,
        "bh": ph,
        "area": pw * ph,
    }


def yolo_valid(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Every number and every derived corner lies strictly between 0 and 1."""
    test = F.lit(True)
    for value in (cx, cy, w, h, *yolo_corners(cx, cy, w, h)):
        test = test & (value > 0) & (value < 1)
    return test


def split_by_aspect(df: DataFrame, tall: float = 1.5, flat: float = 0.75) -> DataFrame:
    """Halve boxes that are too tall or too flat.

    The first half keeps number and class, the second gets class 0 and is
    listed after all originals (``part`` 1).
    """
    cx, cy, w, h, cls = (F.col(c) for c in ("cx", "cy", "w", "h", "cls"))
    is_tall, is_flat = h / w > tall, h / w < flat

    def half(sign: int, kind: Column) -> Column:
        return F.struct(
            F.lit(0 if sign < 0 else 1).alias("part"),
            kind.alias("cls"),
            F.when(is_flat, cx + F.lit(sign) * w / 4).otherwise(cx).alias("cx"),
            F.when(is_tall, cy + F.lit(sign) * h / 4).otherwise(cy).alias("cy"),
            F.when(is_flat, w / 2).otherwise(w).alias("w"),
            F.when(is_tall, h / 2).otherwise(h).alias("h"),
        )

    whole = F.struct(F.lit(0).alias("part"), cls.alias("cls"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))
    pieces = F.when(
        is_tall | is_flat, F.array(half(-1, cls), half(1, F.lit(0).cast(df.schema["cls"].dataType)))
    ).otherwise(F.array(whole))
    rest = [c for c in df.columns if c not in ("cls", "cx", "cy", "w", "h")]
    return df.select(*rest, F.inline(pieces))


# The five label transforms, (name, flip, quarter turns).
AUGMENTATIONS = (
    ("keep", False, 0),
    ("flip", True, 0),
    ("rot90", False, 1),
    ("rot180", False, 2),
    ("rot270", False, 3),
)


def augment(df: DataFrame) -> DataFrame:
    """Flipped and rotated copies of normalised boxes; copies outside (0, 1) are left out."""
    def copy(name: str, flip: bool, turns: int) -> Column:
        x, y, w, h = (F.col(c).cast("double") for c in ("cx", "cy", "w", "h"))
        if flip:
            x = 1 - x
        for _ in range(turns):
            x, y, w, h = y, 1 - x, h, w
        return F.struct(
            F.lit(name).alias("variant"), x.alias("cx"), y.alias("cy"), w.alias("w"), h.alias("h")
        )

    rest = [c for c in df.columns if c not in ("cx", "cy", "w", "h")]
    copies = df.select(*rest, F.inline(F.array(*[copy(*a) for a in AUGMENTATIONS])))
    inside = F.lit(True)
    for name in ("cx", "cy", "w", "h"):
        inside = inside & (F.col(name) > 0) & (F.col(name) < 1)
    return copies.where(inside)
