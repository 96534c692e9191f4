"""Boxes as structs (x1, y1, x2, y2), and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column, kind: str = "double") -> Column:
    return F.struct(*[c.cast(kind).alias(n) for n, c in zip(CORNERS, (x1, y1, x2, y2), strict=True)])


def area(a: Column) -> Column:
    return (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes apart or without area."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when((both <= 0) | (union <= 0), F.lit(0.0)).otherwise(both / union)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    small = F.least(area(a), area(b))
    return F.when(small <= 0, F.lit(0.0)).otherwise(intersection(a, b) / small)


def clamp(a: Column, width: Column, height: Column) -> Column:
    into = lambda v, top: F.least(F.greatest(v, F.lit(0)), top)
    return F.struct(into(a["x1"], width).alias("x1"), into(a["y1"], height).alias("y1"), into(a["x2"], width).alias("x2"), into(a["y2"], height).alias("y2"))


def pad(a: Column, width: Column, height: Column, share: float = 0.2) -> Column:
    """Half of ``share`` of the width on either side, ``share`` of the height, 1 at least, clamped."""
    px = F.greatest(F.lit(1), F.floor((a["x2"] - a["x1"]) * share / 2))
    py = F.greatest(F.lit(1), F.floor((a["y2"] - a["y1"]) * share))
    wider = F.struct((a["x1"] - px).alias("x1"), (a["y1"] - py).alias("y1"), (a["x2"] + px).alias("x2"), (a["y2"] + py).alias("y2"))
    return clamp(wider, width, height)


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def to_centre(a: Column, width: Column, height: Column) -> Column:
    """Centre and size as shares of the image, clamped to 0..1."""
    share = lambda v, total: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / total))
    return F.struct(
        share((a["x1"] + a["x2"]) / 2, width).alias("cx"), share((a["y1"] + a["y2"]) / 2, height).alias("cy"),
        share(a["x2"] - a["x1"], width).alias("w"), share(a["y2"] - a["y1"], height).alias("h"),
    )


def polygon_box(points: Column) -> Column:
    """Bounding box of an array of points (x, y) in whole pixels, the last one included."""
    xs, ys = F.transform(points, lambda p: p["x"].cast("int")), F.transform(points, lambda p: p["y"].cast("int"))
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs) + 1, F.array_max(ys) + 1, "int")


def suppress(rows: Column, threshold: float) -> Column:
    """Greedy non-maximum suppression over an array of structs whose first field
    is the score and that have ``box``: best first, class-agnostic."""
    best_first = F.sort_array(rows, asc=False)
    none = F.slice(best_first, 1, 0)
    return F.aggregate(best_first, none, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k["box"], b["box"]) >= threshold), kept).otherwise(F.concat(kept, F.array(b))))


def shrink(width: Column, height: Column, most: int, rounded: bool = False) -> tuple[Column, Column]:
    """Size after the longer side is brought down to ``most``; truncated or rounded, 1 at least."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    fit = (lambda v: F.bround(v).cast("int")) if rounded else (lambda v: F.floor(v).cast("int"))
    return F.greatest(F.lit(1), fit(width * scale)), F.greatest(F.lit(1), fit(height * scale))
