"""Geometry as Column expressions; they stay in whole-stage code generation where no array function is involved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")
LONGEST, LETTERBOX = 2000, 640


def iou(a, b, clamp: bool = True) -> Column:
    """Overlap of two boxes (structs or prefixes with x1..y2): 0 without intersection or without area."""
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = width * height
    side = (lambda x: F.greatest(F.lit(0.0), x)) if clamp else (lambda x: x)
    union = side(a["x2"] - a["x1"]) * side(a["y2"] - a["y1"]) + side(b["x2"] - b["x1"]) * side(b["y2"] - b["y1"]) - inter
    return F.when((inter <= 0) | (union <= 0), 0.0).otherwise(F.try_divide(inter, union))


def columns(suffix: str = "") -> dict[str, Column]:
    return {c: F.col(c + suffix) for c in BOX}


def centre_to_corners(cx, cy, w, h) -> dict[str, Column]:
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def downscaled(w: Column, h: Column, longest: int = LONGEST) -> tuple[Column, Column]:
    """Sizes after the automatic downscale; unchanged up to ``longest``."""
    ratio = F.lit(float(longest)) / F.greatest(w, h)
    shrink = lambda x: F.when(F.greatest(w, h) > longest, F.greatest(F.lit(1), (x * ratio).cast("int"))).otherwise(x.cast("int"))
    return shrink(w), shrink(h)


def letterbox(w: Column, h: Column, size: int = LETTERBOX) -> tuple[Column, Column, Column]:
    """Ratio and sizes of the resized image inside a square of ``size``."""
    ratio = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    return ratio, F.greatest(F.lit(1), (w * ratio).cast("int")), F.greatest(F.lit(1), (h * ratio).cast("int"))


def rescaled_polygon(polygon: Column, sx: Column, sy: Column) -> Column:
    return F.transform(polygon, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))


def corners(box: dict[str, Column]) -> Column:
    """Top left, top right, bottom right, bottom left."""
    point = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    return F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2"))


def bounds(polygon: Column) -> dict[str, Column]:
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def flipped(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Normalised bottom-left coordinates to pixels from the top left."""
    return x * w, (1 - y) * h


def padded_crop(box: dict[str, Column], factor: Column, least: int, w: Column, h: Column) -> dict[str, Column]:
    """Integer crop around a box, padded by a share of its shorter side (``least`` pixels at least), inside the image."""
    pad = F.greatest(F.lit(float(least)), factor * F.least(box["x2"] - box["x1"], box["y2"] - box["y1"]))
    return {
        "cx1": F.greatest(F.lit(0), (box["x1"] - pad).cast("int")),
        "cy1": F.greatest(F.lit(0), (box["y1"] - pad).cast("int")),
        "cx2": F.least(w.cast("int"), (box["x2"] + pad).cast("int")),
        "cy2": F.least(h.cast("int"), (box["y2"] + pad).cast("int")),
    }


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def check_digit(digits: Column) -> Column:
    """EAN-13's last digit from its first twelve."""
    weighted = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return (10 - weighted % 10) % 10
