"""Model output rows to detections, for three output layouts.

``anchors(image_id, anchor_ix, feat array<double>, ratio, width, height)``: one row per anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fold import suppressed
from ..functions.geometry import LETTERBOX, centre_to_corners, sigmoid
from ..schema import OTHER, OWN, dim_model_class

CONFIDENCE, NMS = 0.25, 0.45
OFFSET = {"yolox": 5, "yolo11": 4, "rtdetr": 4}
LEAST_FEATURES = {"yolox": 6, "yolo11": 5, "rtdetr": 5}


def family(arch: str | None) -> str:
    """The layout of an architecture name; yolox where nothing else fits."""
    name = (arch or "yolox_s").lower()
    return "rtdetr" if name.startswith("rtdetr") else "yolo11" if name.startswith("yolo11") else "yolox"


def engine_name(arch: str | None, explicit: str | None = None) -> str:
    name = (arch or "yolox_s").lower()
    layout = next((x for x in ("rtdetr", "yolo11", "yolox") if name.startswith(x)), name)
    return explicit or (OWN if layout == "yolox" else f"{OWN}-{layout}")


def stated(metadata: dict[str, str], key: str) -> str | None:
    """A model's own metadata by the key's last part: tools put a prefix of their own before it (``<prefix>_num_classes``)."""
    return next((v for k, v in sorted(metadata.items()) if k == key or k.endswith(f"_{key}")), None)


def num_classes(metadata: dict[str, str], features: int | None, layout: str = "yolox") -> int:
    """From the model's own metadata, else from the row width of its layout, else 9."""
    said = stated(metadata, "num_classes")
    if said is not None and said.strip().isdigit():
        return int(said)
    return features - OFFSET[layout] if features else 9


def scored(anchors: DataFrame, arch: str, confidence: float = CONFIDENCE) -> DataFrame:
    """Boxes in model space with score and class, those of at least ``confidence``."""
    layout = family(arch)
    guard = F.when(F.size("feat") >= LEAST_FEATURES[layout], F.col("feat")).otherwise(F.raise_error(F.lit("too few features in a row of model output")))
    at = lambda i: F.element_at("__f", i + 1)
    classes = F.slice("__f", OFFSET[layout] + 1, F.size("__f") - OFFSET[layout])
    scale = float(LETTERBOX) if layout == "rtdetr" else 1.0
    box = centre_to_corners(*[at(i) * scale for i in range(4)])
    best = F.array_max("__c")
    score: Column = sigmoid(best) if layout == "rtdetr" else best * at(4) if layout == "yolox" else best
    rows = anchors.withColumn("__f", guard).withColumn("__c", classes)
    rows = rows.withColumns(box | {"score": score, "class_id": (F.array_position("__c", best) - 1).cast("int")})
    return rows.filter(F.col("score") >= confidence).drop("__f", "__c", "feat")


def unscaled(rows: DataFrame, clip: str = "near") -> DataFrame:
    """To image pixels, clipped to the image. ``near``: each corner on its own side only."""
    inv = 1 / F.col("ratio")
    x1, y1, x2, y2 = (F.col(c) * inv for c in ("x1", "y1", "x2", "y2"))
    zero = F.lit(0.0)
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    if clip == "near":
        new = {"x1": F.greatest(zero, x1), "y1": F.greatest(zero, y1), "x2": F.least(w, x2), "y2": F.least(h, y2)}
    else:
        new = {"x1": F.least(w, F.greatest(zero, x1)), "y1": F.least(h, F.greatest(zero, y1)), "x2": F.least(w, F.greatest(zero, x2)), "y2": F.least(h, F.greatest(zero, y2))}
    return rows.withColumns(new)


def detections(anchors: DataFrame, arch: str, confidence: float = CONFIDENCE, nms: float = NMS) -> DataFrame:
    """Whole post-processing of one layout: YOLOX suppresses in model space and drops flat boxes, YOLO11 suppresses clipped boxes,
    RT-DETR suppresses nothing."""
    rows, layout = scored(anchors, arch, confidence), family(arch)
    keys, order = ("image_id", "class_id"), ("anchor_ix",)
    if layout == "yolox":
        return unscaled(suppressed(rows, nms, keys, order)).filter("x2 > x1 and y2 > y1")
    rows = unscaled(rows, "both")
    return suppressed(rows, nms, keys, order) if layout == "yolo11" else rows


def ranked(rows: DataFrame) -> DataFrame:
    """With ``det_ix``, the place in the image by falling score; ties by anchor."""
    return rows.withColumn("det_ix", (F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("score"), "anchor_ix")) - 1).cast("int"))


def with_symbology(rows: DataFrame, classes: int) -> DataFrame:
    """Symbology and class name of ``class_id`` by the table for ``classes``; an unknown id or table gives the pooled symbology."""
    dim = dim_model_class(rows.sparkSession).filter(F.col("num_classes") == classes).select("class_id", F.col("symbology").alias("__s"))
    return rows.join(F.broadcast(dim), "class_id", "left").withColumn("symbology", F.coalesce("__s", F.lit(OTHER))).withColumn("class_name", F.coalesce("__s", F.lit("unknown"))).drop("__s")
