"""The engine whose model runs here, as one plan: pixels to anchors, anchors to boxes, boxes to crops, crops to reads, reads to detections.

Python touches pixels twice, in the model's step and in the readers' step; everything between and after is DataFrame expressions. A reader is
any function from RGB pixels to a list of reads, dicts with text and, where it knows them, valid, symbology and corners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import columns, corners
from ..operators import decode as D
from ..operators import postprocess as P
from ..schema import DETECTIONS, ENGINES, OWN
from ..sources.images import infer
from ..sources.pixels import decode
from ..errors import InvalidImage

Reader = Callable[[np.ndarray], list[dict]]
FULL = "fallback"
_READ = "image_id bigint, anchor_ix int, stage_ix int, stage string, read_ix int, payload string, read_symbology string, cx double, cy double"


def first_valid(reader: Reader, pixels: np.ndarray) -> dict | None:
    """The first valid read with text; a reader that raises has read nothing."""
    try:
        return next((r for r in reader(pixels) if r.get("valid", True) and r.get("text")), None)
    except Exception:  # noqa: BLE001  a reader may raise anything
        return None


def _reads(reader: Callable[[], Reader]):
    """Over one row an image, (image_id, content, crops): each box's stages up to the first read, and the reads of the whole image, of which the centre of top left and bottom right is told."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        for pdf in batches:
            out = []
            for image_id, content, crops in zip(pdf["image_id"], pdf["content"], pdf["crops"], strict=True):
                try:
                    pixels = decode(content)
                except InvalidImage:
                    continue
                done, missed = set(), False
                for c in crops:  # by box, then by stage
                    if c["anchor_ix"] in done:
                        continue
                    if found := first_valid(read, pixels[c["cy1"] : c["cy2"], c["cx1"] : c["cx2"]]):
                        done.add(c["anchor_ix"])
                        out.append((image_id, c["anchor_ix"], c["stage_ix"], c["stage"], None, found["text"], found.get("symbology"), None, None))
                missed = any(c["anchor_ix"] not in done for c in crops)
                try:
                    whole = [r for r in read(pixels) if r.get("valid", True) and r.get("text") and r.get("corners")] if missed else []
                except Exception:  # noqa: BLE001
                    whole = []
                for i, r in enumerate(whole):
                    a, b = r["corners"][0], r["corners"][2]
                    out.append((image_id, None, len(D.LADDER), FULL, i, r["text"], r.get("symbology"), (a[0] + b[0]) / 2, (a[1] + b[1]) / 2))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _READ.split(", ")]).astype({c: "Int64" for c in ("anchor_ix", "stage_ix", "read_ix")})

    return run


def _second(reader: Callable[[], Callable[[np.ndarray], bytes | str | None]]):
    """The second decoder over (image_id, content, crops) with ``upscale``: payloads, bytes as UTF-8 with replacements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..sources.images import resized

        read = reader()
        for pdf in batches:
            out = []
            for image_id, content, crops in zip(pdf["image_id"], pdf["content"], pdf["crops"], strict=True):
                pixels = decode(content)
                for c in crops:
                    part = pixels[c["cy1"] : c["cy2"], c["cx1"] : c["cx2"]]
                    if c["upscale"] > 1:
                        part = resized(part, round(part.shape[1] * c["upscale"]), round(part.shape[0] * c["upscale"])).astype(np.uint8)
                    try:
                        text = read(part)
                    except Exception:  # noqa: BLE001  as for the first one
                        text = None
                    if text:
                        out.append((image_id, c["anchor_ix"], text.decode("utf-8", "replace") if isinstance(text, bytes) else text))
            yield pd.DataFrame(out, columns=["image_id", "anchor_ix", "second"])

    return run


def _by_image(rows: DataFrame, images: DataFrame, *fields: str) -> DataFrame:
    """One row an image with its content and its crops in order; an image's boxes are bounded by the model's anchors."""
    crops = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("crops"))
    return images.select("image_id", "content").join(crops, "image_id").select("image_id", "content", "crops")


def decoded(boxes: DataFrame, images: DataFrame, reader: Callable[[], Reader] | None = None, second: Callable | None = None, model_classes: int = 14) -> DataFrame:
    """Detections of ``boxes(image_id, anchor_ix, class_id, score, x1..y2, width, height)``: three crops, then the whole image, then the second decoder for matrix codes.

    Without a reader (detect-only) all payloads are null.
    """
    keys = ["image_id", "anchor_ix"]
    rows = P.with_symbology(P.ranked(boxes), model_classes).withColumnRenamed("symbology", "detector")
    if reader is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("payload", "stage", "read_symbology")})
    else:
        ladder = D.crop_ladder(boxes)
        # a box whose every crop is empty still counts as one that the whole image is asked for
        asked = ladder.select(*keys, "stage_ix", "stage", "cx1", "cy1", "cx2", "cy2")
        reads = _by_image(asked, images, "anchor_ix", "stage_ix", "stage", "cx1", "cy1", "cx2", "cy2").mapInPandas(_reads(reader), _READ)
        own = reads.filter("anchor_ix is not null").select(*keys, F.struct("payload", "stage", "read_symbology").alias("own"))
        inside = F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
        whole = reads.filter("anchor_ix is null").select(F.col("image_id").alias("__image"), "read_ix", "cx", "cy", F.struct("payload", "stage", "read_symbology").alias("whole"))
        met = boxes.join(whole, (F.col("image_id") == F.col("__image")) & inside).groupBy(*keys).agg(F.min_by("whole", "read_ix").alias("whole"))
        found = F.coalesce("own", "whole")
        rows = rows.join(own, keys, "left").join(met, keys, "left").withColumns({c: found[c] for c in ("payload", "stage", "read_symbology")}).drop("own", "whole")
    rows = rows.withColumn("decoder", F.when(F.col("payload").isNotNull(), "zxing").otherwise("none"))
    if second is not None and reader is not None:
        asked = D.fallback_crop(rows.filter(D.gate(F.col("payload"), F.col("detector"))).filter("x2 > x1 and y2 > y1"))
        again = _by_image(asked, images, "anchor_ix", "cx1", "cy1", "cx2", "cy2", "upscale").mapInPandas(_second(second), "image_id bigint, anchor_ix int, second string")
        rows = rows.join(again, keys, "left").withColumns({"decoder": F.when(F.col("second").isNotNull(), "libdmtx").otherwise(F.col("decoder")), "stage": F.when(F.col("second").isNull(), F.col("stage")), "payload": F.coalesce("payload", "second")})
    rows = rows.withColumn("symbology", D.reconciled(F.col("decoder"), F.col("read_symbology"), F.col("detector")))
    extras = D.extras(F.col("decoder"), F.col("class_id"), F.col("class_name"), F.col("stage"), F.col("detector"), F.col("symbology"))
    rows = rows.withColumns({"extras": extras, "polygon": corners(columns()), "engine": F.lit(OWN), "engine_rank": F.lit(ENGINES.index(OWN))})
    return rows.select(*[F.col(x.split()[0]).cast(x.split(maxsplit=1)[1]) for x in DETECTIONS.split(", ")])


def detections(images: DataFrame, model: str, arch: str, reader: Callable[[], Reader] | None = None, second: Callable | None = None, confidence: float = P.CONFIDENCE, nms: float = P.NMS, model_classes: int = 14, wanted: list[str] | None = None) -> DataFrame:
    """The whole engine over ``images(image_id, content)``."""
    boxes = P.detections(infer(images, model, arch, wanted), arch, confidence, nms)
    return decoded(boxes, images, reader, second, model_classes)
