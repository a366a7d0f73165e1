"""Staged decoding of detector boxes as relations: crops, first success, full-frame fallback, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import padded_crop

#: Padding of the three crops, and their names.
LADDER = ((0.05, "tight"), (0.15, "medium"), (0.30, "large"))
GATE = ("data_matrix", "qr", "micro_qr", "aztec")


def crop_ladder(boxes: DataFrame) -> DataFrame:
    """Each box's crops in order; boxes without area and empty crops give none."""
    steps = F.array(*[F.struct(F.lit(i).alias("stage_ix"), F.lit(f).alias("factor"), F.lit(n).alias("stage")) for i, (f, n) in enumerate(LADDER)])
    rows = boxes.filter("x2 > x1 and y2 > y1").withColumn("step", F.explode(steps)).select("*", "step.*").drop("step")
    crop = padded_crop({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, F.col("factor"), 4, F.col("width"), F.col("height"))
    return rows.withColumns(crop).filter("cx2 > cx1 and cy2 > cy1")


def fallback_crop(boxes: DataFrame, target: int = 300, least: int = 4) -> DataFrame:
    """The second decoder's crop, with the factor that brings its shorter side to ``target``."""
    crop = padded_crop({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, F.lit(0.25), 8, F.col("width"), F.col("height"))
    short = F.least(F.col("cx2") - F.col("cx1"), F.col("cy2") - F.col("cy1"))
    return boxes.withColumns(crop).filter(short >= least).withColumn("upscale", F.greatest(F.lit(1.0), F.lit(float(target)) / short))


def first_success(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Of attempts ``(keys, stage_ix, stage, payload)`` the first decoded one."""
    return attempts.groupBy(*keys).agg(F.min_by(F.struct("payload", "stage"), F.when(F.col("payload").isNotNull(), F.col("stage_ix"))).alias("f")).select(*keys, "f.payload", "f.stage")


def fallback_reads(boxes: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """The first full-frame read ``(image_id, read_ix, cx, cy, payload)`` whose centre lies in each box, ends included.

    The join is an equi-join on the image with the box as residual condition, so it is bounded by boxes x reads of one image.
    """
    inside = F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
    met = boxes.join(reads.withColumnRenamed("image_id", "__image"), (F.col("image_id") == F.col("__image")) & inside)
    return met.groupBy(*keys).agg(F.min_by("read_payload", "read_ix").alias("payload"), F.count("*").alias("reads_inside"))


def gate(payload: Column, detector_symbology: Column) -> Column:
    """Whether the second decoder is asked; by the detector's class, not by a reconciled one."""
    return payload.isNull() & detector_symbology.isin(*GATE)


def reconciled(decoder: Column, decoded: Column, detector: Column) -> Column:
    return F.when(decoder == "libdmtx", "data_matrix").otherwise(F.coalesce(decoded, detector))


def extras(decoder: Column, class_id: Column, class_name: Column, stage: Column, detector: Column, final: Column) -> Column:
    """The free keys of a detection; ``detector_symbology`` (upper case) only where it differs from the final one."""
    pairs = F.array(
        F.struct(F.lit("decoder").alias("key"), decoder.alias("value")),
        F.struct(F.lit("model_class_id").alias("key"), class_id.cast("string").alias("value")),
        F.struct(F.lit("model_class_name").alias("key"), class_name.alias("value")),
        F.struct(F.lit("decode_stage").alias("key"), stage.alias("value")),
        F.struct(F.lit("detector_symbology").alias("key"), F.when(detector != final, F.upper(detector)).alias("value")),
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def mapped_formats(rows: DataFrame, formats: DataFrame, drop: bool) -> DataFrame:
    """Decoder formats to symbologies. ``drop``: rows of unmapped or dropped formats go; else they keep a null."""
    dim = F.broadcast(formats.filter("action = 'map'").select("decoder", "raw_format", F.col("symbology").alias("mapped")))
    return rows.join(dim, ["decoder", "raw_format"], "inner" if drop else "left")
