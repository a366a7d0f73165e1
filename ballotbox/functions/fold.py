"""The greedy fold that suppression, clustering and ground-truth matching share.

Over boxes in order, a box is a seed unless a seed before it overlaps it by the threshold or more. A box belongs to the
first such seed; a seed to itself. That equals the usual loop of claiming, without iteration or Python. The arrays are bounded by the boxes of one group
(an image, or an image's class): the fold costs boxes x seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import BOX, iou


def seeds(boxes: Column, kind: str, threshold: float, clamp: bool = True) -> Column:
    """The seeds of an ordered array of structs of type ``kind``."""
    empty = F.array().cast(f"array<{kind}>")
    return F.aggregate(boxes, empty, lambda kept, c: F.when(F.exists(kept, lambda o: iou(o, c, clamp) >= threshold), kept).otherwise(F.concat(kept, F.array(c))))


def clustered(det: DataFrame, threshold: float, keys: tuple[str, ...] = ("image_id",), order: tuple[str, ...] = ("engine_rank", "det_ix"), clamp: bool = True) -> DataFrame:
    """``det`` with ``pos`` (rank by score, then ``order``) and ``seed`` (the ``pos`` of the seed), all columns kept."""
    # maps can't stand in a sorted array: they travel as their entries
    maps = [c for c, kind in det.dtypes if kind.startswith("map<")]
    det = det.withColumns({c: F.map_entries(c) for c in maps}) if maps else det
    rest = [c for c in det.columns if c not in keys]
    item = F.struct((-F.col("score")).alias("__s"), *[F.col(c).alias(f"__{c}") for c in order], *[F.col(c).cast("double").alias(c) if c in BOX else F.col(c) for c in rest])
    grouped = det.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    thin = F.transform("all", lambda x, i: F.struct(i.alias("pos"), *[x[c].alias(c) for c in BOX]))
    kind = "struct<pos:int,x1:double,y1:double,x2:double,y2:double>"
    # materialised in one projection each, else the optimiser would inline the fold into every use
    found = grouped.withColumn("thin", thin).withColumn("seeds", seeds(F.col("thin"), kind, threshold, clamp))
    rows = found.select(*keys, "seeds", F.posexplode("all").alias("pos", "row"))
    own = F.struct(F.col("pos"), *[F.col(f"row.{c}").alias(c) for c in BOX])
    seed = F.element_at(F.filter("seeds", lambda o: (o["pos"] == F.col("pos")) | (iou(o, own, clamp) >= threshold)), 1)["pos"]
    return rows.select(*keys, *[(F.map_from_entries(f"row.{c}") if c in maps else F.col(f"row.{c}")).alias(c) for c in rest], "pos", seed.alias("seed"))


def suppressed(det: DataFrame, threshold: float, keys: tuple[str, ...], order: tuple[str, ...] = ("det_ix",)) -> DataFrame:
    """Only the seeds: non-maximum suppression within ``keys``; areas are not clamped here."""
    return clustered(det, threshold, keys, order, clamp=False).filter("pos = seed").drop("pos", "seed")
