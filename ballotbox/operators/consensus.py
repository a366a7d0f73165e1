"""Consensus: overlapping detections of one image are clustered, voted on and merged.

One shuffle on image_id carries the whole operator: the cluster key extends it, so the aggregates reuse its partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.fold import clustered

IOU = 0.5


def check_arguments(engines, min_votes, iou_threshold) -> None:
    if not engines:
        raise ValueError("engines must not be empty")
    if isinstance(min_votes, bool) or not isinstance(min_votes, int) or not 1 <= min_votes <= len(engines):
        raise ValueError(f"min_votes must be between 1 and the number of engines ({len(engines)})")
    if not 0 <= iou_threshold <= 1:
        raise ValueError("iou_threshold must be in [0, 1]")


def fan_out(parts: dict[str, DataFrame]) -> DataFrame:
    """All engines' detections in one table; ``engine`` is the key that an engine is registered under."""
    frames = [df.withColumn("engine", F.lit(name)).withColumn("engine_rank", F.lit(i)) for i, (name, df) in enumerate(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge(det: DataFrame, min_votes: int = 2, iou_threshold: float = IOU) -> DataFrame:
    """One row per cluster with votes of at least ``min_votes`` different engines."""
    if "polygon" not in det.columns:
        det = det.withColumn("polygon", F.lit(None).cast("array<struct<x:double,y:double>>"))
    rows = clustered(det.select("image_id", "engine", "engine_rank", "det_ix", "x1", "y1", "x2", "y2", "score", "symbology", "payload", "polygon"), iou_threshold)
    key = W.partitionBy("image_id", "seed")
    by = lambda c: W.partitionBy("image_id", "seed", c)
    # votes of each value stand beside the rows (same partitioning, no further shuffle), ties break by a struct
    rows = rows.withColumn("engines", F.size(F.collect_set("engine").over(key))).filter(F.col("engines") >= min_votes)
    rows = rows.withColumn("__s", F.count("*").over(by("symbology"))).withColumn("__p", F.count("payload").over(by("payload")))
    return (
        rows.groupBy("image_id", "seed")
        .agg(
            *[F.median(c).alias(c) for c in ("x1", "y1", "x2", "y2")],
            F.avg("score").alias("score"),
            F.max_by("symbology", F.struct("__s", "score", "symbology")).alias("symbology"),
            F.max_by("payload", F.when(F.col("payload").isNotNull(), F.struct("__p", "score", -F.col("pos")))).alias("payload"),
            F.min_by("polygon", "pos").alias("polygon"),
            F.array_sort(F.collect_set("engine")).alias("voted_by"),
            F.array_sort(F.collect_set("payload")).alias("agreed_payloads"),
            F.count("*").cast("int").alias("source_count"),
        )
        .withColumn("vote_count", F.size("voted_by"))
        .withColumn("code_ix", (F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("score"), "seed")) - 1).cast("int"))
        .withColumn("engine", F.lit("consensus"))
        .drop("seed")
    )


def cluster_votes(det: DataFrame, iou_threshold: float = IOU) -> DataFrame:
    """(image_id, seed, vote_count, source_count) of every cluster."""
    rows = clustered(det.select("image_id", "engine", "engine_rank", "det_ix", "x1", "y1", "x2", "y2", "score"), iou_threshold)
    return rows.groupBy("image_id", "seed").agg(F.size(F.collect_set("engine")).alias("vote_count"), F.count("*").alias("source_count"))


def per_engine(det: DataFrame, engines: list[str], images: DataFrame) -> DataFrame:
    """Every image and engine with its number of detections, those without any included."""
    counts = det.groupBy("image_id", "engine").agg(F.count("*").alias("n"))
    every = images.select("image_id").withColumn("engine", F.explode(F.array(*[F.lit(e) for e in engines])))
    return every.join(counts, ["image_id", "engine"], "left").select("image_id", "engine", F.coalesce("n", F.lit(0)).alias("n"))


def run(parts: dict[str, DataFrame], min_votes: int = 2, iou_threshold: float = IOU) -> DataFrame:
    check_arguments(parts, min_votes, iou_threshold)
    return merge(fan_out(parts), min_votes, iou_threshold)


def run_detailed(parts: dict[str, DataFrame], min_votes: int = 2, iou_threshold: float = IOU) -> tuple[DataFrame, DataFrame]:
    check_arguments(parts, min_votes, iou_threshold)
    raw = fan_out(parts)
    return merge(raw, min_votes, iou_threshold), raw
