"""Consensus over a stream of images. Every image is self-contained, so each micro-batch is merged on its own: no state, no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.consensus import merge


def start(detections: DataFrame, sink: Callable[[DataFrame, int], None], min_votes: int = 2, iou_threshold: float = 0.5, checkpoint: str | None = None) -> StreamingQuery:
    """``detections``: a streaming table in which all rows of an image arrive together. ``sink(merged, batch_id)`` must be idempotent by batch id."""
    writer = detections.writeStream.foreachBatch(lambda batch, i: sink(merge(batch, min_votes, iou_threshold), i))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
