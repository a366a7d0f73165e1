"""Bounded labelled samples for the classifiers, and the map that puts a tuned threshold at 0.3."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A class gives at most so many documents to a fit, each of at most so many code points.
PER_CLASS, LONGEST = 3000, 32_768
THRESHOLD = 0.3


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int = PER_CLASS, longest: int = LONGEST) -> pd.DataFrame:
    """(text, y, fold hash): for each class the ``per_class`` labelled documents outside the held-out fold with the least hash
    of their id. Rows with null labels, ids or texts, and texts beyond ``longest``, give nothing to the fit."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).filter("__id is not null and y in (0, 1)")
    known = known.groupBy("__id").agg(F.max("y").alias("y")).filter(fold("__id", folds) != held).withColumn("r", F.xxhash64("__id"))
    # a quarter more than are used: some have no text or a long one
    some = [known.filter(F.col("y") == y).orderBy("r", "__id").limit(per_class + per_class // 4) for y in (0, 1)]
    picked = pd.concat([x.toPandas() for x in some])
    if not len(picked):
        return pd.DataFrame({"text": [], "y": [], "r": []})
    chosen = docs.sparkSession.createDataFrame(picked)
    # at most 2.5 x per_class ids are broadcast, and as many texts of bounded length come back
    texts = docs.select("doc_id", "text").filter(F.length("text") <= longest).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    found = texts.groupBy("__id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("r").alias("r")).toArrow().to_pandas()
    return found.sort_values(["r", "__id"]).groupby("y").head(per_class)[["text", "y", "r"]].reset_index(drop=True)


def cut_between(scores: np.ndarray, y: np.ndarray, below1: float = 1.0, above0: float = 1.0) -> float:
    """The threshold with the least sum of both classes' error rates, weighted by what errors cost, in the middle of the widest such gap."""
    order = np.argsort(scores)
    s, t = scores[order], y[order]
    n1, n0 = max(1, t.sum()), max(1, (1 - t).sum())
    errors = below1 * np.concatenate([[0], np.cumsum(t)]) / n1 + above0 * (n0 - np.concatenate([[0], np.cumsum(1 - t)])) / n0
    edge = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    gap = np.concatenate([[0], s[1:] - s[:-1], [0]])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(edge[best[np.argmax(gap[best])]])


def at_threshold(logits: np.ndarray, cut: np.ndarray | float) -> np.ndarray:
    """Probabilities whose 0.3 lies at ``cut``."""
    return 1 / (1 + np.exp(-np.clip(logits - cut + np.log(THRESHOLD / (1 - THRESHOLD)), -50, 50)))


def flagged(docs: DataFrame, keep: Column) -> DataFrame:
    """``docs`` where ``keep`` holds; all columns as they were, whatever their names."""
    name = "__keep"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, keep).filter(F.col(name)).drop(name)
