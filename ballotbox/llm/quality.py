"""Quality by a byte-level convolutional network in numpy.

The UTF-8 bytes of a text are cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - STEP`` and cover it whole. Learned
filters of ``WIDTH`` bytes run over each chunk at every second byte, together with a second input channel: how often the
4-byte group at the place occurs in the chunk (log2 level), by which repetition shows. Filters are max-pooled over the chunk
into a chunk score; mean, least and greatest chunk score combine into one probability, in which 0.3 is the threshold
tuned on the fit's own validation part. Inputs are the text's bytes alone.

Defined results: null and empty texts are scored as no bytes (a constant); very long texts are scored whole, chunk by chunk; repeated
rows and null ids are rows like others; an empty table gives no rows; further columns take no part, whatever their names; without
labels of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import claim, give_back
from ._fit import THRESHOLD, at_threshold, cut_between, flagged, fold, sample

CHUNK, STEP, WIDTH, FILTERS, LEVELS, BINS = 1024, 896, 6, 16, 8, 1024
FOLDS, HELD = 5, 0
_BATCH = 96
#: Texts whose chunks are held at once.
_TEXTS = 256


def chunks(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts as rows of bytes, each row's length, and for each text its number of rows."""
    raws = [(x or "").encode() for x in texts]
    numbers = np.array([max(1, -(-max(0, len(r) - (CHUNK - STEP)) // STEP)) for r in raws])
    rows, lengths = np.zeros((int(numbers.sum()), CHUNK), np.uint8), np.zeros(int(numbers.sum()), np.int64)
    at = 0
    for raw, n in zip(raws, numbers.tolist(), strict=True):
        whole = np.frombuffer(raw, np.uint8)
        for k in range(n):
            part = whole[k * STEP : k * STEP + CHUNK]
            rows[at, : len(part)] = part
            lengths[at] = len(part)
            at += 1
    return rows, lengths, numbers


def levels(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The second channel at every second byte."""
    wide = rows.astype(np.uint32)
    code = wide[:, :-3] | wide[:, 1:-2] << 8 | wide[:, 2:-1] << 16 | wide[:, 3:] << 24
    bins = ((code * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int32)
    inside = np.arange(CHUNK - 3) < (lengths - 3)[:, None]
    flat = bins + (np.arange(len(rows), dtype=np.int32) * BINS)[:, None]
    counts = np.bincount(flat[inside], minlength=len(rows) * BINS)
    level = np.minimum(LEVELS - 1, np.log2(np.maximum(1, counts))).astype(np.uint8)
    out = np.zeros((len(rows), CHUNK // 2), np.uint8)
    even = flat[:, ::2]
    out[:, : even.shape[1]] = np.where(inside[:, ::2], level[even], 0)
    return out


class Network:
    """``table[j, byte]`` and ``rep[level]`` give the filters' inputs; ``w``, ``b`` the chunk score; ``mix`` the document's logit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.rep = rng.normal(0, 0.15, (LEVELS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.w = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.b = np.zeros(1, np.float32)
        self.mix, self.cut = np.array([1.0, 0.0, 0.0]), 0.0
        self.pairs = None

    def convolve(self, rows: np.ndarray, level: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Filter values at every second byte; places past a chunk's end give -inf but for the first."""
        if self.pairs is None:
            self.pairs = [(self.table[2 * k][:, None, :] + self.table[2 * k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(WIDTH // 2)]
        double = rows.astype(np.int32)
        double = double[:, ::2] * 256 + double[:, 1::2]
        n = double.shape[1]
        out = self.rep[level] + self.bias
        for k, pair in enumerate(self.pairs):
            out[:, : n - k] += pair[double[:, k:]]
        past = np.arange(n) * 2 >= np.maximum(1, lengths)[:, None]
        out[past] = -np.inf
        return out

    def pooled(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), FILTERS), np.float32)
        for i in range(0, len(rows), _BATCH):
            r, n = rows[i : i + _BATCH], lengths[i : i + _BATCH]
            out[i : i + _BATCH] = np.maximum(self.convolve(r, levels(r, n), n).max(1), 0)
        return out

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        rows, lengths, numbers = chunks(texts)
        return self.features(self.pooled(rows, lengths) @ self.w + self.b, numbers) @ self.mix

    @staticmethod
    def features(scores: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        at = np.concatenate([[0], np.cumsum(numbers)[:-1]])
        return np.stack([np.add.reduceat(scores, at) / numbers, np.minimum.reduceat(scores, at), np.maximum.reduceat(scores, at)], 1).astype(np.float64)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return at_threshold(self.logits(texts), self.cut)


def fit(texts: list[str], y: np.ndarray, epochs: int = 6, seed: int = 7) -> Network | None:
    """Adam on chunks with max-pool gradients, then the document's mixture and threshold on a fifth that the filters didn't see."""
    if len(set(y.tolist())) < 2:
        return None
    rng, net = np.random.default_rng(seed), Network(seed)
    check = np.arange(len(y)) % 5 == 4
    if len(set(y[check].tolist())) < 2 or len(set(y[~check].tolist())) < 2:
        check[:] = False
    learn = [t for t, c in zip(texts, check, strict=True) if not c]
    rows, lengths, numbers = chunks(learn)
    goal = np.repeat(y[~check], numbers).astype(np.float32)
    weight = np.repeat(1 / numbers, numbers) * np.where(goal == 1, 0.5 / max(1, (y[~check] == 1).sum()), 0.5 / max(1, (y[~check] == 0).sum()))
    weight = (weight / weight.mean()).astype(np.float32)
    level = np.concatenate([levels(rows[i : i + 256], lengths[i : i + 256]) for i in range(0, len(rows), 256)])
    names = ("table", "rep", "bias", "w", "b")
    m, v, step = {k: np.zeros_like(getattr(net, k)) for k in names}, {k: np.zeros_like(getattr(net, k)) for k in names}, 0
    epochs = max(epochs, min(60, 4000 // max(1, len(rows) // 32)))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 32)):
            r, n, lev = rows[part], lengths[part], level[part]
            net.pairs = None
            # tables of single bytes here: building pairs for a small batch would cost more
            z = net.rep[lev] + net.bias
            half = CHUNK // 2
            for j in range(WIDTH):
                piece = r[:, j::2]
                piece = piece[:, :half] if piece.shape[1] >= half else piece
                z[:, : piece.shape[1]] += net.table[j][piece]
            z[np.arange(half) * 2 >= np.maximum(1, n)[:, None]] = -np.inf
            top = z.argmax(1)
            best = np.take_along_axis(z, top[:, None, :], 1)[:, 0, :]
            pool = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-np.clip(pool @ net.w + net.b, -30, 30)))
            d = ((p - goal[part]) * weight[part] / len(part)).astype(np.float32)
            grad = {k: np.zeros_like(getattr(net, k)) for k in names}
            grad["w"], grad["b"] = pool.T @ d, d.sum(keepdims=True)
            back = (d[:, None] * net.w) * (best > 0)
            grad["bias"] = back.sum(0)
            f = np.broadcast_to(np.arange(FILTERS), top.shape)
            np.add.at(grad["rep"], (np.take_along_axis(lev, top, 1), f), back)
            for j in range(WIDTH):
                where = top * 2 + j
                ok = where < CHUNK
                np.add.at(grad["table"], (j, np.take_along_axis(r, np.minimum(where, CHUNK - 1), 1), f), back * ok)
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                setattr(net, k, (getattr(net, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    net.pairs = None
    use = check if check.any() else np.ones(len(y), bool)
    kept = [t for t, c in zip(texts, use, strict=True) if c]
    rows, lengths, numbers = chunks(kept)
    x = Network.features(net.pooled(rows, lengths) @ net.w + net.b, numbers)
    net.mix = _mixture(x, y[use])
    # a good document rejected costs four bad ones kept
    net.cut = cut_between(x @ net.mix, y[use], below1=4.0)
    net.pairs = None
    return net


def _mixture(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of mean, least and greatest chunk score: ridge logistic regression around the plain mean."""
    scale = max(1e-6, x.std())
    z, w, c = x / scale, np.array([1.0, 0.0, 0.0]), 0.0
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(rounds):
        d = (1 / (1 + np.exp(-np.clip(z @ w + c, -30, 30))) - y) * each
        w -= 0.5 * (z.T @ d + 0.01 * (w - [1, 0, 0]))
        c -= 0.5 * d.sum()
    return w / scale


def trained(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network fitted on the labelled rows outside the held-out fold; None without rows of both classes."""
    rows = sample(docs, labels, "quality", FOLDS, HELD)
    net = fit(rows["text"].tolist(), rows["y"].to_numpy(dtype=np.int64))
    del rows
    give_back()
    return net


def probability(spark: SparkSession, net: Network | None):
    """The score as a function of a text column. The network (13 MB with its pair tables, built on the executors) travels as a broadcast of 0.1 MB."""
    model = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.value

        def drop() -> None:
            if own is not None:
                own.pairs = None

        claim("quality", drop)
        for x in parts:
            texts = x.tolist()
            yield pd.Series(np.full(len(texts), 0.5) if own is None else np.concatenate([np.zeros(0), *(own.probabilities(texts[i : i + _TEXTS]) for i in range(0, len(texts), _TEXTS))]))

    return of


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    scored = docs.select(F.col(id_col).alias("doc_id"), probability(docs.sparkSession, net)(F.col(text_col)).alias("score"))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` that are not predicted to be of low quality, all columns as they were, whatever their names; all of them without a model."""
    if net is None:
        return docs
    return flagged(docs, probability(docs.sparkSession, net)(F.col(text_col)) >= THRESHOLD)
