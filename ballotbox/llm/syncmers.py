"""Document fingerprints by closed syncmers.

A k-mer of code points is a closed syncmer when the least hash of its s-mers is its first or its last one. The
choice depends on the k-mer alone, so equal passages give equal anchors at equal distances wherever they stand
(``anchors``). A fingerprint is the bottom sketch of the distinct anchors, which grows with the text: the ``LEAST`` least hashes, or one in ``SHARE``
where that is more, each with the position of its first anchor. Likeness is the bottom-sketch estimate of the anchors' Jaccard
index by the smaller of both sketches, exact while both sets and their union have no more than ``LEAST``. Positions are
matched too: of the anchors that two sketches share, the largest number at one distance (``aligned``) tells which
passage both hold and how far it has moved.

The documents are dealt into ranges of descending ids; each range also gets the first document of the next one, so every document meets its
successor in one pass after one shuffle of the texts.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, alike (1) to
empty ones and unlike (0) all others; every other text has an anchor: one shorter than a k-mer is its own, one without a closed syncmer has its least
k-mer; very long texts are read whole; rows of one id are ordered by a hash of their text; null ids come last; with a single row the
next document is the row itself; an empty table gives no rows; further columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import claim, framed, ids_of, map_rows, stage

#: A sketch holds LEAST hashes (all, of a text with fewer), or one in SHARE of the distinct anchors where that is more.
K, S, LEAST, SHARE = 12, 5, 128, 8
#: Rows sampled for each range's border.
SAMPLED = 50
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return (x ^ (x >> np.uint64(29))) * _C >> np.uint64(32)


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A polynomial over each run of ``size`` codes, by doubling."""
    with np.errstate(over="ignore"):
        done, acc, power = 1, codes, _A
        out, have = None, 0
        while done <= size:
            if size & done:
                if out is None:
                    out = acc
                else:
                    m = len(codes) - have - done + 1
                    out = out[:m] * power + acc[have : have + m]
                have += done
            if done * 2 <= size:
                acc = acc[: len(acc) - done] * power + acc[done:]
                power = power * power
            done *= 2
        return out


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes (as uint64) of the closed syncmers, or of the one anchor that stands for them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(codes) < k:
            return np.zeros(1, np.int64), _hash(_grams(codes, len(codes)) + np.uint64(len(codes)))
        small = _hash(_grams(codes, s)).astype(np.uint32)
        span, m = k - s + 1, len(codes) - k + 1
        low, width = small, 1
        while width * 2 <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[:m], low[span - width : span - width + m])
        low = low[:m]
        at = np.flatnonzero((small[:m] == low) | (small[span - 1 : span - 1 + m] == low))
        grams = _grams(codes, k)
        if not len(at):
            at = np.array([np.argmin(_hash(grams))])
        return at, _hash(grams[at])


def fingerprint(text: str) -> str:
    """Base64 of the sketch's hashes, rising, then after a dot that of their positions; all big-endian 32-bit."""
    at, values = anchors(text)
    values, first = np.unique(values, return_index=True)
    size = max(LEAST, len(values) // SHARE)
    parts = (values[:size], at[first[:size]])
    return ".".join(base64.b64encode(x.astype(">u4").tobytes()).decode() for x in parts) if len(values) else ""


def parsed(print_: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a fingerprint that isn't empty."""
    return tuple(np.frombuffer(base64.b64decode(x), ">u4").astype(np.int64) for x in print_.split("."))


def likeness(a: str, b: str) -> float:
    """The bottom-sketch estimate of the Jaccard index of two fingerprints' anchors."""
    if not a or not b:
        return float(a == b)
    return _likeness(parsed(a)[0], parsed(b)[0])


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    least = np.union1d(x, y)[: max(LEAST, min(len(x), len(y)))]
    return float(np.isin(least, np.intersect1d(x, y, assume_unique=True), assume_unique=True).sum() / len(least))


def aligned(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int | None, int]:
    """Shared anchors at the commonest distance (of equal ones the least), that distance (position in b less that in a), and the code points of a from the
    first to the end of the last of them."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0, None, 0
    moved, times = np.unique(b[1][j] - a[1][i], return_counts=True)
    best = moved[np.argmax(times)]
    at = a[1][i][b[1][j] - a[1][i] == best]
    return int(times.max()), int(best), int(at.max() - at.min()) + K


def edit(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DONE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_matches long, edited_moved long, edited_span long, next_matches long, next_moved long, next_span long"


def _compared(a: str, b: str) -> tuple[float, tuple[int, int | None, int]]:
    if not a or not b:
        return float(a == b), (0, None, 0)
    x, y = parsed(a), parsed(b)
    return _likeness(x[0], y[0]), aligned(x, y)


def _row(doc_id, text: str, print_: str, following: str, next_print: str) -> tuple:
    edited = edit(text, following)
    edited_print = print_ if edited == text else fingerprint(edited)
    (near_edited, own), (near_next, other) = _compared(print_, edited_print), _compared(print_, next_print)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_, edited_print, near_edited, near_next, *own, *other


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row of a range with the one after it; a range ends with the guest, the first row of the next range."""
    claim("syncmers")
    columns, last = [x.split()[0] for x in _DONE.split(", ")], None
    for pdf in batches:
        out = []
        for doc_id, text, guest in zip(ids_of(pdf), pdf["text"].tolist(), pdf["guest"].tolist(), strict=True):
            now = doc_id, text, fingerprint(text)
            if last is not None:
                out.append(_row(*last, now[1], now[2]))
            last = None if guest else now
        yield framed(out, columns).astype({x.split()[0]: "Int64" for x in _DONE.split(", ") if x.endswith(" long")})


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document by descending id, and for both
    how many anchors match at the commonest distance, that distance, and the code points that they span.

    Borders of the ranges come from a sample of ids and hashes; ranges only share out the work, the rows don't depend on them.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # the order as values without nulls: null ids last, others falling, then the hash of the text
    order = [F.col("doc_id").isNull().alias("z"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("down"), F.col("tie").alias("t")]
    every = max(1, source.count() // (SAMPLED * ranges))
    sampled = source.filter(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(every)) == 0).select(*order).limit(4 * SAMPLED * ranges).collect()
    sampled = sorted(map(tuple, sampled))
    borders = sorted({sampled[len(sampled) * i // ranges] for i in range(1, ranges)}) if sampled else []

    @F.pandas_udf("int")
    def range_of(z: pd.Series, down: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, x) for x in zip(z.tolist(), down.tolist(), t.tolist(), strict=True)], dtype="int32")

    dealt = source.withColumn("part", range_of(*order))
    # one slim row a range, with the range that it visits: the last one before it, of the first range the very last
    heads = sorted(dealt.select("part", F.struct(*order).alias("o")).groupBy("part").agg(F.min("o").alias("o")).select("part", "o.z", "o.down", "o.t").collect())
    visits = [(heads[k - 1].part, None if h.z else ~h.down, h.t) for k, h in enumerate(heads)]
    firsts = stage(spark.createDataFrame(visits, "to int, id long, hash long"), "syncmer-heads")
    # a row a range; equal rows are one guest
    met = source.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("hash")))
    guests = met.groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    rows = dealt.select("doc_id", "text", "tie", "part", F.lit(False).alias("guest")).unionByName(guests.select("doc_id", "text", "tie", F.col("to").alias("part"), F.lit(True).alias("guest")))
    sorted_ = rows.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "tie")
    return map_rows(sorted_.select("doc_id", "text", "guest"), _neighbours, _DONE)
