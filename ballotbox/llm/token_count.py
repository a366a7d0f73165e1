"""Token counts by overlap resynchronisation.

A text longer than ``CHUNK`` code points is encoded in chunks that overlap. Each chunk's encoding gives the offsets at which
anchored units begin and the tokens before each. Two neighbouring chunks are spliced at an offset within their
overlap at which both have such a boundary; the vocabulary has no piece that spans it (``check_marks``
proves that when the model is loaded), so the tokens on either side are those of the whole text. Where the overlap has no common
boundary, the later chunk starts earlier: the overlap doubles until one is found, or until both chunks are one, which then
doubles its length until it holds one; so a text without spaces costs time in proportion to its length too.

Defined results: null and empty texts have no tokens and no bytes; very long texts are counted whole; repeated rows and null ids are rows
like others; an empty table gives no rows; further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import claim, map_rows
from .units import Kept, units

CHUNK, OVERLAP, LIMIT = 16_384, 256, 4096


def check_marks(model) -> None:
    """Raise unless no piece holds the space mark after another character, and a leading space is one mark more."""
    for i in range(model.get_piece_size()):
        if "▁" in model.id_to_piece(i).lstrip("▁"):
            raise ValueError(f"piece {i} spans words: units can't be counted on their own")
    if model.encode("a b", out_type=str) != model.encode("a", out_type=str) + model.encode("b", out_type=str):
        raise ValueError("the model does not mark the start of a text like a space")


@lru_cache(2)
def counter(path: str) -> Kept:
    """unit -> its number of tokens; a unit stands for itself with a space before it, which the model adds to a text's start too."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_marks(model)
    return Kept(lambda u: len(model.encode(u)), most=150_000)


def offsets(text: str, counts: Kept) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of unit boundaries (of the space before each but the first unit) and tokens before each, the text's end included."""
    parts = units(text)
    n = len(parts)
    tokens = np.fromiter(map(counts.__getitem__, parts), np.int64, n)
    sizes = np.fromiter(map(len, parts), np.int64, n) + 1
    at = np.concatenate([[0], np.cumsum(sizes) - 1])
    return at, np.concatenate([[0], np.cumsum(tokens)])


def count(text: str, counts: Kept, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    n = len(text)
    if n <= chunk:
        return sum(map(counts.__getitem__, units(text))) if text else 0
    # spliced so far: ``total`` tokens before ``cut``; the open chunk is [start, end) with its boundaries
    start, end = 0, chunk
    at, before = offsets(text[:end], counts)
    total, base = 0, 0  # tokens before the open chunk's splice point; tokens of the open chunk before that point
    while end < n:
        width, begin = overlap, start
        while len(at) > 2:
            begin = max(start, end - width)
            if begin == start:
                break
            # as far beyond the open chunk's end as it reaches back, so that a wide overlap is paid for by as much new text
            stop = min(n, max(begin + chunk, 2 * end - begin))
            at2, before2 = offsets(text[begin:stop], counts)
            # both chunks' inner boundaries: a chunk's own first and last offset are no boundaries of the text
            mine, theirs = at[1:-1] + start, at2[1:-1] + begin
            common = np.intersect1d(mine, theirs, assume_unique=True)
            if len(common):
                break
            width *= 2
        if begin == start:  # no stable boundary in the whole chunk: it grows to twice its length, so all encodings of it cost some twice the last one
            end = min(n, start + 2 * (end - start))
            at, before = offsets(text[start:end], counts)
            continue
        splice = int(common[len(common) // 2])
        total += int(before[np.searchsorted(at, splice - start)]) - base
        start, end, at, before = begin, stop, at2, before2
        base = int(before[np.searchsorted(at, splice - begin)])
    return total + int(before[-1]) - base


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit. ``model``: the path of a sentencepiece model on every executor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("counts", counter.cache_clear)
        counts = counter(model)
        for pdf in batches:
            texts = [x or "" for x in pdf["text"].tolist()]
            n = np.array([count(x, counts, chunk, overlap) for x in texts], np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(x.encode()) for x in texts], "n_tokens": n, "over_limit": n > limit})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(source, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
