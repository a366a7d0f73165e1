"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved down to leaves; a leaf is encoded by itself into a node: the anchored units of the leaf with the ids
of each. Joining two neighbours re-encodes a window around the seam, the left one's last unit and the right one's first. A window
without an anchor inside becomes an open end of the joined node and grows with the next join, until anchors (or the text's ends) stand on
both sides. A cut at an anchor depends on no text around it (see ``units``), so tokens outside such a window provably stay. Joining
is associative, so any shape of the tree gives the same ids. Decoding maps each leaf's ids to bytes and concatenates up the same tree.

Defined results: a null text counts as empty; an empty text has no ids; very long texts are encoded whole, one without anchors being re-encoded at each
of the tree's levels; repeated rows and null ids are rows like others; an empty table gives no rows; further columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import claim, map_rows
from .units import ANCHOR, Encoder, rank_bytes, rank_encoder, units

LEAF = 2048


class Node:
    """A stretch of text: its first and last unit as text, ids of all units. ``head`` and ``tail`` are the units that a seam may
    change; ``ids`` holds those of the units between, and ``one`` tells that the stretch is a single unit (then it is ``head``)."""

    __slots__ = ("head", "ids", "tail", "one", "head_ids", "tail_ids")

    def __init__(self, head, ids, tail, one, head_ids, tail_ids):
        self.head, self.ids, self.tail, self.one, self.head_ids, self.tail_ids = head, ids, tail, one, head_ids, tail_ids

    def joined(self) -> list[bytes]:
        return [self.head_ids] if self.one else [self.head_ids, *self.ids, self.tail_ids]


def leaf(text: str, encoder: Encoder) -> Node:
    parts = units(text)
    if len(parts) == 1:
        return Node(text, [], "", True, encoder.first[text], b"")
    later = encoder.later
    return Node(parts[0], list(map(later.__getitem__, parts[1:-1])), " " + parts[-1], False, encoder.first[parts[0]], later[parts[-1]])


def join(a: Node, b: Node, encoder: Encoder) -> Node:
    left, right = (a.head if a.one else a.tail), b.head
    window = left + right
    # the seam itself may be an anchor, or a space just beside it may become one
    found = [m.start() for m in ANCHOR.finditer(window)]
    cuts = [0, *found, len(window)]
    parts = [window[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
    ids = [encoder.first[parts[0]], *(encoder.later[x[1:]] for x in parts[1:])]
    before = [] if a.one else [a.head_ids, *a.ids]
    after = [] if b.one else [*b.ids, b.tail_ids]
    every = before + ids + after
    if len(every) == 1:
        return Node(window, [], "", True, every[0], b"")
    head = parts[0] if a.one else a.head
    tail = parts[-1] if b.one else b.tail
    return Node(head, every[1:-1], tail, False, every[0], every[-1])


def encode(text: str, encoder: Encoder, size: int = LEAF) -> Node:
    if len(text) <= size:
        return leaf(text, encoder)
    half = len(text) // 2
    return join(encode(text[:half], encoder, size), encode(text[half:], encoder, size), encoder)


def ids_of(text: str, encoder: Encoder, size: int = LEAF) -> bytes:
    """The text's ids as little-endian unsigned 32-bit integers."""
    return b"".join(encode(text, encoder, size).joined()) if text else b""


def decode(ids: np.ndarray, table: list[bytes], size: int = LEAF) -> bytes:
    if len(ids) <= size:
        return b"".join(map(table.__getitem__, ids.tolist()))
    half = len(ids) // 2
    return decode(ids[:half], table, size) + decode(ids[half:], table, size)


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEAF, keep: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ``ids array<long>`` and ``decoded``.

    ``ranks``: the path of a rank file, readable on every executor.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("bpe", rank_encoder.cache_clear)
        encoder, table = rank_encoder(ranks, pattern), rank_bytes(ranks)
        for pdf in batches:
            out = []
            for text in pdf["text"].tolist():
                data = ids_of(text or "", encoder, size)
                ids = np.frombuffer(data, "<u4")
                back = decode(ids, table, size)
                out.append((len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(back).hexdigest(), *((ids.astype(np.int64), back.decode()) if keep else ())))
            columns = [x.split()[0] for x in schema.split(", ")][1:]
            yield pd.concat([pdf[["doc_id"]].astype("Int64").reset_index(drop=True), pd.DataFrame(out, columns=columns)], axis=1)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(source, run, schema)
