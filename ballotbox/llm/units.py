"""Anchored units: pieces of a text that any of the vocabularies encodes on their own.

A space with a non-space on both sides always begins a new match of the byte-level pattern: no
alternative spans a space but in front, and no choice made before the space looks beyond it. So the
ids of a text are those of its units in turn, whatever stands around them. In the sentencepiece
vocabulary no piece holds the space mark after another character (``check_marks``), so merges never
cross such a point either. Encodings of units are kept in a bounded table of the Python worker.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

ANCHOR = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


#: White space other than the space and the line feed, and the space mark: texts with any of them, or with spaces beside
#: white space, are split by the pattern; all others at every space, which is the same there and faster.
_RARE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")


def units(text: str) -> list[str]:
    """The units of a text; a space before each but the first is left out."""
    if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or _RARE.search(text):
        return ANCHOR.split(text)
    return text.split(" ")


class Kept(dict):
    """unit -> what ``encode`` gives for it, in two generations of at most ``most`` units (some 200 bytes each), so a worker's memory stays bounded.

    When the young generation is full it becomes the old one; what is asked for again moves back.
    """

    def __init__(self, encode, most: int = 150_000, longest: int = 64):
        super().__init__()
        self.encode, self.most, self.longest, self.old = encode, most, longest, {}

    def __missing__(self, unit):
        got = self.old.get(unit)
        if got is None:
            got = self.encode(unit)
        if len(unit) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[unit] = got
        return got


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" and array("I").itemsize == 4 else np.asarray(ids, dtype="<u4").tobytes()


class Encoder:
    """Encodes texts unit by unit; ``joined`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, ids_of, most: int = 150_000):
        self.first = Kept(lambda u: id_bytes(ids_of(u)), most)
        self.later = Kept(lambda u: id_bytes(ids_of(" " + u)), most)

    def pieces(self, text: str) -> list[bytes]:
        parts = units(text)
        return [self.first[parts[0]], *map(self.later.__getitem__, parts[1:])]

    def joined(self, text: str) -> bytes:
        return b"".join(self.pieces(text)) if text else b""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def tiktoken_of(path: str, pattern: str):
    import tiktoken

    ranks = read_ranks(path)
    return tiktoken.Encoding(f"own-{len(ranks)}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def rank_encoder(path: str, pattern: str) -> Encoder:
    return Encoder(tiktoken_of(path, pattern).encode_ordinary)


@lru_cache(4)
def rank_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        out[v] = k
    return out
