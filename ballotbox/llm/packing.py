"""Order-preserving packing by dynamic programming.

The documents' ids form one stream in reading order. Windows of at most ``size`` tokens are cut from it at document ends,
sentence ends and, in sentences longer than a window, at every ``size`` tokens. The dynamic programme minimises padding
plus penalties for cut documents over each block of some ``BLOCK`` tokens: ``f(j) = min f(i) + pad(j - i) +
penalty(j)``. As padding is linear in ``i``, a monotone queue holds the least ``f(i) + i`` of the sliding range; lengths that are
powers of two, which need no padding, are transitions of their own. A block's last windows are carried
into the next block, so only a partition's last window is padded for want of text.

Defined results: a null or empty text is its closing id alone; repeated rows and null ids are documents like others;
an empty table gives no pieces; very long texts are packed whole, in as many windows as they need; further columns are ignored whatever their
names. Nothing is shuffled: a partition packs what it reads, and sequence ids are unique over partitions.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import claim, framed, ids_of, map_rows
from .units import Encoder, units

SIZE = 2048
BLOCK = 1 << 20
CUT_SENTENCE, CUT_INSIDE = 1.5, 24.0
#: Where a unit ends a sentence: a stop and closing quotes or brackets before a space, or a line end (the unit that holds it).
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?= )|\n")
SPECIAL = "<|endoftext|>"
#: Units kept in each of two generations, some 200 bytes each: the more, the fewer are encoded again, and the larger a Python worker.
TABLE = 700_000


def read_file(path: str) -> dict:
    """A tokenizers file whose texts may be encoded unit by unit: byte-level, split by the usual pattern, no normaliser, no space put in front. Others raise."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    split = file.get("pre_tokenizer") or {}
    if file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        raise ValueError("a tokenizer that isn't byte-level or changes texts before it splits them: units can't be encoded on their own")
    return file


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """bytes -> id of a byte-level BPE file whose ids are its merge order; None if the file is of another kind.

    Encoding by lowest rank is then the same as by the file's merges.
    """
    model = read_file(path)["model"]
    vocab, merges = model["vocab"], [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
    # the usual printable stand-ins of bytes: printable ones stand for themselves, the others follow from 256 on
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    stand = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    try:
        ranks = {bytes(stand[c] for c in t): i for t, i in vocab.items() if t != SPECIAL}
        ordered = all(vocab["".join(m)] == 256 + i for i, m in enumerate(merges)) and sorted(vocab[c] for c in stand) == list(range(256))
    except KeyError:
        return None
    return ranks if ordered and not model.get("ignore_merges") else None


@lru_cache(2)
def encoder(path: str, table: int = TABLE):
    """text -> (ids as bytes, token offsets of sentence ends), as the tokenizers library encodes it without adding special tokens.

    Units of Latin letters are encoded by merge rank where the file allows it (the same ids, ten times as fast); others, and all
    units of other files, by the library.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_padding()
    own.no_truncation()
    ranks = merge_ranks(path)
    quick = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None

    def ids_of(text: str) -> list[int]:
        return quick(text) if quick and (text.isascii() or max(text) < "\u0250") else own.encode(text, add_special_tokens=False).ids

    return Sentences(Encoder(ids_of, table))


#: The same characters as code points, for texts that are split at every space.
_STOPS, _CLOSERS = np.array([ord(c) for c in ".!?…。！？"], np.uint32), frozenset(ord(c) for c in "\"'”’»)]")


def sentence_units(text: str, parts: list[str]) -> np.ndarray:
    """Indices of the units in which a sentence ends, rising; one may come twice."""
    if len(parts) != text.count(" ") + 1:
        ends = np.fromiter([m.end() for m in SENTENCE_END.finditer(text)], np.int64)
        return np.searchsorted(np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1), ends)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    spaces = np.flatnonzero(codes == 32)
    before = codes[spaces - 1]  # a text of this kind doesn't begin with a space
    ended = np.zeros(len(spaces), bool)
    for c in _STOPS:
        ended |= before == c
    for k in np.flatnonzero((before < 128) & ((before == 34) | (before == 39) | (before == 41) | (before == 93)) | (before == 0x201D) | (before == 0x2019) | (before == 0xBB)).tolist():
        at = int(spaces[k]) - 2
        while at >= 0 and int(codes[at]) in _CLOSERS:
            at -= 1
        ended[k] = at >= 0 and codes[at] in _STOPS
    out = np.flatnonzero(ended)
    if "\n" in text:
        out = np.sort(np.concatenate([out, np.searchsorted(spaces, np.flatnonzero(codes == 10))]))
    return out


class Sentences:
    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        if not text:
            return b"", []
        parts = units(text)
        got = [self.encoder.first[parts[0]], *map(self.encoder.later.__getitem__, parts[1:])]
        n = len(parts)
        # the units in which sentences end, then the tokens up to those units' ends
        at = np.unique(sentence_units(text, parts))
        tokens = np.cumsum(np.fromiter(map(len, got), np.int64, n)) // 4
        return b"".join(got), tokens[at[at < n]].tolist()


def cut(positions: list[int], penalties: list[float], size: int = SIZE) -> list[int]:
    """Indices of the chosen cuts, first and last included: least padding plus penalties with windows of at most ``size``.

    ``positions`` rises strictly from the stream's start to its end, by at most ``size`` a step.
    """
    n = len(positions)
    cost, back = [0.0] * n, [0] * n
    index = {p: i for i, p in enumerate(positions)}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    queue: deque[int] = deque([0])
    key = [0.0] * n  # cost + position
    key[0] = positions[0]
    get = index.get
    for j in range(1, n):
        here = positions[j]
        while positions[queue[0]] < here - size:
            queue.popleft()
        i = queue[0]
        best = key[i] + size - here
        for p in powers:
            o = get(here - p)
            if o is not None and cost[o] < best:
                best, i = cost[o], o
        best += penalties[j]
        cost[j], back[j], k = best, i, best + here
        key[j] = k
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, size: int, closing: int, block: int, table: int = TABLE):
    end_bytes = np.asarray([closing], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("packing", encoder.cache_clear)
        encode = encoder(path, table)
        sequence = TaskContext.get().partitionId() << 32
        # the open stream: (doc_id, tokens of the document, its ids from ``start`` on, start, sentence ends from start on)
        open_: list[list] = []
        tokens = 0

        def solve(final: bool) -> Iterator[pd.DataFrame]:
            nonlocal open_, tokens, sequence
            positions, penalties, at = [0], [0.0], 0
            for _, _, data, start, ends in open_:
                n = len(data) // 4
                for e in ends:
                    if start < e < start + n:
                        _reach(positions, penalties, at + e - start, CUT_SENTENCE, size)
                _reach(positions, penalties, at + n, 0.0, size)
                at += n
            chosen = [positions[i] for i in cut(positions, penalties, size)]
            if not final:
                # windows near the block's end were chosen without the text after it
                chosen = chosen[: max(2, len(chosen) - 16)]
            rows, stop = [], chosen[-1]
            at, w = 0, 0
            rest: list[list] = []
            for doc_id, total, data, start, ends in open_:
                n = len(data) // 4
                a = 0
                while a < n and at + a < stop:
                    while chosen[w + 1] <= at + a:
                        w += 1
                    b = min(n, chosen[w + 1] - at)
                    rows.append((doc_id, start + a, b - a, zlib.crc32(data[4 * a : 4 * b]), total, sequence + w, at + a - chosen[w]))
                    a = b
                if a < n:
                    rest.append([doc_id, total, data[4 * a :], start + a, [e for e in ends if e > start + a]])
                at += n
            sequence += len(chosen) - 1
            open_, tokens = rest, at - stop
            yield framed(rows, [x.split()[0] for x in _PIECE.split(", ")])

        for pdf in batches:
            for doc_id, text in zip(ids_of(pdf), pdf["text"].tolist(), strict=True):
                parts = (text or "").split(SPECIAL)
                data, ends = encode(parts[0])
                for x in parts[1:]:
                    more, further = encode(x)
                    n = len(data) // 4 + 1
                    data, ends = data + _special(path) + more, ends + [n + e for e in further]
                data += end_bytes
                open_.append([doc_id, len(data) // 4, data, 0, ends])
                tokens += len(data) // 4
                if tokens >= block:
                    yield from solve(False)
        if open_:
            yield from solve(True)

    return run


@lru_cache(2)
def _special(path: str) -> bytes:
    from tokenizers import Tokenizer

    return np.asarray([Tokenizer.from_file(path).token_to_id(SPECIAL)], dtype="<u4").tobytes()


def _reach(positions: list[int], penalties: list[float], to: int, penalty: float, size: int) -> None:
    """Append a candidate; inside a stretch longer than a window, cuts at every ``size`` tokens before it."""
    while to - positions[-1] > size:
        positions.append(positions[-1] + size)
        penalties.append(CUT_INSIDE)
    if to > positions[-1]:
        positions.append(to)
        penalties.append(penalty)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, closing: int = 1, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, table: int = TABLE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer``: the path of a tokenizers file, readable on every executor; ``closing``: the id that ends each document; ``table``: see ``TABLE``.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(source, _pack(tokenizer, size, closing, block, table), _PIECE)


