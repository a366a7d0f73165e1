"""Exact duplicates by Golomb-coded fingerprint exchange.

Each sender (a partition's run of some ``SEGMENT`` rows) sorts the fingerprints of its texts and
sends them, Rice-coded as gaps, to the owners of their ranges, one owner for each ``OWNER_ROWS`` rows of the table. An owner answers
each sender with a bitmap over the sender's sorted list: set where another sender, or the sender itself, holds the
fingerprint again. Only rows under set bits are suspects; their texts are read again and compared byte for byte, and
they alone are joined by digest. All other rows stay where they are.

Defined results: a null text counts as empty, empty texts are copies of one another; of fully equal rows
(same id, same text) exactly one is kept; rows with a null id take part like others and come after other ids
in ties; an empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, WHITE, claim, discard, keep_matching, map_rows, sized, stage

FP_BITS = 48
#: Rows of a sender's list at most (but for the last batch), and rows for each so many of which there is one owner.
SEGMENT, OWNER_ROWS = 500_000, 1_000_000


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct non-negative integers as one byte of parameter, quotients in unary, then fixed-width remainders."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    r = max(0, int(np.log2(max(1.0, float(gaps.mean())))))
    quotients = gaps >> r
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(r)) & 1).astype(np.uint8).ravel()
    return bytes([r]) + np.packbits(np.concatenate([unary, rest])).tobytes()


def rice_decode(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    r = blob[0]
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=1))
    # the unary part ends with its n-th set bit
    ends = np.flatnonzero(bits)[:n]
    start = int(ends[-1]) + 1
    quotients = np.diff(ends, prepend=-1) - 1
    rest = bits[start : start + n * r].reshape(n, r).astype(np.int64) @ (np.int64(1) << np.arange(r, dtype=np.int64)) if r else np.zeros(n, np.int64)
    return np.cumsum((quotients.astype(np.int64) << r) + rest + 1) - 1


_ROW = "row_no long, doc_id long, n_chars long, hash long, sha binary"
_SENT = f"{_ROW}, sender long, owner int, rank int, n int, blob binary, multi binary, kind int"


def _senders(n_owners: int):
    """Kind 0: the rows as they came with their sender, owner and place in the list that it is sent; kind 1: the lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("exact")
        columns, integers = [x.split()[0] for x in _SENT.split(", ")], ("row_no", "doc_id", "n_chars", "hash", "sender", "owner", "rank", "n")
        sender, held, size = TaskContext.get().partitionId() << 20, [], 0

        def shaped(of: dict) -> pd.DataFrame:
            return pd.DataFrame({c: of.get(c) for c in columns}).astype(dict.fromkeys(integers, "Int64"))

        def sent() -> Iterator[pd.DataFrame]:
            rows = pd.concat(held, ignore_index=True)
            fps = (rows["hash"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - FP_BITS)).astype(np.int64)
            distinct, where, counts = np.unique(fps, return_inverse=True, return_counts=True)
            owners = owner_of(distinct, n_owners)
            first = np.concatenate([[0], np.flatnonzero(np.diff(owners)) + 1])
            ranks = np.arange(len(distinct)) - np.repeat(first, np.diff(np.append(first, len(distinct))))
            yield shaped({c: rows[c] for c in rows} | {"kind": 0, "sender": sender, "owner": owners[where], "rank": ranks[where]})
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(distinct)], strict=True))
            yield shaped({"kind": 1, "sender": [sender] * len(cuts), "owner": owners[first], "n": [j - i for i, j in cuts], "blob": [rice_encode(distinct[i:j]) for i, j in cuts], "multi": [np.packbits(counts[i:j] > 1).tobytes() for i, j in cuts]})

        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= SEGMENT:
                yield from sent()
                sender, held, size = sender + 1, [], 0
        if size:
            yield from sent()

    return run


def owner_of(fingerprints: np.ndarray, n_owners: int) -> np.ndarray:
    """Owners of ranges of about equal width; rising with the fingerprint."""
    step = -(-(1 << FP_BITS) // n_owners)
    return fingerprints // step


def _owner(pdf: pd.DataFrame) -> pd.DataFrame:
    """One owner: which of the fingerprints that it was sent occur more than once, as a bitmap for each sender."""
    lists = [rice_decode(b, n) for b, n in zip(pdf["blob"], pdf["n"], strict=True)]
    multi = [np.unpackbits(np.frombuffer(m, np.uint8))[: len(x)].astype(bool) for m, x in zip(pdf["multi"], lists, strict=True)]
    every = np.concatenate(lists)
    again, counts = np.unique(every, return_counts=True)
    again = again[counts > 1]
    bitmaps = [np.packbits(np.isin(x, again, assume_unique=True) | m).tobytes() for x, m in zip(lists, multi, strict=True)]
    return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "bitmap": bitmaps})


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical without ASCII white space. The row with the most code points stays,
    then the smallest id, then the first row read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    norm = F.translate("text", WHITE, "")
    # the JVM normalises and hashes; the senders sort and code the hashes of these slim rows
    slim = source.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", F.length("text").cast("long").alias("n_chars"), norm.alias("norm"))
    slim = stage(slim.select("row_no", "doc_id", "n_chars", F.xxhash64("norm").alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-rows")
    n_rows = slim.count()
    n_owners = max(1, -(-n_rows // OWNER_ROWS))
    sent = stage(map_rows(slim, _senders(n_owners), _SENT), "exact-sent", ("kind",))
    discard(slim)
    rows = sent.filter("kind = 0").select("row_no", "doc_id", "n_chars", "hash", "sha", "sender", "owner", "rank")
    lists = sent.filter("kind = 1").select("sender", "owner", "n", "blob", "multi")
    bitmaps = stage(lists.groupBy("owner").applyInPandas(_owner, "sender long, owner int, bitmap binary"), "exact-bitmaps")
    byte = F.conv(F.hex(F.substring("bitmap", F.expr("rank div 8 + 1"), F.lit(1))), 16, 10).cast("int")
    again = F.expr("(shiftright(byte, 7 - rank % 8) & 1) = 1")
    # a bit a row: beyond the bound both sides are shuffled by list, which are of about one size
    answers = F.broadcast(bitmaps) if n_rows // 8 <= BROADCAST_BYTES // 2 else bitmaps
    met = rows.join(answers, ["sender", "owner"]).withColumn("byte", byte).withColumn("suspect", again)
    marked = stage(met.select("row_no", "doc_id", "n_chars", "hash", "sha", "suspect"), "exact-marked", ("suspect",))
    for done in (sent, bitmaps):
        discard(done)
    alone, suspects = (marked.filter(F.col("suspect") == x).drop("suspect") for x in (False, True))

    # byte verification: the texts of the suspects, grouped by their very bytes
    hashes = stage(suspects.select("hash").distinct(), "exact-hashes")
    texts = keep_matching(source.select(norm.alias("norm")).withColumn("hash", F.xxhash64("norm")), hashes, "hash")
    verified = texts.groupBy("norm").agg(F.count("*").alias("size")).filter("size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "size")
    order = F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("row_no").alias("r"))
    best = suspects.groupBy("sha").agg(F.count("*").alias("n"), F.min(order).alias("b"))
    size = F.when(F.col("n") == F.col("size"), F.col("size")).otherwise(F.raise_error(F.lit("equal digests of different texts"))).cast("long")
    # staged, so that the join below is one that Spark may split at a frequent digest
    groups = stage(verified.join(best, "sha").select("sha", size.alias("group_size"), F.col("b.d").alias("keep_id"), F.col("b.r").alias("keep_row")), "exact-groups")
    discard(hashes)

    own = suspects.join(sized(groups), "sha", "left")
    found = own.select(
        "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row_no"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_chars",
    )
    rest = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_chars")
    return rest.unionByName(found)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, the one that ``exact_groups`` keeps; all columns as they were.

    Rows are matched by id and digest. Where one id has several rows of one group, the longest text of them stays.
    """
    groups = exact_groups(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("__stays"), F.count("*").alias("__n"))
    marked = stage(groups.filter("not __stays or __n > 1").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "__stays"), "exact-marked")
    sha = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), WHITE, ""), 256)
    met = docs.withColumn("__text_sha", sha).join(sized(marked), (F.col("__text_sha") == F.col("__sha")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left")
    once = Window.partitionBy(id_col, "__text_sha").orderBy(F.length(text_col).desc_nulls_last())
    repeated = met.filter("__stays").withColumn("__rank", F.row_number().over(once)).filter("__rank = 1")
    return met.filter("__stays is null").select(*docs.columns).unionByName(repeated.select(*docs.columns))
