"""Line dedup by winnowing over line hashes, and over words where a repeat isn't made of whole lines.

:func:`dedup_lines` compares runs of whole lines, :func:`dedup_passages` runs of words wherever they stand; the latter deletes all that the former does.

Lines: a document is the sequence of its non-blank lines (ASCII white space stripped at both ends). Its windows are the shortest runs
of whole lines with at least ``least`` words that start at a line, and those that end at one; together they cover every run
of at least ``least`` words. Each window selects its line with the least hash (the last of equal ones), which depends on the
window's content alone: two equal runs of ``least`` words are guaranteed to share a selected fingerprint. Fingerprints that stand
at two positions or more are joined by position; windows around them that equal an earlier window (by document id, row,
line) are later repeats. Overlapping and adjoining windows merge, so a match extends both ways to its whole run, and the
run's lines are deleted from the later document; the first occurrence stays.

Words: a document is the sequence of its words (between ASCII white space, line ends among it), its windows are all its runs of ``least``
words, and each window's fingerprint is the least hash of its runs of ``least // 4`` words. Neighbouring windows of one fingerprint make
an entry; only entries whose fingerprint comes back are looked at further. An entry equal to an earlier one is a repeat as a whole;
the windows of the others, at the ends of passages, are hashed and compared one by one. So every window that equals an
earlier one is found, and its words are deleted with the white space behind them. Lines that lose all words are deleted as such.

Defined results: a null text counts as empty and stays null; blank lines are never deleted; a window that overlaps its own first
occurrence is no repeat; of fully repeated rows the first read keeps its lines; rows with null ids come last in order; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WHITE, Scratch, claim, discard, framed, ids_of, keep_matching, map_rows, sized, stage

LEAST_WORDS = 50
#: Texts are hashed in groups of so many bytes, longer ones alone.
GROUP_BYTES = 1 << 20

_MIX, _BASE = np.uint64(0xBF58476D1CE4E5B9), 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_SOLID = np.ones(256, bool)
_SOLID[list(WHITE.encode())] = False
_WORD = re.compile(f"[^{WHITE}]+[{WHITE}]*")


def line_hashes(text: str | None) -> tuple[list[int], list[bytes], list[int]]:
    """Line numbers, 128-bit hashes and word counts of the non-blank lines."""
    import xxhash

    numbers, hashes, counts = [], [], []
    for i, line in enumerate((text or "").split("\n")):
        line = line.strip(WHITE)
        if line:
            numbers.append(i)
            hashes.append(xxhash.xxh3_128_digest(line.encode()))
            counts.append(len(line.encode().split()))
    return numbers, hashes, counts


def windows(counts: list[int], least: int) -> list[tuple[int, int]]:
    """Shortest runs (first, last) of at least ``least`` words that start, or end, at each line."""
    total = np.concatenate([[0], np.cumsum(counts)]) if counts else np.zeros(1)
    n = len(counts)
    last = np.searchsorted(total, total[:-1] + least) - 1
    found = {(i, int(j)) for i, j in enumerate(last) if j < n}
    first = np.searchsorted(total, total[1:] - least, side="right") - 1
    found.update((int(i), j) for j, i in enumerate(first) if i >= 0)
    return sorted(found)


def _entries(least: int):
    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("lines", _POWERS.clear)
        for pdf in batches:
            out = []
            for row_no, doc_id, text in zip(pdf["row_no"].tolist(), ids_of(pdf), pdf["text"].tolist(), strict=True):
                numbers, hashes, counts = line_hashes(text)
                for i, j in windows(counts, least):
                    pick = min(range(i, j + 1), key=lambda k: (hashes[k], -k))
                    out.append((row_no, doc_id, numbers[i], numbers[j], int.from_bytes(hashes[pick][:8], "little", signed=True), xxhash.xxh3_64_intdigest(np.int64([row_no, pick]).tobytes()) >> 1, xxhash.xxh3_128_digest(b"".join(hashes[i : j + 1]))))
            yield framed(out, ["row_no", "doc_id", "i", "j", "fp", "place", "win"], at=1)

    return run


def repeated_lines(rows: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Staged ``(row_no, a array<int>, b array<int>)``: first and last lines of the runs to delete, for staged ``rows(row_no, doc_id, text)``."""
    scratch = Scratch()
    entries = scratch.stage(map_rows(rows, _entries(least), "row_no long, doc_id long, i int, j int, fp long, place long, win binary"), "lines-windows")
    # fingerprints at two places or more; a few bytes for each leave a task, however often one repeats there
    again = scratch.stage(entries.groupBy("fp").agg(F.min("place").alias("p"), F.max("place").alias("q")).filter("p <> q").select("fp"), "lines-again")
    suspects = scratch.stage(entries.join(sized(again), "fp", "left_semi").select("row_no", "doc_id", "i", "j", "win"), "lines-suspects")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_no", "i")
    first = suspects.groupBy("win").agg(F.min(F.struct(order.alias("at"), F.col("j").alias("end"))).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = scratch.stage(first.select("win", F.col("first.at.row_no").alias("first_row"), F.col("first.end").alias("end")), "lines-firsts")
    later = suspects.join(sized(first), "win").filter((F.col("row_no") != F.col("first_row")) | (F.col("i") > F.col("end")))
    # a row's windows are bounded by its lines
    out = stage(later.groupBy("row_no").agg(F.collect_list(F.struct("i", "j")).alias("x")).select("row_no", F.col("x.i").alias("a"), F.col("x.j").alias("b")), "lines-cuts")
    scratch.clear()
    return out


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # whole texts, written and read a few times: a fast codec
    return stage(source.withColumn("row_no", F.monotonically_increasing_id()), "lines-rows", codec="snappy")


def without_lines(text: str, a: list[int], b: list[int]) -> tuple[list[int], str]:
    """Lines deleted and what is left when the lines from each ``a`` to ``b`` go, blank ones excepted; time in proportion to text and runs."""
    lines = text.split("\n")
    gone = _covered(len(lines), a, np.asarray(b, np.int64) + 1)
    removed = [i for i, line in enumerate(lines) if gone[i] and line.strip(WHITE)]
    dropped = set(removed)
    return removed, "\n".join(x for i, x in enumerate(lines) if i not in dropped)


def _covered(n: int, first: list[int], end: np.ndarray) -> list[bool]:
    """Which of ``n`` places lie in a run ``first:end``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.asarray(first, np.int64), 1)
    np.add.at(edge, end, -1)
    return (np.cumsum(edge)[:n] > 0).tolist()


def _cut(run, kind: str):
    """``run`` over the texts of rows that lose something; the others stay as they are."""

    @F.pandas_udf(kind)
    def cut(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        columns = [x.split()[0] for x in kind.split(", ")]
        out = [(None,) * len(columns) if t is None or x is None else run(t, x, y) for t, x, y in zip(text, a, b, strict=True)]
        return pd.DataFrame(out, columns=columns).astype({"words": "Int64"} if "words" in columns else {})

    return cut(F.when(F.col("a").isNotNull(), F.col("text")), "a", "b")


def _without(rows: DataFrame, cuts: DataFrame, run, kind: str, *more: Column) -> DataFrame:
    """The result for ``rows`` and the staged ``cuts(row_no, a, b)``. Only texts that lose something are shuffled, as long as their numbers may be broadcast; what is left of them is
    staged, so Python gets them in small batches."""
    ids = sized(cuts.select("row_no"))
    lost = rows.join(ids, "row_no", "left_semi").join(cuts, "row_no").withColumn("x", _cut(run, kind))
    lost = stage(_told(lost, *more), "lines-lost")
    struct = ",".join(x.replace(" ", ":", 1) for x in kind.split(", "))
    whole = rows.join(ids, "row_no", "left_anti").withColumns({c: F.lit(None).cast("array<int>") for c in "ab"} | {"x": F.lit(None).cast(f"struct<{struct}>")})
    return _told(whole, *more).unionByName(lost)


def _told(met: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return met.select(
        "doc_id",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("a").isNull(), 0).otherwise(F.size("x.lines")).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("x.lines").cast("array<string>"), ","), F.lit("")).alias("removed"),
        F.when(F.col("a").isNull(), F.col("text")).otherwise(F.col("x.text")).alias("text"),
        *more,
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, removed (0-based line numbers, comma-separated), text (what is left)."""
    rows = numbered(docs, id_col, text_col)
    return _without(rows, repeated_lines(rows, least), without_lines, "lines array<int>, text string")


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64 at least."""
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, GROUP_BYTES), base, np.uint64)]))
    return _POWERS[base]


def run_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[first:end]``: a polynomial by prefix sums, mixed with the run's length."""
    n = len(values)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, n)[:n])])
    x = (total[end] - total[first]) * _powers(_INVERSE, n + 1)[first] + (end - first).astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (and the last one's end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edges = np.flatnonzero(np.diff(_SOLID[data], prepend=False))
    hashes = run_hashes(data.astype(np.uint64) + np.uint64(1), edges[::2], edges[1::2])
    return hashes, np.searchsorted(edges[::2], np.cumsum([0, *(len(t) + 1 for t in texts)]))


def _groups(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    at, size, texts = 0, 0, []
    for k, text in enumerate(pdf["text"].tolist()):
        text = (text or "").encode()
        if texts and size + len(text) > GROUP_BYTES:
            yield pdf.iloc[at:k], texts
            at, size, texts = k, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield pdf.iloc[at:], texts


def word_entries(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """Text, first and last window, fingerprint and hash of all the words of each entry."""
    words, at = word_hashes(texts)
    k = max(1, least // 4)
    m, span = len(words) - least + 1, least - k + 1
    if m < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    start = np.arange(len(words) - k + 1)
    low, width = run_hashes(words, start, start + k), 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[:m], low[span - width : span - width + m])
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    inside = text[:m] == text[least - 1 :]
    new = np.ones(m, bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:m] != text[: m - 1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], m) - 1
    first, last = first[inside[first]], last[inside[first]]
    own = text[first]
    return own, first - at[own], last - at[own], low[first], run_hashes(words, first, last + least)


def _word_entries(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("lines", _POWERS.clear)
        for pdf in batches:
            for part, texts in _groups(pdf):
                own, a, b, fp, body = word_entries(texts, least)
                yield pd.DataFrame({"row_no": part["row_no"].to_numpy()[own], "doc_id": part["doc_id"].astype("Int64").array[own], "a": a, "b": b, "fp": fp.view(np.int64), "body": body.view(np.int64)})

    return run


def _word_windows(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("lines", _POWERS.clear)
        for pdf in batches:
            for part, texts in _groups(pdf):
                words, at = word_hashes(texts)
                n = [len(x) for x in part["a"]]
                own = np.repeat(np.arange(len(texts)), n)
                a, b, fp = (np.concatenate([np.asarray(x, np.int64) for x in part[c]]) for c in ("a", "b", "fp"))
                each = np.repeat(np.arange(len(own)), b - a + 1)
                pos = np.arange(len(each)) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1) + a[each]
                start = at[own[each]] + pos
                yield pd.DataFrame({"row_no": part["row_no"].to_numpy()[own[each]], "doc_id": part["doc_id"].astype("Int64").array[own[each]], "pos": pos, "fp": fp[each], "win": run_hashes(words, start, start + least).view(np.int64)})

    return run


def repeated_words(rows: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Staged ``(row_no, a array<int>, b array<int>)``: the first and last of neighbouring windows that equal earlier ones, for staged ``rows(row_no, doc_id, text)``.

    Counts and firsts are staged before they are joined by fingerprint, so that Spark may split the rows of a frequent passage. Those joins shuffle at every size: the lists
    grow with the text."""
    scratch = Scratch()

    def order(at: str):
        return F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_no", F.col(at).alias("at"))

    def later(at: str):
        return (F.col("row_no") != F.col("first_row")) | (F.col(at) >= F.col("first_at") + least)

    def flat(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, F.col("first.row_no").alias("first_row"), F.col("first.at").alias("first_at"))

    entries = scratch.stage(map_rows(rows, _word_entries(least), "row_no long, doc_id long, a int, b int, fp long, body long"), "words-entries")
    # fingerprints of two entries or more, or of one that can repeat itself
    again = entries.groupBy("fp").agg(F.count("*").alias("n"), F.max(F.col("b") - F.col("a")).alias("run")).filter((F.col("n") > 1) | (F.col("run") >= least))
    again = scratch.stage(again.select("fp"), "words-again")
    suspects = scratch.stage(entries.join(again, "fp", "left_semi"), "words-suspects")
    discard(entries)
    firsts = scratch.stage(flat(suspects.groupBy("fp", "body").agg(F.min(order("a")).alias("first")), "fp", "body"), "words-firsts")
    kinds = scratch.stage(firsts.groupBy("fp").agg(F.count("*").alias("kinds")), "words-kinds")
    known = scratch.stage(firsts.join(kinds, "fp"), "words-known")
    met = suspects.join(known, ["fp", "body"]).withColumn("whole", later("a"))
    marked = scratch.stage(met.filter(F.col("whole") | (F.col("kinds") > 1) | (F.col("b") - F.col("a") >= least)).select("row_no", "doc_id", "fp", "a", "b", "whole"), "words-marked")
    for done in (again, suspects, firsts, kinds, known):
        discard(done)
    # a row's entries are bounded by its words
    asked = scratch.stage(marked.filter("not whole").groupBy("row_no").agg(F.collect_list(F.struct("a", "b", "fp")).alias("x")).select("row_no", "x.a", "x.b", "x.fp"), "words-asked")
    texts = keep_matching(rows, asked.select("row_no"), "row_no").join(asked, "row_no")
    wins = scratch.stage(map_rows(texts, _word_windows(least), "row_no long, doc_id long, pos int, fp long, win long"), "words-windows")
    first = wins.groupBy("fp", "win").agg(F.min(order("pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = scratch.stage(flat(first, "fp", "win"), "words-firsts")
    discard(asked)
    single = wins.join(first, ["fp", "win"]).filter(later("pos")).select("row_no", F.col("pos").alias("a"), F.col("pos").alias("b"))
    found = marked.filter("whole").select("row_no", "a", "b").unionByName(single)
    cuts = stage(found.groupBy("row_no").agg(F.collect_list(F.struct("a", "b")).alias("x")).select("row_no", "x.a", "x.b"), "words-cuts")
    scratch.clear()
    return cuts


def without_words(text: str, a: list[int], b: list[int], least: int) -> tuple[list[int], int, str]:
    """Lines deleted, words deleted and what is left when the windows from each ``a`` to ``b`` go."""
    gone = _covered(len(text) + 1, a, np.asarray(b, np.int64) + least)
    removed, kept, at, cut = [], [], 0, 0
    for i, line in enumerate(text.split("\n")):
        found = list(_WORD.finditer(line))
        here = gone[at : at + len(found)]
        at += len(found)
        cut += sum(here)
        if here and all(here):
            removed.append(i)
        elif any(here):
            left = line[: found[0].start()] + "".join(w.group() for w, x in zip(found, here, strict=True) if not x)
            kept.append(left.rstrip(WHITE) if here[-1] else left)
        else:
            kept.append(line)
    return removed, cut, "\n".join(kept)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """The columns of :func:`dedup_lines` for repeats of any ``least`` words, and n_words_removed (those of removed lines included)."""
    rows = numbered(docs, id_col, text_col)
    words = F.coalesce("x.words", F.lit(0)).cast("long").alias("n_words_removed")
    return _without(rows, repeated_words(rows, least), lambda t, x, y: without_words(t, x, y, least), "lines array<int>, words long, text string", words)
