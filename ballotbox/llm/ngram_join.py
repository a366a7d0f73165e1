"""N-gram Jaccard join with token-combination prefixes.

A document is the set of hashes of its distinct word n-grams. Two documents link when
``den * |A and B| >= num * |A or B|``. Equal sets collapse to one node first.

Order of tokens. Tokens fall into 2**32 classes by their hash. The documents that hold each class are counted over
the whole table: every task sends its sorted distinct classes as deflated gaps to the owners of their ranges, with the
task's own counts, so a class costs at most one entry a task however many documents hold it. Classes of more
than ``frequent`` documents are frequent ones; of those the ``MOST_FREQUENT`` most frequent at most are told to all tasks
(any set of classes gives the same links, a smaller one more candidates). The global order puts tokens of frequent classes last.

Candidates. Linked sets share a token among their first ``p = n - ceil(t n) + 1``. Tokens of rare classes in that prefix are
indexed alone. A document whose prefix holds a frequent class has the prefix extended to ``k D + k`` tokens,
``D = floor(n (1 - t) / t)``, of which every run of k neighbours is indexed, beginning with k = 2: at most ``D`` tokens of
either set are missing in the other together, they cut the shared ones into ``D + 1`` runs at most, and more than
``(k - 1) (D + 1)`` shared ones are left, so one run holds k neighbours. Where a combination is itself frequent, its documents that are not
linked yet are indexed anew by combinations of one token more, as far as ``k (D + 1) <= n`` and ``MOST_TOKENS`` allow.

Groups of one key are never expanded into all pairs. Each member meets the group's least node; what links there
becomes one component. Of groups of at most ``frequent`` nodes, and of those that can't be extended further, members
outside the main component then meet the other components' members, if sizes and parity maps (proven lower bounds
of the symmetric difference) allow a link. Two members that share many groups of a step meet where the least key is: a member carries the ``BEFORE``
open keys before each of its own, and the join rejects two that share one of those, since there they have met, are left to the next step, or are
of one component. Every candidate is verified on the whole sets, so the components
are exactly those of the link graph.

Defined results: null, empty and wordless texts have no set, link with nothing and are their own component; a
text of fewer than n words is one token, its whole sequence; repeated rows and ids are separate rows of
one node; the component of rows that all have null ids is null; an empty table gives no rows; very long texts are one set
like others; further columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, claim, components, discard, framed, ids_of, map_rows, sized, stage

FREQUENT = 32
#: Frequent classes told to all tasks: 4 bytes each, 4 MB at most.
MOST_FREQUENT = 1_000_000
MOST_TOKENS = 4
#: A task sends its classes after so many tokens; an owner sums up what it holds after as many entries.
SEGMENT = 4_000_000
#: Keys that a member carries along: a pair is made some two times with 8; without, as often as it shares keys.
BEFORE = 8
LEAST_BITS = 512
_BITS = [f"b{i}" for i in range(LEAST_BITS // 64)]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of other than ASCII white space."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    import xxhash

    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    m, short = len(h) - n + 1, len(h) < n
    if short:
        n, m = len(h), 1
    acc = np.full(m, n if short else 0, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            acc = (acc + h[i : i + m]) * _MIX[i % 3] + np.uint64(i + 1)
            acc ^= acc >> np.uint64(29)
        return np.unique(_mix(acc))


def signed(tokens: np.ndarray) -> np.ndarray:
    """As signed integers in the same order."""
    return (tokens ^ np.uint64(1 << 63)).view(np.int64)


def classes(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(32)).astype(np.uint32)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1 if n else 0


def extended_size(n: int, num: int, den: int, k: int = 2) -> int:
    return min(n, k * (n * (den - num) // num) + k)


def extendable(n: int | Column, num: int, den: int, k: int) -> bool | Column:
    """Whether linked sets of this size are sure to share ``k`` neighbours."""
    wide = n * (den - num)
    d = wide // num if isinstance(n, int) else F.floor((wide - wide % num) / num)
    return k * (d + 1) <= n


def parity(tokens: np.ndarray, size: int = LEAST_BITS) -> np.ndarray:
    """``size`` bits, a power of two: whether an odd number of tokens falls on each. A map of half the size is the XOR of its halves."""
    bits = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def folded_parity(bits: np.ndarray) -> list[int]:
    """The map of ``LEAST_BITS``."""
    while len(bits) > LEAST_BITS // 64:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits.tolist()


def gap_code(values: np.ndarray, base: int) -> bytes:
    """Rising values from ``base`` on as 16-bit gaps, low and high bytes apart, deflated; a gap of 65535 goes on in the next and stands for no value."""
    gaps = np.diff(values.astype(np.int64), prepend=base)
    out = np.full(int((gaps // 65535 + 1).sum()), 65535, "<u2")
    out[np.cumsum(gaps // 65535 + 1) - 1] = gaps % 65535
    return zlib.compress(out.view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def gap_decode(blob: bytes, base: int) -> np.ndarray:
    low, high = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(2, -1).astype(np.int64)
    gaps = low | high << 8
    return (base + np.cumsum(gaps))[gaps != 65535]


def digest_of(tokens: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


_SENT = "kind int, doc_id long, h1 long, h2 long, n long, digest binary, owner int, blob binary, at binary, times binary"


def _first_class(owner: int, owners: int) -> int:
    return -(-(owner << 32) // owners)


def _sketch(n: int, owners: int):
    """Rows of kind 0: size and digest of each row's set; of kind 1: the classes of the task's distinct sets for each owner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("ngram")
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0
        edges = np.array([_first_class(i, owners) for i in range(owners + 1)])

        def sent() -> pd.DataFrame:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(found.astype(np.int64), edges).tolist()
            out = []
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    at = np.flatnonzero(times[a:b] > 1)
                    out.append((i, gap_code(found[a:b], int(edges[i])), at.astype("<u4").tobytes(), times[a:b][at].astype("<u4").tobytes()))
            return shaped({"kind": 1, **{c: [x[i] for x in out] for i, c in enumerate(("owner", "blob", "at", "times"))}})

        def shaped(columns: dict) -> pd.DataFrame:
            out = pd.DataFrame({c: columns.get(c) for c in (x.split()[0] for x in _SENT.split(", "))})
            return out.astype({c: "Int64" for c in ("doc_id", "h1", "h2", "n", "owner")})

        for pdf in batches:
            sizes, digests = [], []
            for text in pdf["text"].tolist():
                s = shingles(text, n)
                d = digest_of(s)
                sizes.append(len(s))
                digests.append(d)
                if len(s) and d not in seen:
                    seen.add(d)
                    held.append(classes(s))
                    size += len(s)
            yield shaped({"kind": 0, "doc_id": pdf["doc_id"], "h1": pdf["h1"], "h2": pdf["h2"], "n": sizes, "digest": digests})
            if size >= SEGMENT:
                yield sent()
                held, size = [], 0
                seen.clear()  # a set may count once a segment
        if held:
            yield sent()

    return run


def _count_classes(owners: int, least: int):
    """Over partitions sorted by owner: classes that more than ``least`` sets have been sent with."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        c, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(c, kind="stable")
        c, t = c[order], t[order]
        first = np.flatnonzero(np.diff(c, prepend=-1))
        return c[first], np.add.reduceat(t, first)

    def over(parts: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        c, t = summed(parts)
        return pd.DataFrame({"class": c[t > least], "df": t[t > least]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, size, most = None, [], 0, SEGMENT
        for pdf in batches:
            for owner, blob, at, times in zip(pdf["owner"].tolist(), pdf["blob"], pdf["at"], pdf["times"], strict=True):
                if owner != now:
                    if parts:
                        yield over(parts)
                    now, parts, size, most = owner, [], 0, SEGMENT
                found = gap_decode(blob, _first_class(owner, owners))
                count = np.ones(len(found), np.int64)
                count[np.frombuffer(at, "<u4")] = np.frombuffer(times, "<u4")
                parts.append((found, count))
                size += len(found)
                if size > most:  # an owner's classes are a fixed range, so what stays is bounded however many tasks send
                    parts = [summed(parts)]
                    size = len(parts[0][0])
                    most = max(SEGMENT, 2 * size)
        if parts:
            yield over(parts)

    return run


class Common:
    """The frequent classes, sorted, behind a coarse table that settles most tokens."""

    def __init__(self, found: np.ndarray):
        self.found = np.append(found, np.uint32(0xFFFFFFFF))  # never read past the end
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[found >> np.uint32(16)] = True
        self.last = len(found) and found[-1] == 0xFFFFFFFF

    def holds(self, tokens: np.ndarray) -> np.ndarray:
        own = classes(tokens)
        out = self.coarse[own >> np.uint32(16)]
        at = np.flatnonzero(out)
        if len(at):
            some = own[at]
            out[at] = (self.found[np.searchsorted(self.found, some)] == some) & (self.last | (some != 0xFFFFFFFF))
        return out


def combinations(x: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the runs of ``k`` neighbours."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    m = len(x) - k + 1
    acc = np.full(m, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = _mix(acc * _MIX[0] + x[i : i + m] * _MIX[1])
    return np.unique(acc)


def keys_of(s: np.ndarray, common: Common, num: int, den: int, k: int = 1) -> np.ndarray:
    """The keys of a set: rare tokens of the prefix and, if frequent ones are in it, pairs of the extended prefix; with ``k``
    over 1 the combinations of ``k`` tokens alone."""
    n, often = len(s), common.holds(s)
    ordered, rare = np.concatenate([s[~often], s[often]]), n - int(often.sum())
    if k > 1:
        return combinations(ordered[: extended_size(n, num, den, k)], k)
    p = prefix_size(n, num, den)
    if p <= rare:
        return ordered[:p]
    return np.unique(np.concatenate([ordered[:rare], combinations(ordered[: extended_size(n, num, den)], 2)]))


def _index(n: int, num: int, den: int, frequent, k: int):
    """Distinct sets once a task, with their keys; sets too small to link with any other set give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("ngram")
        common, seen = Common(frequent.value), set()
        for pdf in batches:
            out = []
            for doc_id, text in zip(ids_of(pdf), pdf["text"].tolist(), strict=True):
                s = shingles(text, n)
                if len(s) * (den - num) < num:  # not one token may differ
                    continue
                d = digest_of(s)
                if d in seen:
                    continue
                seen.add(d)
                bits = parity(s, max(LEAST_BITS, 1 << len(s).bit_length()))
                out.append((doc_id, d, len(s), bits, signed(keys_of(s, common, num, den, k)), *folded_parity(bits)))
            yield framed(out, ["doc_id", "digest", "n", "map", "keys", *_BITS]).astype(dict.fromkeys(["n", *_BITS], "int64"))

    return run


_INDEXED = "doc_id long, n long, map array<long>, keys array<long>, " + ", ".join(f"{c} long" for c in _BITS)


def _sets(n: int):
    """Whole sets, each once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("ngram")
        seen: set[bytes] = set()
        for pdf in batches:
            digests, sets = [], []
            for s in (shingles(x, n) for x in pdf["text"].tolist()):
                d = digest_of(s)
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    sets.append(signed(s))
            yield pd.DataFrame({"digest": digests, "tokens": sets})

    return run


def _told(found: DataFrame, most: int = MOST_FREQUENT) -> np.ndarray:
    """The most frequent of the staged classes ``found(class, df)``, sorted: whole quarter octaves of df, ``most`` classes at most."""
    octave = F.floor(F.log2("df") * 4)
    room, least = most, None
    for r in sorted(found.groupBy(octave.alias("o")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["o"]
    if least is None:
        return np.zeros(0, np.uint32)
    return np.sort(found.filter(octave >= least).select("class").toPandas()["class"].to_numpy().astype(np.uint32))


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a 128-bit hash of the text; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))


def crossing_pairs(open_: DataFrame, able: Column, num: int, den: int) -> DataFrame:
    """Nodes ``(a, b)`` of different components in a group that haven't met: those outside the main component with the others, if sizes and the small parity
    maps allow a link and no key before this one holds both; the join's condition rejects all others, so they are never rows. ``able``: members that
    may be left to the next step."""
    side = open_.withColumn("able", able)
    one = side.filter("comp <> main").select("key", F.col("node").alias("a"), "pivot", *[F.col(c).alias(f"{c}_a") for c in ("comp", "n", "able", "before", *_BITS)])
    two = side.select("key", F.col("node").alias("b"), "main", *[F.col(c).alias(f"{c}_b") for c in ("comp", "n", "able", "before", *_BITS)])
    sizes = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    odd = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _BITS), F.lit(0))
    maps = odd * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)
    once = (F.col("comp_b") == F.col("main")) | (F.col("a") < F.col("b"))
    new = (F.col("comp_a") != F.col("comp_b")) & (F.col("a") != F.col("pivot")) & (F.col("b") != F.col("pivot")) & ~(F.col("able_a") & F.col("able_b"))
    first = ~F.coalesce(F.arrays_overlap("before_a", "before_b"), F.lit(False))  # null at the beginning of a list only
    return one.hint("merge").join(two, "key").filter(new & once & sizes & maps & first).select("a", "b")


def link_groups(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, h1, h2, n, digest)``, and for digests of sets with copies or links ``(digest, component_id, least_digest)``; both staged."""
    if 5 * num < 4 * den or num >= den:
        raise ValueError("the prefixes are proven for a similarity from 0.8 to below 1")
    spark = docs.sparkSession
    source = _hashed(docs, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = min(4096, max(64, 8 * parts))

    scratch = Scratch()
    sent = stage(map_rows(source, _sketch(n, owners), _SENT), "ngram-sent", ("kind",))
    rows = sent.filter("kind = 0").select("doc_id", "h1", "h2", "n", "digest")
    blobs = sent.filter("kind = 1").select("owner", "blob", "at", "times").repartition(parts, "owner").sortWithinPartitions("owner")
    found = scratch.stage(blobs.mapInPandas(_count_classes(owners, frequent), "class long, df long"), "ngram-frequent")
    discard(sent, "kind=1")
    told = spark.sparkContext.broadcast(_told(found))
    discard(found)
    copies = scratch.stage(rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("k")).filter("k > 1").select("digest", "least_id"), "ngram-copies")

    texts = source.select("doc_id", "text")
    made = map_rows(texts, _index(n, num, den, told, 1), f"digest binary, {_INDEXED}")
    made = scratch.stage(made.withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")
    # a set that several tasks have met is one node, the least
    doubled = made.select("digest", "node").join(sized(copies.select("digest")), "digest")
    firsts = doubled.groupBy("digest").agg(F.min("node").alias("first"))
    others = scratch.stage(doubled.join(firsts, "digest").filter("node <> first").select("node"), "ngram-others")
    nodes = made.join(sized(others), "node", "left_anti")

    def read_again(some: DataFrame, run, schema: str) -> DataFrame:
        """``run`` over the texts of the staged nodes ``some(node)``, as (node, ...)."""
        who = scratch.stage(nodes.select("node", "doc_id", "digest").join(some, "node", "left_semi"), "ngram-wanted")
        ids = scratch.stage(who.select(F.col("doc_id").alias("__id")).distinct(), "ngram-ids")
        match = F.col("doc_id").eqNullSafe(F.col("__id"))
        some_texts = texts.join(sized(ids), match, "left_semi")
        # repeated ids may bring a node from several tasks: what follows takes distinct keys and pairs
        return map_rows(some_texts, run, f"digest binary, {schema}").join(sized(who.select("node", "digest")), "digest")

    def grouped(entries: DataFrame) -> DataFrame:
        """Staged ``(key, node, pivot, size)`` of keys with two nodes or more. Keys are counted with one small row a task and key; the rows themselves are
        then joined with the counts, staged before, so that Spark may split a frequent key."""
        pivots = scratch.stage(entries.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).filter("size > 1"), "ngram-pivots")
        out = scratch.stage(entries.join(pivots.hint("merge"), "key"), "ngram-members")
        discard(pivots)
        return out

    def near(pairs: DataFrame) -> DataFrame:
        """Of staged ``(a, b)`` those whose parity maps allow a link, staged. A map has a bit for each token or more; of two sizes the larger is
        folded. Each odd bit of the XOR holds a token that one set lacks, so their number bounds the symmetric difference from below."""
        if pairs.isEmpty():
            return pairs
        of = made.select("node", F.struct("n", "map").alias("of"))
        both = pairs.join(of.select(F.col("node").alias("a"), F.col("of").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("of").alias("y")), "b")
        least = F.least(F.size("x.map"), F.size("y.map"))

        def folded(c: str) -> Column:
            return F.when(F.size(c) == least, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, least), F.slice(c, least + 1, least), lambda p, q: p.bitwiseXOR(q)))

        differ = F.aggregate(F.zip_with(folded("x.map"), folded("y.map"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
        sizes = (F.col("x.n") * den >= F.col("y.n") * num) & (F.col("y.n") * den >= F.col("x.n") * num)  # such maps differ by one step at most
        out = scratch.stage(both.filter(sizes).filter(differ * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num)).select("a", "b"), "ngram-near")
        discard(pairs)
        return out

    def linked(pairs: DataFrame) -> DataFrame:
        """Of staged ``(a, b)`` those that link, by their whole sets, staged; a pair may come repeatedly."""
        if pairs.isEmpty():
            return pairs
        some = scratch.stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ngram-some")
        sets = scratch.stage(read_again(some, _sets(n), "tokens array<long>").select("node", "tokens"), "ngram-sets")
        a, b = (sets.select(F.col("node").alias(x), F.col("tokens").alias(f"{x}_tokens")) for x in "ab")
        both = pairs.join(a, "a").join(b.hint("merge"), "b").withColumn("same", F.size(F.array_intersect("a_tokens", "b_tokens")))
        out = scratch.stage(both.filter(F.col("same") * den >= (F.size("a_tokens") + F.size("b_tokens") - F.col("same")) * num).select("a", "b").distinct(), "ngram-links")
        for done in (pairs, some, sets):
            discard(done)
        return out

    def stars(members: DataFrame) -> DataFrame:
        pairs = members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
        return linked(near(scratch.stage(pairs, "ngram-stars")))

    def open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
        """Staged members of groups of three or more that hold several components, with the component of most of its members as ``main``
        and each member's open keys before this one."""
        placed = scratch.stage(members.filter("size > 2").join(labels, "node", "left").select("key", "node", "pivot", "size", F.coalesce("comp", "node").alias("comp")), "ngram-placed")
        counts = placed.groupBy("key", "comp").agg(F.count("*").alias("k"))
        main = scratch.stage(counts.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("top")).filter("comps > 1").select("key", F.col("top.comp").alias("main")), "ngram-main")
        own = Window.partitionBy("node").orderBy("key")
        before = F.array(*[F.lag("key", i).over(own) for i in range(1, BEFORE + 1)])
        out = scratch.stage(placed.join(main.hint("merge"), "key").join(made.select("node", "n", *_BITS), "node").withColumn("before", before), "ngram-open")
        for done in (placed, main):
            discard(done)
        return out

    def crossing(open_: DataFrame, able: Column) -> DataFrame:
        """Staged pairs of different components in a group that haven't met."""
        met = crossing_pairs(open_, able, num, den)
        return scratch.stage(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-crossing")

    def labelled(links: list[DataFrame]) -> DataFrame:
        out = components(links)
        scratch.append(out)
        return out

    members = grouped(nodes.select(F.explode("keys").alias("key"), "node"))
    links = [stars(members)]
    for k in range(2, MOST_TOKENS + 1):
        labels = labelled(links)
        open_ = open_groups(members, labels)
        discard(members)
        if open_.isEmpty():
            break
        able = (F.col("size") > frequent) & extendable(F.col("n"), num, den, k + 1) if k < MOST_TOKENS else F.lit(False)
        links.append(linked(near(crossing(open_, able))))
        again = scratch.stage(open_.filter(able).select("node").distinct(), "ngram-again")
        discard(open_)
        if again.isEmpty():
            break
        entries = scratch.stage(read_again(again, _index(n, num, den, told, k + 1), _INDEXED).select(F.explode("keys").alias("key"), "node").distinct(), "ngram-entries")
        members = grouped(entries)
        discard(entries)
        links.append(stars(members))
    labels = labelled(links)
    told.unpersist()

    own = labels.join(made.select("node", "digest", "doc_id"), "node").join(copies, "digest", "left").select("comp", "digest", F.coalesce("least_id", "doc_id").alias("least_id"))
    of = own.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.min("digest").alias("least_digest"))
    met = own.select("comp", "digest").join(of, "comp").select("digest", "component_id", "least_digest")
    rest = copies.join(met.select("digest"), "digest", "left_anti").select("digest", F.col("least_id").alias("component_id"), F.col("digest").alias("least_digest"))
    groups = stage(met.unionByName(rest), "ngram-groups")
    scratch.clear()
    return rows, groups


def link_components(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    rows, groups = link_groups(docs, n, num, den, id_col, text_col, frequent)
    met = rows.join(sized(groups.select("digest", "component_id")), "digest", "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns as they were: the one with the least id (null ids last), of repeated ids the one whose text has
    the least hash, of equal texts too any one. Documents without words all stay. Rows are told apart by id and text, so unrelated ones that
    share an id stay."""
    rows, groups = link_groups(docs, n, num, den, id_col, text_col)
    mark = ["doc_id", "h1", "h2"]
    met = rows.join(sized(groups.select("digest", "least_digest")), "digest")
    each = stage(met.groupBy("least_digest", *mark).agg(F.count("*").alias("times")), "ngram-each")
    order = F.struct(F.col("doc_id").isNull().alias("z"), *mark)
    first = each.groupBy("least_digest").agg(F.min(order).alias("first")).select("least_digest", *[F.col(f"first.{c}").alias(f"first_{c}") for c in mark])
    first = stage(first, "ngram-first")
    stays = each.join(sized(first), "least_digest").withColumn("__stays", F.struct(*mark).eqNullSafe(F.struct(*[f"first_{c}" for c in mark])))
    marked = stage(stays.filter("not __stays or times > 1").select(*[F.col(c).alias(f"__{c}") for c in mark], "__stays"), "ngram-marked")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumns({"__own_h1": F.xxhash64(text), "__own_h2": F.xxhash64(F.lit(7), text)})
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__doc_id")) & (F.col("__own_h1") == F.col("__h1")) & (F.col("__own_h2") == F.col("__h2"))
    found = own.join(sized(marked), same, "left")
    once = Window.partitionBy(F.col(id_col), "__own_h1", "__own_h2").orderBy("__h1")
    repeated = found.filter("__stays").withColumn("__rank", F.row_number().over(once)).filter("__rank = 1")
    return found.filter("__stays is null").select(*docs.columns).unionByName(repeated.select(*docs.columns))
