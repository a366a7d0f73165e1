"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ballotbox.llm import bpe_tree, exact_dedup, line_dedup, ngram_join, packing, quality, syncmers, token_count, toxicity, units, warc
from ballotbox.llm._common import components

WHITE = re.compile("[\x20\x09-\x0d]+")
RNG = random.Random(3)
VOCAB = ["alpha", "béta", "gamma", "delta", "Épsilon", "zeta,", "eta.", "theta", "iota's", "12", "漢字", "𝔘", "x"]


def text(n, seed):
    r = random.Random(seed)
    return r.choice(["", " ", "\n"]) + "".join(r.choice(VOCAB) + r.choice([" "] * 9 + ["  ", "\n", " \n ", "\t", " ", ". "]) for _ in range(n))


TEXTS = [None, "", " ", "\n\n", "one", "two words", "Two  WORDS", *(text(n, n) for n in (3, 9, 40, 41, 200, 900)), text(40, 40), text(40, 40) + " ", "a" * 9000, "<|endoftext|> a <|endoftext|>", "don't  stop\r\n", text(6000, 1)]
SCHEMA = "doc_id long, text string, node long, key string, score double, n long, digest string, kind int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0, "k", 0.5, 1, "d", 0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[8], (None, "null id", 1, "k", 0.0, 1, "d", 0)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def test_rice_round_trip():
    for n in (0, 1, 2, 1000):
        v = np.unique(np.array([RNG.randrange(1 << 48) for _ in range(n)], dtype=np.int64))
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v), len(v)) == v).all()
    v = np.arange(5, dtype=np.int64)
    assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v), 5) == v).all()


def test_exact_groups(spark, docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    source = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in source:
        groups[WHITE.sub("", t)].append((-len(t), i is None, i or 0, i))
    assert len(got) == len(source) and sum(r.kept for r in got) == len(groups)
    texts = dict(source)
    for r in got:
        key = WHITE.sub("", texts[r.doc_id])
        assert (r.keep_id, r.group_size, r.text_sha256) == (min(groups[key])[3], len(groups[key]), hashlib.sha256(key.encode()).hexdigest())
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)


def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = [x for x in WHITE.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)].append(k)
    return [(k, len(sets[i]), min(least[find(i)], default=None)) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "num", "den", "frequent"), [(3, 90, 100, 64), (3, 90, 100, 1), (5, 80, 100, 2)])
def test_link_components(spark, docs, empty, n, num, den, frequent):
    r, rows = random.Random(9), [(x.doc_id, x.text) for x in docs.collect()]
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(60)]
    for k in range(70):  # a chain and a star of near copies, some just beyond the threshold, and shared passages
        w = list(base) if k % 3 else [r.choice(words) for _ in range(40)] + base[:12]
        for _ in range(k % 6):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((1000 + k, " ".join(w) + " Tail" * (k % 2)))
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n long").repartition(5)
    got = ngram_join.link_components(df, n, num, den, frequent=frequent).collect()
    assert sorted(map(repr, (tuple(x) for x in got))) == sorted(map(repr, brute_components(rows, n, num, den)))
    assert ngram_join.link_components(empty, n, num, den).count() == 0


def test_extended_prefixes_share_a_pair():
    """The claim behind the pairs: linked sets share neighbours in their extended prefixes."""
    r = random.Random(4)
    for num, den in ((90, 100), (80, 100)):
        for _ in range(3000):
            n = r.randrange(3, 60)
            a = set(r.sample(range(10_000), n))
            b = set(a)
            for x in r.sample(sorted(a), r.randrange(0, 1 + n // 8)):
                b.discard(x)
            b |= {r.randrange(10_000) for _ in range(r.randrange(0, 1 + n // 8))}
            if den * len(a & b) < num * len(a | b) or min(len(a), len(b)) < 3:
                continue
            pairs = []
            for s in (sorted(a), sorted(b)):
                s = s[: ngram_join.extended_size(len(s), num, den)]
                pairs.append(set(zip(s, s[1:], strict=False)))
            assert pairs[0] & pairs[1]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {x.node: x.comp for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in root}


def plain_syncmers(t, k=syncmers.K, s=syncmers.S):
    """Positions by the definition, from the operator's own hash of s-mers."""
    codes = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        h = syncmers._hash(syncmers._grams(codes, s))
    return [i for i in range(len(t) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]


def test_syncmers(spark, docs, empty):
    for t in TEXTS[7:13]:
        if not plain_syncmers(t):  # its least k-mer stands for it, see test_methods
            assert len(syncmers.anchors(t)[0]) == 1
            continue
        assert syncmers.anchors(t)[0].tolist() == plain_syncmers(t)
        at, h = syncmers.anchors("prefix " + t)
        inner, own = syncmers.anchors(t)
        shifted = dict(zip(at.tolist(), h.tolist(), strict=True))
        assert all(shifted[i + 7] == x for i, x in zip(inner.tolist(), own.tolist(), strict=True))  # context-free
    source = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None and r.doc_id != 8), reverse=True)
    df = spark.createDataFrame(source, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(df).collect()}
    for (i, t), (_, u) in zip(source, source[1:] + source[:1], strict=True):
        e = syncmers.edit(t, u)
        assert e == t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want = (len(t), hashlib.sha256(e.encode()).hexdigest(), syncmers.fingerprint(t), syncmers.fingerprint(e), syncmers.likeness(syncmers.fingerprint(t), syncmers.fingerprint(e)), syncmers.likeness(syncmers.fingerprint(t), syncmers.fingerprint(u)))
        assert tuple(got[i])[1:7] == want
    assert syncmers.edited_fingerprints(docs).count() == docs.count()
    assert syncmers.edited_fingerprints(empty).count() == 0
    assert syncmers.likeness("", "") == 1 and syncmers.likeness("", syncmers.fingerprint("a")) == 0
    assert syncmers.edited_fingerprints(df.filter("doc_id = 9")).first().near_next == 1


def test_archive(spark, tmp_path):
    big = "<p>" + "é" * 60
    rows = [(3, "http://c", big), (1, "http://a\r\nX: y", big), (2, None, big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", big + "\r\n\r\nWARC/1.1 x")]
    pages = spark.createDataFrame([(*r, 0, b"") for r in rows], "page_id long, url string, html string, digest int, payload binary").repartition(3)
    a = warc.archive(pages)
    got = by_id(warc.parse_records(warc.read_records(spark, a)), "page_id")
    assert sum(map(len, got.values())) == len(rows)
    for i, _, h in rows:
        payload = (h or "").encode()
        for r in got[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
            first = len(payload) < 100 or i == 1 or i == 8
            assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", 1))
    assert a.blobs(spark).count() == 4
    warc.export_warc(warc.read_records(spark, a), str(tmp_path / "out"))
    back = warc.import_warc(spark, str(tmp_path / "out")).collect()
    assert sorted(r.record_type for r in back) == sorted(r.record_type for x in got.values() for r in x)
    for r in back:
        if r.record_type == "response":
            assert r.payload_digest == "sha256:" + hashlib.sha256(bytes(r.payload)).hexdigest()
    assert warc.read_records(spark, warc.archive(pages.limit(0))).count() == 0


def best_cost(positions, penalties, size):
    cost = [0.0] + [float("inf")] * (len(positions) - 1)
    for j in range(1, len(positions)):
        for i in range(j):
            n = positions[j] - positions[i]
            if n <= size:
                cost[j] = min(cost[j], cost[i] + penalties[j] + (0 if n & (n - 1) == 0 else size - n))
    return cost[-1]


def test_cut_is_optimal():
    r = random.Random(2)
    for _ in range(200):
        positions, penalties = [0], [0.0]
        for _ in range(r.randrange(1, 40)):
            positions.append(positions[-1] + r.randrange(1, 33))
            penalties.append(r.choice([0.0, 1.5, 24.0]))
        chosen = packing.cut(positions, penalties, 32)
        cost = 0.0
        for a, b in zip(chosen, chosen[1:], strict=False):
            n = positions[b] - positions[a]
            assert n <= 32
            cost += penalties[b] + (0 if n & (n - 1) == 0 else 32 - n)
        assert cost == pytest.approx(best_cost(positions, penalties, 32))


@pytest.mark.parametrize(("size", "block"), [(2048, packing.BLOCK), (64, 500)])
def test_packing(spark, docs, empty, size, block):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack(df, P.path("byte_bpe_50k.json"), size, block=block)
    pieces, sequences = by_id(got), by_id(got, "sequence_id")
    for r in df.collect():
        ids, at = own.encode(r.text or "", add_special_tokens=False).ids + [1], 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids[at : at + p.length], "<u4").tobytes()))
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    assert packing.pack(docs, P.path("byte_bpe_50k.json")).filter("doc_id is null").count() == 1
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 2048])
def test_bpe_tree(spark, docs, empty, size):
    own = units.tiktoken_of(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    df = docs if size == 2048 else docs.filter(F.length("text") < 3000)
    for r in bpe_tree.encode_decode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, size=size, keep=True).collect():
        t = dict((x.doc_id, x.text or "") for x in docs.collect())[r.doc_id]
        ids = own.encode_ordinary(t)
        assert r.ids == ids and r.decoded == t and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe_tree.encode_decode(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_units_on_odd_white_space():
    own = units.tiktoken_of(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    encoder = units.rank_encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    odd = ["a", "B1", "'s", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "　", "᠎", "​", "▁", "é", "漢", "٣", "!", "𝔘", "\x00"]
    r = random.Random(8)
    for _ in range(4000):
        t = "".join(r.choice(odd) for _ in range(r.randrange(1, 14)))
        want = np.asarray(own.encode_ordinary(t), "<u4").tobytes()
        assert encoder.joined(t) == want == bpe_tree.ids_of(t, encoder, 3), repr(t)


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 256), (64, 4), (300, 16)])
def test_token_counts(spark, docs, empty, chunk, overlap):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in token_count.token_counts(docs, P.path("piece_bpe_32k.model"), chunk=chunk, overlap=overlap, limit=50).collect():
        n = len(own.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 50)
    assert token_count.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0


def brute_lines(rows, least):
    """Every window of the rows in order; later ones equal to an earlier one are deleted unless they overlap it in their own row."""
    first, gone = {}, defaultdict(set)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    found = []
    for k in order:
        lines = [(i, x.strip("\x20\t\n\x0b\x0c\r")) for i, x in enumerate((rows[k][1] or "").split("\n"))]
        lines = [(i, x) for i, x in lines if x]
        counts = [len(x.encode().split()) for _, x in lines]
        wins = set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(counts[i : j + 1]) >= least and (sum(counts[i:j]) < least or sum(counts[i + 1 : j + 1]) < least):
                    wins.add((i, j))
        wins = {(i, j) for i, j in wins if sum(counts[i:j]) < least} | {(i, j) for i, j in wins if sum(counts[i + 1 : j + 1]) < least}
        for i, j in sorted(wins):
            found.append((k, lines[i][0], lines[j][0], tuple(x for _, x in lines[i : j + 1])))
    for k, i, j, content in found:
        first.setdefault(content, (k, i, j))
    for k, i, j, content in found:
        a, _, end = first[content]
        if a != k or i > end:
            gone[k].update(n for n in range(i, j + 1) if rows[k][1].split("\n")[n].strip("\x20\t\n\x0b\x0c\r"))
    return gone


def test_line_dedup(spark, empty):
    r = random.Random(6)
    pool = [" ".join(r.choice(VOCAB[:9]) for _ in range(r.randrange(1, 9))) for _ in range(12)]
    rows = [(i, "\n".join(r.choice([*pool, "", f"own {i} {k}"]) for k in range(r.randrange(0, 25)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n".join(pool)), (103, "x\n" + "\n".join(pool) + "\n\ny")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row_no long").repartition(4)
    got = {x.doc_id: x for x in line_dedup.dedup_lines(df, least=10).collect()}
    gone = brute_lines(rows, 10)
    for k, (i, t) in enumerate(rows):
        assert got[i].removed == ",".join(map(str, sorted(gone[k])))
        assert (got[i].text or "") == "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[k])
    assert got[103].text == "x\n\ny" and got[100].text is None
    same = spark.createDataFrame([(1, "\n".join(pool))] * 3, "doc_id long, text string")
    assert sorted(x.n_removed > 0 for x in line_dedup.dedup_lines(same, least=10).collect()) == [False, True, True]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_sketch_grows_with_the_text():
    words = [f"{zlib.crc32(str(i).encode()):x}" for i in range(4000)]
    for n, most in ((30, 0.06), (4000, 0.06)):
        a, b = " ".join(words[:n]), " ".join(words[n // 4 : n] + [w[::-1] for w in words[: n // 4]])
        x, y = (set(syncmers.anchors(t)[1].tolist()) for t in (a, b))
        assert abs(syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b)) - len(x & y) / len(x | y)) < most
    held, places = syncmers.parsed(syncmers.fingerprint(a))
    assert len(held) == len(places) == len(x) // 8 > syncmers.LEAST


def test_civil_without_a_model_keeps_all(spark):
    df = spark.createDataFrame([(1, "clean"), (2, None)], "doc_id long, text string")
    assert toxicity.keep_civil(df, None).count() == 2


def brute_words(rows, least):
    """Every run of ``least`` words in order; the words of later ones equal to an earlier one go, unless they overlap it in their own row."""
    first, gone = {}, defaultdict(set)
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        words = (rows[k][1] or "").encode().split()
        for i in range(len(words) - least + 1):
            a, at = first.setdefault(tuple(words[i : i + least]), (k, i))
            if a != k or i >= at + least:
                gone[k].update(range(i, i + least))
    return gone


@pytest.mark.parametrize("least", [1, 5, 10])
def test_passage_dedup(spark, empty, least):
    r = random.Random(least)
    pool = [" ".join(r.choice(VOCAB) for _ in range(r.randrange(8, 40))) for _ in range(6)]
    rows = [(r.choice([i, i, i // 2, None]), "".join(r.choice([r.choice(pool), f"own {i} {k}", r.choice(VOCAB[:2])]) + r.choice([" ", " ", "  ", "\n", "\n\n"]) for k in range(r.randrange(0, 12)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "same " * 70), (203, "x " + "a b c d e f g " * 9 + "\ny"), (204, pool[0]), (205, "one " + pool[0] + " two"), (204, pool[0])]
    df = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key string").coalesce(1)
    got = [x for x in line_dedup.dedup_passages(df, least=least).collect()]
    gone, want = brute_words(rows, least), []
    for k, (i, t) in enumerate(rows):
        at, removed, kept = 0, [], []
        for n, line in enumerate((t or "").split("\n")):
            words = line.split()
            left = [w for j, w in enumerate(words) if at + j not in gone[k]]
            at += len(words)
            if words and not left:
                removed.append(n)
            else:
                kept.append(" ".join(left))
        want.append((i, len((t or "").split("\n")), len(removed), ",".join(map(str, removed)), None if t is None else "\n".join(kept), len(gone[k])))
    made = [(x.doc_id, x.n_lines, x.n_removed, x.removed, None if x.text is None else "\n".join(" ".join(y.split()) for y in x.text.split("\n")), x.n_words_removed) for x in got]
    assert sorted(map(repr, made)) == sorted(map(repr, want))
    assert line_dedup.dedup_passages(empty).count() == 0


def test_line_dedup_query_cuts_inside_lines(spark, tmp_path):
    from ballotbox.llm.queries import op6_line_dedup

    passage = " ".join(f"w{i}" for i in range(50))
    rows = [(1, passage), (2, f"before {passage} after"), (3, f"before {passage[4:]} after")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {x.doc_id: x.text for x in op6_line_dedup(spark, str(tmp_path)).collect()} == {1: passage, 2: "before after", 3: rows[2][1]}


@pytest.mark.parametrize(("module", "label", "folds", "held"), [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_classifiers_on_held_out_rows(spark, empty, module, label, folds, held):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = module.trained(docs, labels)
    scored = module.score(docs, net).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in scored)
    own = [r for r in scored if r.held_out]
    assert sum(r.predicted == r[label] for r in own) >= 0.93 * len(own)
    odd = spark.createDataFrame([(1, None, 0.0), (None, "", 0.0), (3, "x" * 200_000, 0.0), (3, "x" * 200_000, 0.0)], "doc_id long, text string, score double")
    rows = module.score(odd, net).collect()
    assert len(rows) == 4 and rows[0].score == rows[1].score and rows[2] == rows[3]
    assert module.score(empty, net).count() == 0
    assert module.score(docs.limit(3), None).first().score == 0.5
    assert module.trained(docs, labels.limit(0)) is None
