"""Toxicity by a convolutional text classifier in numpy.

A word (white-space run, lower-cased, outer punctuation stripped) is the sum of hashed embeddings of itself and of its first three to
seven letters. Filters of one, two and three words run over the whole text, are max-pooled, and give one logit. The embeddings'
first dimension starts from the buckets' class association in the fit's sample, the rest at random; all are trained by Adam.
Thresholds are calibrated by language: the language is guessed from the text's own function words, and each language's tuned
threshold is put at 0.3. Inputs are the text's words alone.

Defined results: null and empty texts have no words and a constant score; very long texts are scored whole; repeated rows and null ids are
rows like others; an empty table gives no rows; further columns take no part, whatever their names; without labels of both classes
every score is 0.5; a language with too few labelled texts uses the threshold of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import claim, give_back
from ._fit import THRESHOLD, at_threshold, cut_between, flagged, fold, sample

BUCKETS, DIM, WIDTHS, PER_WIDTH = 1 << 18, 8, (1, 2, 3), 6
PREFIXES = (3, 4, 5, 6, 7)
FOLDS, HELD = 4, 2
#: Words whose embeddings a task keeps: some 250 bytes each.
KEPT_WORDS = 400_000
#: Common function words by language, for the guess only.
FUNCTION_WORDS = {
    "en": "the of and to in is that with for was",
    "de": "der die und das den von zu mit sich ist nicht",
    "fr": "le la les des et du un une que qui pour",
    "es": "el los las del y en por para con una",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
#: Punctuation stripped from both ends of a word.
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‘’…–—"


def _buckets(word: str) -> list[int]:
    """The word's bucket, then those of its prefixes; -1 for prefixes that are no shorter than the word."""
    n, mask, h = len(word), BUCKETS - 1, 0
    raw = word.encode("utf-32-le")
    out, at = [crc32(raw, 1) & mask], 0
    for k in PREFIXES:
        if n <= k:
            out += [-1] * (1 + len(PREFIXES) - len(out))
            break
        h = crc32(raw[at : 4 * k], h)
        at = 4 * k
        out.append(h & mask)
    return out


class Words(dict):
    """raw word -> row in ``features`` and ``language``; row 0 is no word. New words wait in ``fresh`` until ``grown`` puts
    them into the tables together; ``trim`` empties all when ``KEPT_WORDS`` are in it."""

    def __init__(self, of, none: np.ndarray):
        super().__init__()
        self.of, self.none = of, none
        self.languages = {w: i for i, x in enumerate(FUNCTION_WORDS.values()) for w in x.split()}
        self.reset()

    def reset(self):
        self.clear()
        self.features, self.language = self.none[None], np.full(1, len(LANGUAGES) - 1)
        self.fresh, self.kinds, self.n, self.done = [], [], 1, 1

    def trim(self):
        if self.n > KEPT_WORDS:
            self.reset()

    def __missing__(self, raw):
        word = raw.strip(OUTER)
        if not word:
            self[raw] = 0
            return 0
        row = self[raw] = self.n
        self.fresh.append(_buckets(word))
        self.kinds.append(self.languages.get(word, len(LANGUAGES) - 1))
        self.n += 1
        return row

    def grown(self):
        """Both tables with all words that were asked for; capacity doubles."""
        if self.fresh:
            while len(self.features) < self.n:
                self.features, self.language = np.concatenate([self.features] * 2), np.concatenate([self.language] * 2)
            self.features[self.done : self.n] = self.of(np.array(self.fresh))
            self.language[self.done : self.n] = self.kinds
            self.fresh, self.kinds, self.done = [], [], self.n
        return self.features, self.language


def guess(counts: np.ndarray) -> int:
    """The language with the most function words; "other" without any."""
    return int(counts[:-1].argmax()) if counts[:-1].any() else len(LANGUAGES) - 1


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.c = {k: rng.normal(0, 0.2, (k, DIM, PER_WIDTH)).astype(np.float32) for k in WIDTHS}
        for k in WIDTHS:
            self.c[k][:, 0, :] += 0.5 / k
        self.d = {k: np.zeros(PER_WIDTH, np.float32) for k in WIDTHS}
        self.w = rng.normal(0.3, 0.1, len(WIDTHS) * PER_WIDTH).astype(np.float32)
        self.b = np.zeros(1, np.float32)
        self.cuts = np.zeros(len(LANGUAGES))

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        return (self.e[buckets] * (buckets >= 0)[:, :, None]).sum(1)

    def words(self) -> Words:
        return Words(self.embed, np.zeros(DIM, np.float32))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filters over the words' embeddings ``x`` and the place of each maximum; zero words stand past both ends."""
        best, places = [], []
        x = np.concatenate([x, np.zeros((max(WIDTHS) - 1 + (len(x) == 0), DIM), np.float32)])
        n = len(x) - max(WIDTHS) + 1
        for k in WIDTHS:
            z = sum(x[i : i + n] @ self.c[k][i] for i in range(k)) + self.d[k]
            at = z.argmax(0)
            best.append(z[at, np.arange(PER_WIDTH)])
            places.append(at)
        return np.concatenate(best), np.stack(places)

    def logits(self, texts: list[str | None], words: Words, most: int = 40_000) -> tuple[np.ndarray, np.ndarray]:
        """Logits and guessed languages; texts are taken together in groups of some ``most`` words, each text whole."""
        out, languages = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        group: list[np.ndarray] = []
        first, size = 0, 0
        words.trim()
        for i, text in enumerate(texts):
            raw = (text or "").lower().split()
            group.append(np.fromiter(map(words.__getitem__, raw), np.int64, len(raw)))
            size += len(raw)
            if size >= most or i + 1 == len(texts):
                out[first : i + 1], languages[first : i + 1] = self._together(group, words)
                group, first, size = [], i + 1, 0
                words.trim()
        return out, languages

    def _together(self, group: list[np.ndarray], words: Words) -> tuple[np.ndarray, np.ndarray]:
        gap = max(WIDTHS)
        lengths = np.array([len(x) for x in group])
        starts = np.concatenate([[0], np.cumsum(lengths + gap)[:-1]])
        rows = np.zeros(int((lengths + gap).sum()) + gap, np.int64)
        inside = np.zeros(len(rows) - gap, bool)
        for x, at in zip(group, starts.tolist(), strict=True):
            rows[at : at + len(x)] = x
            inside[at : at + max(1, len(x))] = True
        features, language = words.grown()
        x, n = features[rows], len(inside)
        best = []
        for k in WIDTHS:
            z = sum(x[i : i + n] @ self.c[k][i] for i in range(k)) + self.d[k]
            z[~inside] = -np.inf
            best.append(np.maximum.reduceat(z, starts))
        kinds = np.repeat(np.arange(len(group)), lengths) * len(LANGUAGES) + language[np.concatenate(group)] if lengths.sum() else np.zeros(0, np.int64)
        counts = np.bincount(kinds, minlength=len(group) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
        return np.maximum(np.concatenate(best, 1), 0) @ self.w + self.b[0], np.array([guess(c) for c in counts])

    def probabilities(self, texts: list[str | None], words: Words) -> np.ndarray:
        logits, languages = self.logits(texts, words)
        return at_threshold(logits, self.cuts[languages])


def fit(texts: list[str], y: np.ndarray, epochs: int = 4, seed: int = 11) -> Network | None:
    if len(set(y.tolist())) < 2:
        return None
    rng, net = np.random.default_rng(seed), Network(seed)
    words = Words(lambda b: b, np.full(1 + len(PREFIXES), -1))
    rows = []
    for t in texts:
        rows.append(np.fromiter(map(words.__getitem__, t.lower().split()), np.int64))
        if len(words.fresh) > 20_000:
            words.grown()
    buckets, _ = words.grown()
    check = np.arange(len(y)) % 5 == 4
    if len(set(y[check].tolist())) < 2 or len(set(y[~check].tolist())) < 2:
        check[:] = False

    # class association of each bucket over the documents of the fit, shrunk where documents are few
    seen = np.zeros((2, BUCKETS))
    for x, label, c in zip(rows, y.tolist(), check.tolist(), strict=True):
        if not c:
            own = np.unique(buckets[x])
            seen[label, own[own >= 0]] += 1
    share = y[~check].mean()
    expected = (seen[0] + seen[1]) * share
    net.e[:, 0] = np.clip((seen[1] - expected) / np.sqrt(expected * (1 - share) + 1) / 4, -1, 4)

    learn = np.flatnonzero(~check)
    weight = np.where(y == 1, 0.5 / max(1, (y[learn] == 1).sum()), 0.5 / max(1, (y[learn] == 0).sum())) * len(learn)
    flat = [("c", k) for k in WIDTHS] + [("d", k) for k in WIDTHS] + [("w", None), ("b", None)]
    get = lambda a, k: getattr(net, a) if k is None else getattr(net, a)[k]
    m, v, step = {x: np.zeros_like(get(*x)) for x in flat}, {x: np.zeros_like(get(*x)) for x in flat}, 0
    # a spare row at the end takes the place of buckets that a word doesn't have
    e = np.concatenate([net.e, np.zeros((1, DIM), np.float32)])
    for _ in range(max(epochs, min(30, 6000 // len(learn)))):
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 16)):
            grad = {x: np.zeros_like(get(*x)) for x in flat}
            for i in part:
                own = buckets[rows[i]]
                x = e[own].sum(1)
                best, places = net.pooled(x)
                pool = np.maximum(best, 0)
                p = 1 / (1 + np.exp(-np.clip(pool @ net.w + net.b[0], -30, 30)))
                d = np.float32((p - y[i]) * weight[i] / len(part))
                grad["w", None] += d * pool
                grad["b", None] += d
                back = (d * net.w * (best > 0)).reshape(len(WIDTHS), PER_WIDTH)
                for a, k in enumerate(WIDTHS):
                    grad["d", k] += back[a]
                    for o in range(k):
                        f = np.flatnonzero((places[a] + o < len(x)) & (back[a] != 0))
                        if len(f):
                            at = places[a][f] + o
                            grad["c", k][o][:, f] += (back[a][f, None] * x[at]).T
                            move = np.clip(back[a][f, None] * net.c[k][o][:, f].T, -1, 1)
                            np.subtract.at(e, own[at], 0.05 * move[:, None, :])
                            e[-1] = 0
            step += 1
            for key in flat:
                m[key] = 0.9 * m[key] + 0.1 * grad[key]
                v[key] = 0.999 * v[key] + 0.001 * grad[key] ** 2
                get(*key)[...] -= 0.01 * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    net.e = e[:-1]
    use = np.flatnonzero(check) if check.any() else np.arange(len(y))
    logits, languages = net.logits([texts[i] for i in use], net.words())
    # a clean document flagged costs four toxic ones missed
    every = cut_between(logits, y[use], above0=4.0)
    net.cuts[:] = every
    for k in range(len(LANGUAGES)):
        own = languages == k
        if y[use][own].sum() >= 15 and (1 - y[use][own]).sum() >= 15:
            net.cuts[k] = cut_between(logits[own], y[use][own], above0=4.0)
    return net


def trained(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network fitted on the labelled rows outside the held-out fold; None without rows of both classes."""
    rows = sample(docs, labels, "toxic", FOLDS, HELD, per_class=2000)
    net = fit(rows["text"].tolist(), rows["y"].to_numpy(dtype=np.int64))
    del rows
    give_back()
    return net


def probability(spark: SparkSession, net: Network | None):
    """The score as a function of a text column. The network (8 MB) is broadcast; its size is a constant."""
    model = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.value
        words = own and own.words()
        claim("toxicity", words.reset if words else lambda: None)
        for x in parts:
            yield pd.Series(np.full(len(x), 0.5) if own is None else own.probabilities(x.tolist(), words))

    return of


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    scored = docs.select(F.col(id_col).alias("doc_id"), probability(docs.sparkSession, net)(F.col(text_col)).alias("score"))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` that are not predicted to be toxic, all columns as they were, whatever their names; all of them without a model (no labels of both classes)."""
    if net is None:
        return docs
    return flagged(docs, probability(docs.sparkSession, net)(F.col(text_col)) < THRESHOLD)
