"""Operator 2: toxicity.

Gradient-boosted trees over dense features of the whole text (lexicon
densities, second-person proximity, capitals, punctuation and obfuscation
rates), with isotonic calibration.

The lexicon is learned: words and word beginnings whose share of toxic
training texts far exceeds that of others. Lexicon, trees and calibration use
at most ``sample_rows`` labelled training rows (those of smallest hashed id),
a documented bound; the counting and the features run on the executors, and
only the features of the sample reach the driver. Every feature is one rule for
texts of all lengths.

Defined cases: null and empty texts are scored from zero features; very long
texts are measured whole; without labelled training rows every score is 0; a
document with several labels is trained on once per label; rows of one doc_id
are trained on each, ties of hashed ids in order of (doc_id, label); equal
features give equal scores; an empty table gives an empty result; repeated
rows are scored each; further columns are ignored."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gzframe.llm.common import bounded_batches, fold, slices

#: Second-person words of the corpus languages.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes vous votre vos tú ti tu tus usted ustedes vosotros os".split())
#: Characters that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": "", "+": "t"}
UNMASK = str.maketrans(DISGUISE)
EDGES = ".,;:!?()[]{}\"'«»„“”‘’…|*#%&$<>/\\=+-_~`^"
INSIDE = re.compile(r"[^\W\d_][\d@$!*._+-]+[^\W\d_]")
BEGIN = (4, 5, 6)

FEATURES = ("words", "begins", "disguised", "any_hit", "hits_log", "distinct_hits", "person", "near_person", "capitals", "shouted", "exclaims", "questions", "marks", "digits", "obfuscated", "repeats", "word_length", "length_log")


@lru_cache(maxsize=1)
def upper_case() -> np.ndarray:
    """Whether each code point is an upper-case letter."""
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


def capitals_and_repeats(text: str) -> tuple[int, int]:
    """Upper-case letters, and threes of one character (line ends aside) in runs of it."""
    capitals = repeats = 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes):
        capitals = int(upper_case()[codes].sum())
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        runs = np.diff(np.append(first, len(codes)))
        repeats = int((runs[codes[first] != 10] // 3).sum())
    return capitals, repeats


def entries(words: set[str]):
    """Lexicon entries that a text's words can match: themselves and, with ``^``, their beginnings."""
    out = set(words)
    for w in words:
        for n in BEGIN:
            if len(w) >= n:
                out.add("^" + w[:n])
    return out


def words_of(text: str) -> list[str]:
    return [c for w in text.lower().split() if (c := w.strip(EDGES))]


def features(text: str | None, lexicon: frozenset[str], begins: frozenset[str]) -> list[float]:
    text = text or ""
    raw = text.split()
    n = max(1, len(raw))
    words = [w.strip(EDGES) for w in text.lower().split()]
    exact = [i for i, w in enumerate(words) if w in lexicon]
    by_begin = [i for i, w in enumerate(words) if w[:4] in begins or w[:5] in begins or w[:6] in begins]
    odd = [(i, w) for i, w in enumerate(words) if w and not w.isalpha()]
    masked = [i for i, w in odd if not w.isdigit() and (u := w.translate(UNMASK)) != w and u in lexicon]
    hits = sorted({*exact, *by_begin, *masked})
    person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and person:
        p = np.array(person)
        at = np.searchsorted(p, hits)
        near = sum(1 for h, k in zip(hits, at, strict=True) if (k < len(p) and p[k] - h <= 5) or (k and h - p[k - 1] <= 5))
    size = max(1, len(text))
    upper = sum(map(str.isupper, raw))
    letters = sum(map(len, words)) or 1
    capitals, repeats = capitals_and_repeats(text)
    digits = sum(len(w) for _, w in odd if w.isdigit())
    return [
        len(exact) / n,
        len(by_begin) / n,
        len(masked) / n,
        float(bool(hits)),
        float(np.log1p(len(hits))),
        float(len({words[i] for i in hits})),
        len(person) / n,
        near / n,
        capitals / letters,
        upper / n,
        text.count("!") / n,
        text.count("?") / n,
        (size - letters - text.count(" ") - text.count("\n")) / size,
        digits / size,
        sum(1 for _, w in odd if INSIDE.search(w)) / n,
        repeats / size,
        letters / n,
        float(np.log1p(n)),
    ]


class Trees:
    """Gradient-boosted regression trees for the log loss, on quantile-binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[list[tuple[int, float, float]]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rows, cols = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(cols)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(rows, self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            grad, hess = y - q, q * (1 - q)
            tree: list[tuple[int, float, float]] = []
            leaf = np.zeros(rows, np.int64)
            nodes = {0: np.arange(rows)}
            # a full binary tree in heap order: (feature, cut, value); feature -1 is a leaf
            for at in range(2 ** (self.depth + 1) - 1):
                own = nodes.get(at)
                if own is None:
                    tree.append((-1, 0.0, 0.0))
                    continue
                g, h = grad[own].sum(), hess[own].sum()
                value, best = self.rate * g / (h + self.ridge), (1e-6, -1, 0)
                if at < 2**self.depth - 1 and len(own) >= 2 * self.least:
                    for j in range(cols):
                        if not len(cuts[j]):
                            continue
                        b = binned[own, j]
                        n = np.cumsum(np.bincount(b, minlength=len(cuts[j]) + 1))[:-1]
                        gl = np.cumsum(np.bincount(b, grad[own], len(cuts[j]) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, hess[own], len(cuts[j]) + 1))[:-1]
                        gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                        gain[(n < self.least) | (len(own) - n < self.least)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, k)
                if best[1] < 0:
                    tree.append((-1, 0.0, value))
                    f[own] += value
                    continue
                low = binned[own, best[1]] <= best[2]
                nodes[2 * at + 1], nodes[2 * at + 2] = own[low], own[~low]
                tree.append((best[1], float(cuts[best[1]][best[2]]), value))
            del leaf
            self.trees.append(tree)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for tree in self.trees:
            feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = feature[at] >= 0
                right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            f += value[at]
        return f


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (raw score, probability) knots of a rising curve."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, first and last score
    for s, v in zip(scores[order], y[order], strict=True):
        pools.append([v, 1, s, s])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            b = pools.pop()
            a = pools[-1]
            pools[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    # half a case on either side keeps the ends off 0 and 1
    xs = np.array([x for p in pools for x in (p[2], p[3])])
    ys = np.array([v for p in pools for v in [(p[0] + 0.5 * float(y.mean())) / (p[1] + 0.5)] * 2])
    return xs, np.maximum.accumulate(ys)


@dataclass
class ToxicityModel:
    lexicon: frozenset[str] = frozenset()
    begins: frozenset[str] = frozenset()
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(texts))
        x = np.array([features(t, self.lexicon, self.begins) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0, 1)


def learn_lexicon(sample: DataFrame, size: int) -> tuple[frozenset[str], frozenset[str]]:
    """Words and beginnings with the highest log odds of toxic texts, at most ``size`` of each."""

    def count(batches):
        from collections import Counter

        c: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c[toxic].update(entries(set(words_of(text or ""))))
                c[toxic][""] += 1
        for y in (0, 1):
            keys = list(c[y])
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                n = [c[y][k] for k in part]
                zero = [0] * len(part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(n if y else zero, pa.int64()), pa.array(zero if y else n, pa.int64())], ["entry", "pos", "neg"])

    counts = sample.select("text", "toxic").mapInArrow(count, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.where("pos >= 3 or entry = ''").persist()
    total = counts.where("entry = ''").first()
    if total is None or not total.pos or not total.neg:
        counts.unpersist()
        return frozenset(), frozenset()
    odds = F.log((F.col("pos") + 0.1) / (total.pos + 0.2)) - F.log((F.col("neg") + 0.1) / (total.neg + 0.2))
    strong = counts.where("entry <> ''").withColumn("odds", odds).where("odds > 2.5")
    words = strong.where("not startswith(entry, '^')").orderBy(F.desc("odds"), "entry").limit(size).collect()
    begins = strong.where("startswith(entry, '^')").orderBy(F.desc("odds"), "entry").limit(size).collect()
    counts.unpersist()
    return frozenset(r.entry for r in words), frozenset(r.entry[1:] for r in begins)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, lexicon_size: int = 400) -> ToxicityModel:
    """Fit on the labelled rows of ``docs`` (doc_id, text); ``labels``: doc_id, toxic."""
    spark = docs.sparkSession
    picked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    ids = [(r.doc_id, r.toxic) for r in picked.collect()]
    if not ids:
        return ToxicityModel()
    few = spark.createDataFrame(ids, "_id long, toxic int")  # at most sample_rows rows of two numbers
    sample = docs.join(F.broadcast(few), docs.doc_id == few._id).select("doc_id", "text", "toxic")
    # the lexicon is learned on other rows than the trees, so its features are honest for these
    half = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2))
    lexicon, begins = learn_lexicon(sample.where(half == 0), lexicon_size)

    def measure(batches):
        for batch in batches:
            ids, texts, toxic = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array([features(t, lexicon, begins) for t in texts], pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    rows = sorted(map(tuple, sample.where(half == 1).mapInArrow(measure, "doc_id long, toxic int, x array<double>").collect()))
    y = np.array([r[1] for r in rows], dtype=np.float64)
    if not len(rows) or y.min() == y.max():
        return ToxicityModel()
    x = np.array([r[2] for r in rows])
    back = np.random.default_rng(2).random(len(y)) < 0.3
    if y[back].size == 0 or y[~back].size == 0 or y[~back].min() == y[~back].max() or y[back].min() == y[back].max():
        back = np.ones(len(y), bool)
        trees = Trees().fit(x, y)
    else:
        trees = Trees().fit(x[~back], y[~back])
    return ToxicityModel(lexicon, begins, trees, isotonic(trees.raw(x[back]), y[back]))


def score(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 8000, threshold: float = 0.7, mod: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows whose crc32(doc_id) mod ``mod`` is not ``out``."""
    bounded_batches(docs.sparkSession)
    base = docs.select("doc_id", "text").withColumn("held_out", fold("doc_id", mod) == out)
    model = train(base.where("not held_out"), labels.where(fold("doc_id", mod) != out), sample_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            i = 0
            for texts in slices(batch.column(1)):
                part = batch.slice(i, len(texts))
                s = sent.value.score(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
                i += len(texts)

    return base.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
