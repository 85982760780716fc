"""Operator 6: language-model scoring by Katz backoff.

Counts of 1- to ``order``-grams of all training texts are stored in tables
partitioned by history: flat sorted files in the shared folder, one set per
bucket of histories. Good-Turing discounts for counts up to ``GT`` come from
the global counts of counts. A history's record holds its count, how many of
its continuations occurred 1..GT times, and the sum of their lower-order
probabilities, from which its backoff weight follows, normalised exactly.
Where no count of a history is discounted, half a count more is reserved for
the unseen and its seen counts are divided by the larger total; the same holds
for the unigrams. A token is evaluated recursively: its discounted n-gram if that was seen, else
its history's weight times the probability after the shorter history. All
unseen words are one class, with the discounted mass of the unigrams.

Counting sends each piece of text's distinct n-grams once, as packed arrays
(one row per piece and bucket), so a frequent word or history costs a piece
one entry. The continuations of one history meet in one bucket, but those of a
history that occurs ``HOT`` times or more (known from the order below) are dealt
by word as well, and their buckets' partial sums are added up. Scoring maps the
sorted files and looks up the distinct n-grams of a piece by binary search; no
text and no count is shuffled for it. What is sent to all tasks is the list of
hot histories, a few for each bucket.

Defined cases: null and empty texts are the end token alone; very long texts are
counted and scored whole; without training texts every token is of the unseen
class with probability 1; repeated rows are counted and scored each, equal texts
alike; a null doc_id is a training row; an empty table gives an empty result;
further columns are ignored."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gzframe.llm.common import bounded_batches, fold, fresh_path, local_path, partitions, written
from gzframe.llm.word_hashes import mix, unmix, word_hashes

#: Counts up to this are discounted.
GT = 5
#: Counts reserved for the unseen where no count is discounted.
SPARE = 0.5
END = np.uint64(0x5BD1E9955BD1E995)
START = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text whose n-grams are counted together before they are sent.
PIECE = 2_000_000
#: Tokens in a bucket of a table, about.
BUCKET = 1_500_000
#: Occurrences from which a history's continuations are dealt over all buckets.
HOT = 400_000


#: What is kept of a history: its count, the lower-order probability of its continuations, and how many occurred 1..GT times.
STATS = {"total": "<f8", "below": "<f8"} | {f"n{r}": "<u4" for r in range(1, GT + 1)}


def pieces(texts: list[str | None]):
    """Yields (first text, token hashes, tokens per text): words and then an end, about two megabytes of text at a time."""
    for first, words, counts in word_hashes(texts, PIECE):
        yield first, np.insert(words, np.cumsum(counts), END), counts + 1


def histories(tokens: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` tokens before each token; texts begin with start marks."""
    h = np.zeros(len(tokens), np.uint64)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    for k in range(1, length + 1):
        before = np.full(len(tokens), START)
        has = np.flatnonzero(place >= k)
        before[has] = tokens[has - k]
        h = mix(h + before + np.uint64(k))
    return h


def entry_keys(history: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(history ^ (words * np.uint64(0x9E3779B97F4A7C15)))


def factors(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Good-Turing factors by count, 1 beyond GT; one half for single counts where there are too few for an estimate."""
    n = [0, *(counts_of_counts.get(r, 0) for r in range(1, GT + 2))]
    d = np.ones(GT + 2)
    common = (GT + 1) * n[GT + 1] / n[1] if n[1] else 1.0
    for r in range(1, GT + 1):
        if n[r] and n[r + 1] and common < 1:
            f = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            d[r] = f if 0 < f < 1 else 1.0
    if d[1] == 1.0:
        d[1] = 0.5
    return d


@dataclass
class Level:
    """One order's tables: where they are, buckets, discounts, and for unigrams the totals."""

    folder: str
    buckets: int
    discount: np.ndarray
    total: int = 0
    types: int = 0
    unseen: float = 1.0
    spare: float = 0.0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


@lru_cache(maxsize=4096)
def _mapped(path: str, kind: str):
    return np.memmap(path, dtype=kind, mode="r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


def _save(folder: str, bucket: int, **arrays) -> None:
    for name, a in arrays.items():
        tmp = f"{folder}/.{bucket}-{os.getpid()}-{os.urandom(4).hex()}"
        np.ascontiguousarray(a).tofile(tmp)
        os.replace(tmp, f"{folder}/{bucket:06d}.{name}")


def _counts_of(n: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all of a bucket's fit, else in 64; a file's size tells which."""
    return n.astype("<u4" if n.max(initial=0) < 2**32 else "<u8")


def _find(level: Level, keys: np.ndarray, by: np.ndarray, key_file: str, value_files: list[tuple[str, str]]) -> list[np.ndarray]:
    """Look sorted-by-bucket ``keys`` up in a level's files; ``by`` gives their buckets. Zero where absent."""
    out = [np.zeros(len(keys), kind) for _, kind in value_files]
    order = np.lexsort((keys, by))
    # the file after the last bucket has the hot histories
    cut = np.searchsorted(by[order], np.arange(level.buckets + 2))
    for b in np.flatnonzero(np.diff(cut)):
        at = order[cut[b] : cut[b + 1]]
        table = _mapped(f"{level.folder}/{b:06d}.{key_file}", "<u8")
        if not len(table):
            continue
        where = np.searchsorted(table, keys[at])
        where[where == len(table)] = 0
        hit = table[where] == keys[at]
        for o, (name, kind) in zip(out, value_files, strict=True):
            path = f"{level.folder}/{b:06d}.{name}"
            if name == "counts" and os.path.getsize(path) == 4 * len(table):
                kind = "<u4"
            o[at[hit]] = _mapped(path, kind)[where[hit]]
    return out


def _of(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values) % np.uint64(buckets)).astype(np.int64)


def is_in(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted ``some``."""
    if not len(some):
        return np.zeros(len(values), bool)
    at = np.searchsorted(some, values)
    at[at == len(some)] = 0
    return some[at] == values


def _of_entry(history: np.ndarray, words: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    """The bucket of an n-gram: its history's, or for a hot history its own."""
    by, often = _of(history, buckets), is_in(history, hot)
    by[often] = _of(entry_keys(history[often], words[often]), buckets)
    return by


class Model:
    """The levels of a trained model; evaluation of many (history, word) at once."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def unigrams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, probabilities) of words."""
        level = self.levels[0]
        (count,) = _find(level, words, _of(words, level.buckets), "keys", [("counts", "<u8")])
        count = count.astype(np.float64)
        p = count * level.discount[np.minimum(count, GT + 1).astype(np.int64)] / (max(level.total, 1) + level.spare)
        return count, np.where(count > 0, p, level.unseen)

    def step(self, k: int, history: np.ndarray, words: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of order ``k`` from those of the order below."""
        level = self.levels[k - 1]
        (count,) = _find(level, entry_keys(history, words), _of_entry(history, words, level.buckets, level.hot), "keys", [("counts", "<u8")])
        count = count.astype(np.float64)
        by = np.where(is_in(history, level.hot), level.buckets, _of(history, level.buckets))
        stats = _find(level, history, by, "histories", list(STATS.items()))
        total, below = stats[0], stats[1]
        gone = sum((1 - level.discount[r]) * r * stats[1 + r].astype(np.float64) for r in range(1, GT + 1))
        spare = np.where(gone == 0, SPARE, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = count * level.discount[np.minimum(count, GT + 1).astype(np.int64)] / (total + spare)
            weight = (gone + spare) / (total + spare) / np.maximum(1 - below, 1e-12)
        return np.where(total == 0, lower, np.where(count > 0, seen, weight * lower))

    def probabilities(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unigram counts, probabilities) of all tokens of some texts."""
        own, back = np.unique(tokens, return_inverse=True)
        c, p = self.unigrams(own)
        c, p = c[back], p[back]
        for k in range(2, len(self.levels) + 1):
            h = histories(tokens, counts, k - 1)
            _, first, back = np.unique(entry_keys(h, tokens), return_index=True, return_inverse=True)
            p = self.step(k, h[first], tokens[first], p[first])[back]
        return c, p


def _count(order: int, buckets: int, hot: np.ndarray):
    """Distinct n-grams of each piece with counts: one row per piece and bucket.

    histories: hash (8 bytes), shorter history (8), continuations (4); entries: word (8) and count (4), by history and word."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for _, tokens, counts in pieces(batch.column(0).to_pylist()):
                h = histories(tokens, counts, order - 1) if order > 1 else np.zeros(len(tokens), np.uint64)
                w = tokens
                by = _of_entry(h, w, buckets, hot) if order > 1 else _of(w, buckets)
                sort = np.lexsort((w, h, by))
                h, w, by = h[sort], w[sort], by[sort]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(h))).astype("<u4")
                short = histories(tokens, counts, order - 2)[sort][at] if order > 2 else np.zeros(len(at), np.uint64)
                h, w, by = h[at], w[at], by[at]
                cut = np.searchsorted(by, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)):
                    s = slice(cut[b], cut[b + 1])
                    first = np.flatnonzero(np.concatenate([[True], h[s][1:] != h[s][:-1]]))
                    runs = np.diff(np.append(first, cut[b + 1] - cut[b])).astype("<u4")
                    for o, v in zip(out, (int(b), h[s][first].tobytes(), short[s][first].tobytes() if order > 2 else b"", runs.tobytes(), w[s].tobytes(), n[s].tobytes()), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(o, pa.binary()) for o in out[1:])], ["bucket", "history", "short", "runs", "words", "counts"])

    return run


MERGED = "kind int, value long, stats array<double>"
#: Kinds of merged rows: counts of counts and totals by ``value``; partial sums of a hot history; a history that is hot at the next order.
COUNTS, PARTIAL, OFTEN = 0, 1, 2


def _merge(order: int, folder: str, lower: Model, hot: np.ndarray, hot_from: int):
    """Add a bucket's pieces up, write its files, and report counts of counts, totals and what concerns hot histories."""

    def run(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        w, n, runs = join("words", "<u8"), join("counts", "<u4"), join("runs", "<u4")
        h = np.repeat(join("history", "<u8"), runs)
        sort = np.lexsort((w, h))
        h, w, n = h[sort], w[sort], n[sort]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
        count = np.add.reduceat(n.astype(np.int64), at)
        short = np.repeat(join("short", "<u8"), runs)[sort][at] if order > 2 else None
        h, w = h[at], w[at]
        bucket = table["bucket"][0].as_py()
        r = np.arange(1, GT + 2)
        rows = [(COUNTS, int(x), [float((count == x).sum())]) for x in r] + [(COUNTS, 0, [float(len(count))]), (COUNTS, -1, [float(count.sum())])]
        often = count >= hot_from
        if order == 1:
            _save(folder, bucket, keys=w, counts=_counts_of(count))
            after = mix(w[often] + np.uint64(1))
        else:
            key = entry_keys(h, w)
            k = np.argsort(key)
            _save(folder, bucket, keys=key[k], counts=_counts_of(count[k]))
            below = lower.unigrams(w)[1]
            if order > 2:
                # at order three the shorter history is one word; deeper ones would nest their own shorter histories
                below = lower.step(order - 1, short, w, below)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            stats = np.stack([np.add.reduceat(v, first) for v in (count.astype("<f8"), below, *((count == x).astype("<f8") for x in r[:-1]))])
            apart = is_in(h[first], hot)
            rows += [(PARTIAL, int(v), list(map(float, s))) for v, s in zip(h[first][apart].view(np.int64), stats[:, apart].T, strict=True)]
            _save(folder, bucket, histories=h[first][~apart], **{name: v.astype(kind) for (name, kind), v in zip(STATS.items(), stats[:, ~apart], strict=True)})
            # the word before, from its history's hash; at order two that is one word
            after = mix(mix(w[often] + np.uint64(1)) + (unmix(h[often]) - np.uint64(1)) + np.uint64(2)) if order == 2 else np.zeros(0, np.uint64)
        rows += [(OFTEN, int(v), []) for v in after.view(np.int64)]
        return pa.table({"kind": pa.array([x[0] for x in rows], pa.int32()), "value": pa.array([x[1] for x in rows], pa.int64()), "stats": pa.array([x[2] for x in rows], pa.list_(pa.float64()))})

    return run


def train(docs: DataFrame, order: int = 2, folder: str | None = None, hot_from: int = HOT) -> Model:
    """Count all texts of ``docs`` (text) and write the model's tables under ``folder``; ``order`` 1 to 3."""
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    spark = bounded_batches(docs.sparkSession)
    folder = local_path(folder or fresh_path(spark, "katz"))
    levels: list[Level] = []
    total, hot = 0, np.zeros(0, np.uint64)
    for k in range(1, order + 1):
        at = f"{folder}/{k}"
        os.makedirs(at, exist_ok=True)
        buckets = max(4, partitions(spark), -(-total // BUCKET))
        rows = docs.select("text").mapInArrow(_count(k, buckets, hot), "bucket int, history binary, short binary, runs binary, words binary, counts binary")
        found = written(rows.groupBy("bucket").applyInArrow(_merge(k, at, Model(list(levels)), hot, hot_from), MERGED), "katz-merged")
        n = {r.value: int(r.n) for r in found.where(F.col("kind") == COUNTS).groupBy("value").agg(F.sum(F.get("stats", F.lit(0))).alias("n")).collect()}
        level = Level(at, buckets, factors(n), n.get(-1, 0), n.get(0, 0), hot=hot)
        if len(hot):
            sums = found.where(F.col("kind") == PARTIAL).groupBy("value").agg(*(F.sum(F.get("stats", F.lit(i))).alias(name) for i, name in enumerate(STATS))).toArrow()
            own = sums["value"].to_numpy().view(np.uint64)
            sort = np.argsort(own)
            _save(at, buckets, histories=own[sort], **{name: sums[name].to_numpy()[sort].astype(kind) for name, kind in STATS.items()})
        if k == 1:
            total = level.total
            if total:
                gone = float(sum((1 - level.discount[r]) * r * n.get(r, 0) for r in range(1, GT + 1)))
                level.spare = 0.0 if gone else SPARE
                level.unseen = (gone + level.spare) / (total + level.spare)
        levels.append(level)
        if k < order:
            often = found.where(F.col("kind") == OFTEN).select("value").distinct().toArrow()["value"].to_numpy().view(np.uint64)
            # texts begin with start marks, as often as there are texts: taken as hot at any size
            begin = np.zeros(1, np.uint64)
            for j in range(1, k + 1):
                begin = mix(begin + START + np.uint64(j))
            hot = np.unique(np.concatenate([often, begin]))
    return Model(levels)


def score(docs: DataFrame, *, order: int = 2, mod: int = 5, out: int = 1, folder: str | None = None, hot_from: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows whose crc32(doc_id) mod ``mod`` is not ``out``."""
    base = docs.select("doc_id", "text").withColumn("held_out", fold("doc_id", mod) == out)
    model = train(base.where("not held_out"), order, folder, hot_from)
    total, types = model.levels[0].total, model.levels[0].types

    def run(batches):
        for batch in batches:
            ids, held = batch.column(0), batch.column(2)
            for first, tokens, counts in pieces(batch.column(1).to_pylist()):
                c, p = model.probabilities(tokens, counts)
                at = np.cumsum(counts) - counts
                sums = lambda v, at=at: np.add.reduceat(v, at)
                k = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, k), held.slice(first, k), pa.array(counts.astype(np.int64)), pa.array(sums((c > 0).astype(np.int64))), pa.array(np.full(k, total, np.int64)),
                        pa.array(sums(np.log10((c + 0.5) / (total + 0.5 * (types + 1))))), pa.array(sums(np.log10(p))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return base.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
