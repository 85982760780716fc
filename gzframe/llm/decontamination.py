"""Operator 7: benchmark decontamination.

Test items form a BM25 inverted index whose postings are cut in blocks of
items, with the largest impact of each term in each block. Every document is
cut into overlapping passages, each a query. As in block-max WAND, a passage is
given up as soon as the sum of its terms' largest impacts cannot reach the
threshold; then only the blocks in which its terms have postings are visited,
the rest is skipped, and of these only the blocks whose largest impacts add up
to a threshold are scored. All items above their threshold are verified by the
share of question and answer words that matching five-word shingles cover; a
question or answer of fewer words must stand in the passage as a whole, where
the shingles that run from one into the other do not cover it.

The threshold of an item is ``reach`` times the score of the item as its own
query. An index holds at most ``index_items`` items and is what is broadcast;
a larger benchmark is searched in several passes over the documents, one
index each, so what is broadcast has a fixed bound.

Defined cases: null, empty and wordless documents and items match nothing;
texts of any length are cut into passages whole; an item's passage of equal
overlaps and scores is the first; items of equal text each match; repeated rows
of documents each give their matches; empty tables give an empty result;
further columns are ignored, and kept by ``without_leaks`` whatever their
names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gzframe.llm.common import bounded_batches, free_name, slices

K1, B = 1.2, 0.75
SHINGLE = 5
#: Items in a block of the index.
BLOCK = 4
#: Words are runs of ASCII letters, digits and of all characters beyond ASCII, as UTF-8.
BETWEEN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SENTENCE = re.compile(r"(?<=[.!?])\s+")
HIT = "item_id long, passage long, bm25 double, question_overlap double, answer_overlap double"


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(BETWEEN).split() if text else []


def question_and_answer(text: str | None) -> tuple[str, str]:
    """An item's last sentence is its answer; an item of one sentence has none."""
    parts = [p for p in SENTENCE.split((text or "").strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text or "", "")


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


class Index:
    """Block-structured BM25 index of items (item_id, question, answer)."""

    def __init__(self, items: list[tuple[int, str, str]], reach: float):
        self.ids, self.question, self.words = [], [], []
        for item_id, question, answer in items:
            q = words_of(question)
            w = q + words_of(answer)
            if w:
                self.ids.append(item_id)
                self.question.append(len(q))
                self.words.append(w)
        n = len(self.ids)
        terms: dict[bytes, dict[int, int]] = {}
        for i, w in enumerate(self.words):
            for t in w:
                at = terms.setdefault(t, {})
                at[i] = at.get(i, 0) + 1
        self.vocabulary = {t: k for k, t in enumerate(terms)}
        mean = sum(map(len, self.words)) / max(n, 1)
        # postings in one array, items ascending within a term
        self.start = np.zeros(len(terms) + 1, np.int64)
        items_, impacts = [], []
        self.blocks = -(-n // BLOCK) if n else 0
        for k, at in enumerate(terms.values()):
            idf = np.log(1 + (n - len(at) + 0.5) / (len(at) + 0.5))
            for i, tf in sorted(at.items()):
                items_.append(i)
                impacts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(self.words[i]) / mean)))
            self.start[k + 1] = len(items_)
        self.items, self.impacts = np.array(items_, np.int64), np.array(impacts)
        # the largest impact of each term in each block where it has postings, and over all of them
        of = np.repeat(np.arange(len(terms)), np.diff(self.start))
        cell = of * max(self.blocks, 1) + self.items // BLOCK
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.block_of = self.items[first] // BLOCK
        self.block_max = np.maximum.reduceat(self.impacts, first) if len(first) else np.zeros(0)
        self.block_start = np.searchsorted(of[first], np.arange(len(terms) + 1))
        self.term_max = np.zeros(len(terms) + 1)
        np.maximum.at(self.term_max, of, self.impacts)
        own = np.zeros(n)
        for k in range(len(terms)):
            own[self.items[self.start[k] : self.start[k + 1]]] += self.impacts[self.start[k] : self.start[k + 1]]
        # a little below, for sums in another order or in single precision
        self.threshold = own * reach * (1 - 1e-5)
        self.block_least = np.array([self.threshold[b * BLOCK : (b + 1) * BLOCK].min() for b in range(self.blocks)])
        self.least = self.threshold.min() if n else np.inf
        # the same postings by block of items, for scoring a block that survives
        by = np.argsort(self.items, kind="stable")
        cut = np.searchsorted(self.items[by], np.arange(0, (self.blocks + 1) * BLOCK, BLOCK))
        self.in_block = [(of[k], self.items[k] - b * BLOCK, self.impacts[k]) for b in range(self.blocks) for k in [by[cut[b] : cut[b + 1]]]]
        self.stride = max([64, *map(len, self.words)])

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All items that a passage's distinct terms score at or above their thresholds."""
        lo = self.block_start[terms]
        k = self.block_start[terms + 1] - lo
        at = np.repeat(lo - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
        bounds = np.bincount(self.block_of[at], self.block_max[at], self.blocks)
        alive = np.flatnonzero(bounds >= self.block_least)
        if not alive.size:
            return []
        there, out = np.zeros(len(self.vocabulary) + 1, bool), []
        there[terms] = True
        for b in alive.tolist():
            term, item, impact = self.in_block[b]
            hit = there[term]
            scores = np.bincount(item[hit], impact[hit], BLOCK)
            out += [(i, float(scores[k])) for k, i in enumerate(range(b * BLOCK, min((b + 1) * BLOCK, len(self.ids)))) if scores[k] >= self.threshold[i] and scores[k] > 0]
        return out

    def verify(self, item: int, there: set, passage: bytes) -> tuple[float, float]:
        """Shares of the item's question and answer words that shingles in ``there`` cover; an absent part counts as covered."""
        w, q = self.words[item], self.question[item]
        covered = np.zeros(len(w), bool)
        for i, s in enumerate(shingles(w)):
            if s in there:
                covered[i : i + SHINGLE] = True
        for part in (slice(0, q), slice(q, len(w))):
            words = w[part]
            if 0 < len(words) < SHINGLE and not covered[part].all() and b" %b " % b" ".join(words) in passage:
                covered[part] = True
        return float(covered[:q].mean()) if q else 1.0, float(covered[q:].mean()) if q < len(w) else 1.0

    def scan(self, text: str | None, overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(item_id, passage, bm25, question and answer overlap) of a whole document; the best passage of each item."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        get, none = self.vocabulary.get, len(self.vocabulary)
        terms = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        # passages of two strides, one stride apart: any item lies within one of them
        total = np.concatenate([[0.0], np.cumsum(self.term_max[terms], dtype=np.float64)])
        begin = np.arange(0, max(1, len(words) - self.stride), self.stride)
        end = np.minimum(begin + 2 * self.stride, len(words))
        best: dict[int, tuple[int, float, float, float]] = {}
        for p in np.flatnonzero(total[end] - total[begin] >= self.least):
            a, b = int(begin[p]), int(end[p])
            known = np.unique(terms[a:b])
            known = known[known < none]
            if self.term_max[known].sum(dtype=np.float64) < self.least:
                continue
            hits = self.search(known)
            if hits:
                there = set(shingles(words[a:b]))
                passage = b" %b " % b" ".join(words[a:b])
                for i, score in hits:
                    question, answer = self.verify(i, there, passage)
                    if question >= overlap and answer >= overlap and (i not in best or (question + answer, score) > (best[i][2] + best[i][3], best[i][1])):
                        best[i] = (int(p), score, question, answer)
        return [(self.ids[i], *v) for i, v in sorted(best.items())]


def indexes(benchmark: DataFrame, reach: float, index_items: int):
    """One index after another, of at most about ``index_items`` items each."""
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text")
    groups = -(-items.count() // index_items)
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        yield Index(sorted((r.item_id, *question_and_answer(r.text)) for r in rows), reach)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], *, reach: float = 0.5, overlap: float = 0.8, index_items: int = 8192) -> DataFrame:
    """``keep`` columns of ``docs`` with one row per (document, item) found."""
    spark = bounded_batches(docs.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), HIT])
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def over(sent):
        def run(batches):
            for batch in batches:
                at = 0
                for texts in slices(batch.column(batch.num_columns - 1)):
                    take, found = [], []
                    for k, text in enumerate(texts.to_pylist(), at):
                        hits = sent.value.scan(text, overlap)
                        take += [k] * len(hits)
                        found += hits
                    at += len(texts)
                    columns = [c.take(pa.array(take, pa.int64())) for c in batch.columns[:-1]]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    columns += [pa.array([h[j] for h in found], kind) for j, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(columns, [*keep, "item_id", "passage", "bm25", "question_overlap", "answer_overlap"])

        return run

    found = [rows.mapInArrow(over(spark.sparkContext.broadcast(ix)), schema) for ix in indexes(benchmark, reach, index_items)]
    if not found:
        return rows.mapInArrow(over(spark.sparkContext.broadcast(Index([], reach))), schema)
    return reduce(DataFrame.unionByName, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, reach: float = 0.5, overlap: float = 0.8, index_items: int = 8192) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, all columns kept; only texts go to Python."""
    spark = bounded_batches(docs.sparkSession)

    def leaks(sent):
        @arrow_udf("boolean")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([bool(sent.value.scan(text, overlap)) for texts in slices(batch) for text in texts.to_pylist()], pa.bool_())

        return run(F.col("text"))

    name = free_name(docs, "_leaks")
    for index in indexes(benchmark, reach, index_items):
        docs = docs.withColumn(name, leaks(spark.sparkContext.broadcast(index))).where(~F.col(name)).drop(name)
    return docs
