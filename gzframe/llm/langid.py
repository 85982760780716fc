"""Operator 8: language identification.

Sparse multinomial logistic regression on TF-IDF character 1- to 3-grams
(hashed), trained with follow-the-regularised-leader and elastic-net
penalties, then temperature calibration.

Document frequencies cover every training text. The languages are those of all
training rows (the ``languages`` most frequent, a documented bound); the
regression is fitted on the driver on at most ``sample_rows`` labelled texts,
a documented bound, drawn by hashed id in equal numbers from each language.
Term frequencies are relative, so a text's logits are a mean of table rows and
a text of any length is scored in bounded pieces.

Defined cases: a null text or one without a letter gives ``und`` with score 0;
null or missing languages are not learned from; without any labelled training
text every text is ``und``; of languages with equal scores the first by name
is given; of rows with one doc_id the smallest (lang, text) is trained on; an
empty table gives an empty result; further columns are ignored, and kept by
``keep_identified`` whatever their names; repeated rows are scored each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from gzframe.llm.common import bounded_batches, fold, free_name, slices

LETTER = re.compile(r"[^\W\d_]")
#: Characters hashed at a time.
PIECE = 1_000_000


def gram_slots(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Slots of the 1-, 2- and 3-grams that begin at each position of ``codes`` (uint32)."""
    shift = np.uint32(32 - bits)
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, 4):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        out.append((h >> shift).astype(np.int32))
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def counts_of(text: str, bits: int) -> np.ndarray:
    """Counts of all gram slots of a whole text."""
    total = np.zeros(1 << bits, np.int64)
    codes = codes_of(text)
    for i in range(0, max(1, len(codes)), PIECE):
        for s in gram_slots(codes[i : i + PIECE + 2], bits):
            total += np.bincount(s[:PIECE], minlength=1 << bits)
    return total


@dataclass
class Settings:
    bits: int = 15
    sample_rows: int = 3000
    languages: int = 500
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.02
    scale: float = 4.0
    held_back: float = 0.2


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray = field(repr=False)
    bias: np.ndarray
    bits: int
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row per text: the bias and the mean of the table's rows over all grams."""
        k = len(self.labels)
        out = np.zeros((len(texts), k))
        codes = [codes_of(t) for t in texts]
        i = 0
        while i < len(codes):
            j, n = i, 0
            while j < len(codes) and (j == i or n + len(codes[j]) <= PIECE):
                n += len(codes[j])
                j += 1
            if n > PIECE:
                out[i] = self._long(codes[i])
            else:
                out[i:j] = self._joined(codes[i:j])
            i = j
        return out + self.bias

    def _long(self, codes):
        total, n = np.zeros(len(self.labels)), 0
        for i in range(0, len(codes), PIECE):
            for s in gram_slots(codes[i : i + PIECE + 2], self.bits):
                s = s[:PIECE]
                total += self.table[s].sum(axis=0, dtype=np.float64)
                n += len(s)
        return total / max(n, 1)

    def _joined(self, parts):
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total, n = np.zeros((len(parts), len(self.labels))), np.zeros(len(parts))
        joined = np.concatenate(parts)
        for g, s in enumerate(gram_slots(joined, self.bits)):
            # grams that would run over a text's end are left out
            full = np.maximum(lengths - g, 0)
            some = np.flatnonzero(full)
            bounds = np.stack([starts[some], starts[some] + full[some]], axis=1).ravel()
            if bounds.size and bounds[-1] >= len(s):
                bounds = bounds[:-1]
            if bounds.size:
                total[some] += np.add.reduceat(self.table[s], bounds, axis=0)[::2]
                n[some] += full[some]
        return total / np.maximum(n, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t is not None and self.labels and LETTER.search(t)]
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            p = softmax(self.logits([texts[i] for i in known]) / self.temperature)
            for i, row in zip(known, p, strict=True):
                b = int(row.argmax())
                labels[i], scores[i] = self.labels[b], float(row[b])
        return labels, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(examples, targets, k: int, dims: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over sparse rows (slots, values): weights (dims, k) and biases (k)."""
    z, n = np.zeros((dims + 1, k)), np.zeros((dims + 1, k))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(z[at]) <= s.l1, 0.0, w)

    rng = np.random.default_rng(8)
    for _ in range(s.epochs):
        for i in rng.permutation(len(examples)):
            slots, values = examples[i]
            at, x = np.append(slots, dims), np.append(values, 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[targets[i]] -= 1
            g = x[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = weights(np.arange(dims + 1))
    return w[:dims], w[dims]


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of least log loss, by a bounded search."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 10, 80):
        p = softmax(logits / t)[np.arange(len(targets)), targets]
        best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), float(t)))
    return best[1]


def document_frequencies(docs: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Texts, and texts that hold each gram slot, over all of ``docs``."""

    def count(batches):
        df, texts = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen, codes = np.zeros(1 << bits, bool), codes_of(text)
                    for i in range(0, len(codes), PIECE):
                        for s in gram_slots(codes[i : i + PIECE + 2], bits):
                            seen[s] = True
                    df += seen
                    texts += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], texts))], ["slot", "n"])

    rows = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << bits)
    texts = 0
    for slot, n in rows:
        if slot < 0:
            texts = n
        else:
            df[slot] = n
    return texts, df


def sampled_ids(labelled: DataFrame, s: Settings) -> list[int]:
    """At most ``sample_rows`` ids of ``labelled`` (doc_id, lang), about as many of each language; texts are not read."""
    known = labelled.where("doc_id is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(s.languages).collect()
    if not counts:
        return []
    # languages of few rows leave their room to the others
    room, share = s.sample_rows, {}
    for k, r in enumerate(sorted(counts, key=lambda r: (r.n, r.lang))):
        share[r.lang] = min(r.n, max(1, room // (len(counts) - k)))
        room = max(0, room - share[r.lang])
    chance = labelled.sparkSession.createDataFrame([(r.lang, min(1.0, 1.5 * share[r.lang] / r.n + 20 / r.n), share[r.lang]) for r in counts], "_lang string, chance double, share long")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    few = known.join(F.broadcast(chance), F.col("lang") == F.col("_lang")).where(drawn < F.col("chance")).groupBy("lang", "share", "doc_id").agg(F.min(F.xxhash64("doc_id")).alias("h"))
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    rows = few.withColumn("k", F.row_number().over(w)).where("k <= share").select("doc_id").distinct().collect()
    return sorted(r.doc_id for r in rows)[: s.sample_rows]


def train(docs: DataFrame, settings: Settings | None = None) -> LanguageModel:
    """Fit on labelled rows of ``docs`` (doc_id, text, lang); all of them are training rows."""
    s = settings or Settings()
    usable = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    ids = sampled_ids(usable.select("doc_id", "lang"), s)
    few = docs.sparkSession.createDataFrame([(i,) for i in ids], "_id long")
    # rows of one id count once: a partial minimum leaves one row of each in a task
    rows = usable.join(F.broadcast(few), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min(F.struct("lang", "text")).alias("x"))
    sample = sorted(rows.select("_id", "x.lang", "x.text").collect()) if ids else []
    if not sample:
        return LanguageModel([], np.zeros((1 << s.bits, 0), np.float32), np.zeros(0), s.bits)
    texts, df = document_frequencies(usable, s.bits)
    idf = np.log((1 + texts) / (1 + df)) + 1
    labels = sorted({r.lang for r in sample})
    y = np.array([labels.index(r.lang) for r in sample])
    examples = []
    for r in sample:
        c = counts_of(r.text, s.bits)
        at = np.flatnonzero(c)
        examples.append((at, c[at] / max(1, c.sum()) * idf[at] * s.scale))
    held = max(0, int(len(examples) * s.held_back)) if len(examples) >= 20 else 0
    w, b = ftrl(examples[held:], y[held:], len(labels), 1 << s.bits, s)
    model = LanguageModel(labels, (w * idf[:, None] * s.scale).astype(np.float32), b, s.bits)
    if held:
        model.temperature = temperature(model.logits([r.text for r in sample[:held]]), y[:held])
    return model


def predicted(spark, model: LanguageModel) -> Column:
    """struct<lang_pred, score> of the whole ``text``; other columns stay in the JVM."""
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            labels, scores = [], []
            for part in slices(batch):
                found = sent.value.predict(part.to_pylist())
                labels += found[0]
                scores += found[1]
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return run(F.col("text"))


def identify(docs: DataFrame, settings: Settings | None = None, mod: int = 3, out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows whose crc32(doc_id) mod ``mod`` is not ``out``."""
    spark = bounded_batches(docs.sparkSession)
    base = docs.select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", mod) == out)
    model = train(base.where("not held_out"), settings)
    return base.select("doc_id", "held_out", predicted(spark, model).alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, least: float = 0.5, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of ``least`` or more, all columns kept."""
    spark = bounded_batches(docs.sparkSession)
    base = docs.select("doc_id", "text", "lang").where(fold("doc_id", 3) != 1)
    model = train(base, settings)
    if not model.labels:
        return docs.limit(0)
    name = free_name(docs, "_found")
    found = docs.withColumn(name, predicted(spark, model))
    return found.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).drop(name)
