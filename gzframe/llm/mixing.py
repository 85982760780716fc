"""Operator 10: mixing sources to target weights.

Each source's words, in document order, are packed into blocks of a fixed
number of words. Targets are water-filled on the driver from one total per
source. Output shards draw their source counts from a multinomial that is
conditioned on the sources' quotas (a multivariate hypergeometric draw), a
source's slots go through a pseudorandom permutation of its block indices
(swap-or-not, one key per pass), and slots meet blocks in a join by index.

Only the totals per source and the shard table (``shards`` x sources, bounded
by the parameter) are held on the driver.

Defined cases: null text has size 0; a null source is a source of its own,
ordered last; rows of null or equal doc_id stay separate rows; an empty table gives an
empty result; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from gzframe.llm.common import bounded_batches, free_name, partitions, slices, written
from gzframe.llm.word_hashes import word_bounds

WORD = r"[^\x20\x09-\x0D]+"
#: Slots in a run that one task makes at a time.
SLOT_RUN = 20_000
#: Rows of a run of documents at most, about.
LONG_RUN = 1_000_000


def water_fill(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets proportional to ``weights`` that sum to ``share`` of all sizes, none above ``cap`` times its size."""
    room = share * sum(sizes)
    target = [0.0] * len(sizes)
    left = [i for i, s in enumerate(sizes) if s > 0]
    while left:
        total = sum(weights[i] for i in left)
        full = [i for i in left if room * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in left:
                target[i] = room * weights[i] / total
            break
        for i in full:
            target[i] = cap * sizes[i]
        room -= sum(target[i] for i in full)
        left = [i for i in left if i not in set(full)]
    return target


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many slots of each source every shard holds; columns sum to ``slots``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for k in range(shards):
        take = int(left.sum()) // (shards - k)
        out[k] = rng.multivariate_hypergeometric(left, take, method="marginals") if take else 0
        left -= out[k]
    return out


def permuted(pos, n, *key, rounds: int = 12):
    """Column: the image of ``pos`` under a keyed permutation of 0..n-1 (swap-or-not)."""

    def step(acc, r):
        mate = F.pmod(F.pmod(F.xxhash64(*key, r), n) - acc, n)
        return F.when(F.pmod(F.xxhash64(*key, r, F.greatest(acc, mate), F.lit(1)), F.lit(2)) == 1, mate).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), pos.cast("long"), step)


def document_sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, ``keep``, size): size in words; null text: 0."""
    return docs.select("doc_id", "source", *keep, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


class Mix:
    """A mix of ``docs`` (doc_id, source, text): plan it once, then read ``blocks()``, ``slots()`` or ``documents()``.

    Columns named in ``keep`` are carried to ``blocks()`` and ``filled()`` and order rows of equal doc_id and size."""

    def __init__(self, docs: DataFrame, *, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 256, shards: int = 64, rows_per_run: int = 20_000, seed: int = 10, keep: tuple[str, ...] = ()):
        spark = self.spark = docs.sparkSession
        self.block, self.keep = block, keep
        base = written(document_sizes(docs, keep), "mix-sizes")
        totals = sorted(((r.source, r.n, r.docs) for r in base.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
        sizes = [r[1] for r in totals]
        self.targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(totals))], share, cap)
        rows, slots = [], []
        for rank, ((source, size, _), target) in enumerate(zip(totals, self.targets, strict=True)):
            quota = min(round(target), int(cap * size))
            passes, rest = divmod(quota, size) if size else (0, 0)
            per_pass, last = -(-size // block), rest - block * (-(-rest // block) - 1) if rest else 0
            slots.append(passes * per_pass + -(-rest // block))
            rows.append((rank, source, size, target, size // block, per_pass, last, slots[-1]))
        self.sources = spark.createDataFrame(rows, "rank int, source string, source_size long, target double, whole long, per_pass long, last long, n_slots long")
        self.total_slots = sum(slots)
        shards = max(1, min(shards, self.total_slots))
        counts = shard_counts(slots, shards, seed)
        first = np.cumsum(counts, axis=0) - counts
        self.shards = spark.createDataFrame([(k, s, int(first[k, s]), int(counts[k, s])) for k in range(shards) for s in range(len(slots)) if counts[k, s]], "shard int, rank int, first long, n long")
        many = sum(r[2] for r in totals)
        # short runs while they are few, then as long as a task can sort
        runs = max(1, min(-(-many // rows_per_run), max(partitions(spark), -(-many // LONG_RUN))))
        ranked = base.join(self.sources.select("rank", "source"), base.source.eqNullSafe(self.sources.source)).select("doc_id", "rank", "size", *keep)
        self.sized = written(ranked.repartitionByRange(runs, "doc_id", "size", *keep).withColumn("run", F.spark_partition_id()), "mix-runs")
        self.seed = seed

    def offsets(self) -> DataFrame:
        """(doc_id, rank, size, start): where in its source's words each document starts, by prefix sums over runs and within them."""
        runs = self.sized.groupBy("rank", "run").agg(F.sum("size").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = F.coalesce(F.sum("size").over(Window.partitionBy("rank", "run").orderBy("doc_id", "size", *self.keep).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return self.sized.withColumn("inside", inside).join(runs.select("rank", "run", before.alias("before")), ["rank", "run"]).select("doc_id", "rank", "size", *self.keep, (F.col("before") + F.col("inside")).alias("start"))

    def blocks(self) -> DataFrame:
        """One row per part of a document in a block: rank, block, doc_id, size, start, from_word and to_word in the block.

        An empty document has one row with block null."""
        b = F.lit(self.block).cast("long")
        spread = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)))
        parts = self.offsets().select("*", F.explode_outer(spread).alias("block"))
        return parts.withColumns({"from_word": F.greatest(F.col("start") - F.col("block") * b, F.lit(0)), "to_word": F.least(F.col("start") + F.col("size") - F.col("block") * b, b)})

    def slots(self) -> DataFrame:
        """One row per slot of the mix: shard, rank, slot, turn (pass over the source), block, take (words from the block's start), order within the shard."""
        s = self.sources.select("rank", "whole", "per_pass", "last", "n_slots")
        # a shard's slots of a source in runs of bounded length, dealt over tasks by their number
        starts = F.sequence(F.col("first"), F.expr("first + n - 1"), F.lit(SLOT_RUN).cast("long"))
        runs = self.shards.select("shard", "rank", "first", "n", F.explode(starts).alias("at"))
        runs = runs.repartition(max(1, min(self.total_slots // SLOT_RUN + 1, 100_000)), "shard", "rank", "at")
        x = runs.select("shard", "rank", F.explode(F.sequence("at", F.least(F.col("at") + SLOT_RUN, F.col("first") + F.col("n")) - 1)).alias("slot")).join(F.broadcast(s), "rank")
        x = x.withColumns({"turn": F.expr("slot div per_pass"), "pos": F.expr("slot % per_pass")})
        block = F.when(F.col("pos") >= F.col("whole"), F.col("whole")).otherwise(permuted(F.col("pos"), F.greatest(F.col("whole"), F.lit(1)), F.lit(self.seed), F.col("rank"), F.col("turn")))
        take = F.when((F.col("slot") == F.col("n_slots") - 1) & (F.col("last") > 0), F.col("last")).otherwise(F.lit(self.block).cast("long"))
        return x.select("shard", "rank", "slot", "turn", block.alias("block"), take.alias("take"), F.xxhash64(F.lit(self.seed), "rank", "slot").alias("order"))

    def filled(self) -> DataFrame:
        """Slots joined to the parts of documents that fill them: the mix itself, by word ranges."""
        j = self.slots().join(self.blocks(), ["rank", "block"])
        return j.withColumn("words", F.greatest(F.least("to_word", "take") - F.col("from_word"), F.lit(0))).where("words > 0")

    def documents(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken): the words the mix takes of each document, repeats counted."""
        per_block = self.slots().groupBy("rank", "block").agg(F.collect_list("take").alias("takes"))
        words = F.aggregate(F.coalesce("takes", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda acc, t: acc + F.greatest(F.least(F.col("to_word"), t) - F.col("from_word"), F.lit(0).cast("long")))
        parts = self.blocks().join(per_block, ["rank", "block"], "left").withColumn("words", F.when(F.col("block").isNull(), F.lit(0).cast("long")).otherwise(words))
        whole = parts.where("size > 0").groupBy("rank", "start", "doc_id", "size").agg(F.sum("words").alias("taken"))
        out = whole.select("rank", "doc_id", "size", "taken").union(parts.where("size = 0").select("rank", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
        return out.join(self.sources.select("rank", "source_size", "target"), "rank").select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents: for each pass over a source, the word ranges that the mix takes of each document.

    A document that a pass takes whole is a row with its text as it is; else
    each run of adjoining ranges is a row with that part of the text, from its
    first word to its last. So the words of a source sum to its target. Texts
    without words are left out. All columns of ``docs`` are kept; those beside
    ``text`` (as n_chars) stay those of the whole document."""
    bounded_batches(docs.sparkSession)
    block = F.lit(params.get("block", 256)).cast("long")
    key, turns, piece = (free_name(docs, c) for c in ("_row", "_parts", "_piece"))
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "mix-rows")
    first = F.col("block") * block + F.col("from_word") - F.col("start")
    parts = Mix(keyed.select("doc_id", "source", "text", F.col(key).alias("_row")), keep=("_row",), **{"block": 256, **params}).filled().select("_row", "turn", "size", first.alias("first"), "words")
    w = Window.partitionBy("_row", "turn").orderBy("first")
    parts = parts.withColumn("new", F.coalesce(F.col("first") != F.lag(F.col("first") + F.col("words")).over(w), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = parts.groupBy("_row", "turn", "run").agg(F.min("first").alias("first"), F.sum("words").alias("words"), F.first("size").alias("size"))
    part = F.struct("turn", "first", "words", (F.col("words") == F.col("size")).alias("whole"))
    taken = runs.groupBy(F.col("_row").alias(key)).agg(F.array_sort(F.collect_list(part)).alias(turns))

    @arrow_udf("array<string>")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        out, at = [], 0
        for some in slices(texts):
            for text, wanted in zip(some.to_pylist(), ranges.slice(at, len(some)).to_pylist(), strict=True):
                if all(r["whole"] for r in wanted):
                    out.append([None] * len(wanted))  # the text itself
                    continue
                data = text.encode("utf-8", "surrogatepass")
                start, end = word_bounds(data)
                out.append([None if r["whole"] else data[start[r["first"]] : end[r["first"] + r["words"] - 1]].decode("utf-8", "surrogatepass") for r in wanted])
            at += len(some)
        return pa.array(out, pa.list_(pa.string()))

    rows = keyed.join(taken, key).withColumn(piece, F.explode(cut(F.col("text"), F.col(turns))))
    return rows.withColumn("text", F.coalesce(piece, "text")).drop(key, turns, piece)
