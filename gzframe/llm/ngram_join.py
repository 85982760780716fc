"""Operator 1: n-gram Jaccard join by T-occurrence search.

A document's set is its distinct word shingles. Documents of equal sets are
one class. A pair of classes with the wanted similarity shares at least T
shingles; in a global order with frequent shingles last, DivideSkip splits a
document's shingles into short lists (its first n - T + 1 + extra) and long
ones. The short inverted lists are merged, in buckets of shingles: each batch's
postings arrive as an ascending run, and a merging sort joins the runs. Pairs
with fewer than 1 + extra occurrences are given up, as are those whose parity
sketches differ in more places than the sets may. Long lists are never built:
whether a document stands in one is asked by binary search in its sorted set,
until the overlap of a pair is known.

Only the components of the links are wanted, so lists are merged twice. First
each list links its members to one pivot alone, the member with the fewest
rare shingles, which is nearest to the middle of a group of copies; verified
links are contracted. Then all pairs of a list that do not hang together yet
are counted. No list, pair or partner is dropped, so the result is exact.

Groups of copies never meet as pairs: exact copies are one class, found by
salted aggregation; near copies become stars; lists longer than ``longest``
are cut into parts that meet as pairs of parts; pivots with many partners are
spread over salted copies of the pivot. What is broadcast has a fixed bound:
``frequent`` shingles and a bitmap of ``BITS`` bits.

Defined cases: texts without words (null, empty) have n_shingles 0 and are
their own component; fewer words than a shingle form one shingle; texts of any
length are parsed whole; ties between pivots go to the smallest doc_id, and
similarity at the bound links; rows of one doc_id are linked as the documents
they are and share the id's component; a null doc_id gets a null component; an
empty table gives an empty result; further columns are ignored, and
``one_of_each`` keeps them whatever their names."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gzframe.llm.common import bounded_batches, connected_components, partitions, written
from gzframe.llm.word_hashes import gram_hashes, mix, word_hashes

#: Size of the bitmap that names the documents whose sets are needed.
BITS = 1 << 24
#: Partners of a pivot in one task's group.
PARTNERS = 500
#: Postings in a bucket, about.
POSTINGS = 1_000_000
#: Words of 64 bits in a document's parity sketch.
SKETCH = 4
#: Shingles that a task holds before it reports those seen several times.
HELD = 1_000_000
#: Pairs looked at together when lists are merged.
PAIRS_AT_ONCE = 200_000
#: Salts that a class of exact copies is spread over.
SALTS = 64


def shingle_sets(texts: list[str | None], n: int):
    """Yields the sorted distinct shingle hashes of each text in turn."""
    for _, words, counts in word_hashes(texts):
        grams = gram_hashes(words, n)
        at = 0
        for k in counts.tolist():
            if k >= n:
                yield np.unique(grams[at : at + k - n + 1])
            elif k:
                yield gram_hashes(words[at : at + k], k) + np.uint64(k)
            else:
                yield np.zeros(0, np.uint64)
            at += k


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of a set's members by hashed bit: two sketches differ in no more places than their sets."""
    bits = (mix(h ^ np.uint64(0xA5A5A5A5)) & np.uint64(64 * SKETCH - 1)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common members of two sorted sets: the smaller one probes the other by binary search."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(a) else 0


def _summaries(n: int):
    """Kind 0: a document's size, fingerprint and number; kind 1: a shingle seen in several documents that a task held at once."""
    names = ["kind", "doc_id", "n", "f1", "f2"]

    def often(seen):
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        some = counts > 1
        k = int(some.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(counts[some]), pa.array(values[some].view(np.int64)), pa.array(np.zeros(k, np.int64))], names)

    def run(batches):
        seen, held = [], 0
        for batch in batches:
            ids, sizes, f1, f2 = batch.column(0), [], [], []
            for h in shingle_sets(batch.column(1).to_pylist(), n):
                sizes.append(len(h))
                f1.append(int(mix(h).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                f2.append(int(mix(h * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                seen.append(h)
                held += len(h)
                if held > HELD:
                    yield often(seen)
                    seen, held = [], 0
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), ids, pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], names)
        if seen:
            yield often(seen)

    return run


SIGNATURE = "doc_id long, n long, cold long, sketch binary, short binary"


def _signatures(n: int, percent: int, extra: int, frequent):
    """Size, rare shingles, sketch and short lists (frequent shingles last) of each document."""

    def run(batches):
        hot, df = frequent.value
        for batch in batches:
            ids, keep, sizes, rare, sketches, short = batch.column(0).to_pylist(), [], [], [], [], []
            for i, h in enumerate(shingle_sets(batch.column(1).to_pylist(), n)):
                if ids[i] is None or not len(h):
                    continue
                keep.append(ids[i])
                sizes.append(len(h))
                sketches.append(sketch(h).tobytes())
                length = min(len(h), len(h) - -(-percent * len(h) // 100) + 1 + extra)
                at = np.searchsorted(hot, h)
                at[at == len(hot)] = 0
                is_hot = hot[at] == h if len(hot) else np.zeros(len(h), bool)
                cold = h[~is_hot]
                rare.append(len(cold))
                h = cold[:length] if len(cold) >= length else np.concatenate([cold, h[is_hot][np.argsort(df[at[is_hot]], kind="stable")]])[:length]
                short.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rare, pa.int64()), pa.array(sketches, pa.binary()), pa.array(short, pa.binary())], ["doc_id", "n", "cold", "sketch", "short"])

    return run


def _in_parts(h: np.ndarray, who: np.ndarray, salt: np.ndarray, heavy, star: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``h``, list) of each posting: the lists of ``heavy`` shingles are cut into parts by ``salt``.

    A star meets within a part; else each two parts of a list meet in a list of their own."""
    values, parts = heavy
    at = np.searchsorted(values, h)
    at[at == len(values)] = 0
    cut = np.flatnonzero(values[at] == h) if len(values) else np.zeros(0, np.int64)
    lists = h.copy()
    if not len(cut):
        return np.arange(len(h)), lists
    k = parts[at[cut]]
    own = (salt[who[cut]] % k.astype(np.uint64)).astype(np.int64)
    if star:
        lists[cut] = mix(h[cut] + mix(own.astype(np.uint64) + np.uint64(1)))
        return np.arange(len(h)), lists
    again = np.repeat(cut, k - 1)
    mine = np.repeat(own, k - 1)
    other = np.arange(len(again)) - np.repeat(np.cumsum(k - 1) - (k - 1), k - 1)
    other += other >= mine
    pair = np.minimum(mine, other) * (1 << 32) + np.maximum(mine, other)
    rest = np.setdiff1d(np.arange(len(h)), cut, assume_unique=True)
    return np.concatenate([rest, again]), np.concatenate([h[rest], mix(h[again] + mix(pair.astype(np.uint64) + np.uint64(1)))])


DEALT = ["docs", "sizes", "labels", "sketches", "members", "lists", "places"]


def _deal(buckets: int, heavy, star: bool):
    """Cut documents' short lists (doc_id, n, label, sketch, short) into buckets: one row per batch and bucket, its postings ascending by list."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, sizes, labels = (batch.column(i).to_numpy() for i in range(3))
            sketches = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, SKETCH)
            short = [np.frombuffer(b, np.uint64) for b in batch.column(4).to_pylist()]
            who = np.repeat(np.arange(len(docs)), [len(x) for x in short])
            place = np.concatenate([np.arange(len(x), dtype=np.uint32) for x in short])
            at, lists = _in_parts(np.concatenate(short), who, mix(docs.astype(np.uint64)), heavy.value, star)
            who, place = who[at], place[at]
            bucket = (mix(lists) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((lists, bucket))
            lists, who, bucket, place = lists[order], who[order], bucket[order], place[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            out = [[] for _ in range(1 + len(DEALT))]
            for b in np.flatnonzero(np.diff(edge)):
                part = slice(edge[b], edge[b + 1])
                own, back = np.unique(who[part], return_inverse=True)
                row = (docs[own], sizes[own].astype(np.int32), labels[own], sketches[own], back.astype(np.uint32), lists[part], place[part])
                out[0].append(int(b))
                for column, value in zip(out[1:], row, strict=True):
                    column.append(value.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["bucket", *DEALT])

    return run


def _pairs_of(star: bool, lists: np.ndarray, labels: np.ndarray):
    """Yields (left, right) places of pairs in postings sorted by list and label, ``PAIRS_AT_ONCE`` at a time, or one posting's.

    A star pairs a list's first posting with each other one; else postings of one list meet if their labels differ."""
    new_list = np.concatenate([[True], lists[1:] != lists[:-1]])
    if star:
        first = np.maximum.accumulate(np.where(new_list, np.arange(len(lists)), 0))
        right = np.flatnonzero(~new_list)
        for i in range(0, len(right), PAIRS_AT_ONCE):
            yield first[right[i : i + PAIRS_AT_ONCE]], right[i : i + PAIRS_AT_ONCE]
        return
    new_label = new_list | np.concatenate([[True], labels[1:] != labels[:-1]])
    list_end = np.append(np.flatnonzero(new_list)[1:], len(lists))[np.cumsum(new_list) - 1]
    label_end = np.append(np.flatnonzero(new_label)[1:], len(lists))[np.cumsum(new_label) - 1]
    partners = list_end - label_end
    some = np.flatnonzero(partners)
    ahead = np.cumsum(partners[some])
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(ahead, (ahead[i - 1] if i else 0) + PAIRS_AT_ONCE, side="right")))
        k = partners[some[i:j]]
        left = np.repeat(some[i:j], k)
        yield left, label_end[left] + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        i = j


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The bytes of a binary column's values one after another, as an array of ``kind``."""
    parts = [np.zeros(0, kind)]
    for chunk in column.chunks:
        if len(chunk):
            wide = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
            ends = np.frombuffer(chunk.buffers()[1], wide)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
    return np.concatenate(parts)


def _merge(percent: int, extra: int, star: bool):
    """Merge a bucket's inverted lists: (a, b, na, nb, common) of the pairs to look at.

    A common shingle counts where it stands early enough in both orders for a
    pair of these sizes: the first 1 + extra common ones of a similar pair do."""

    def run(table: pa.Table) -> pa.Table:
        docs, sizes, labels = joined(table["docs"], np.int64), joined(table["sizes"], np.int32).astype(np.int64), joined(table["labels"], np.int64)
        sketches = joined(table["sketches"], np.uint64).reshape(-1, SKETCH)
        # postings name their document by its place in their row
        rows = pc.binary_length(table["docs"]).to_numpy() // 8
        postings = pc.binary_length(table["members"]).to_numpy() // 4
        who = joined(table["members"], np.uint32).astype(np.int32)
        who += np.repeat((np.cumsum(rows) - rows).astype(np.int32), postings)
        lists, place = joined(table["lists"], np.uint64), joined(table["places"], np.uint32)
        del table
        # members of a list by label, then number; the stable sort by list merges the ascending runs
        rank = np.empty(len(docs), np.int32)
        rank[np.lexsort((docs, labels))] = np.arange(len(docs))
        order = np.argsort(rank[who], kind="stable")
        order = order[np.argsort(lists[order], kind="stable")]
        lists, who, place = lists[order], who[order], place[order].astype(np.int32)
        del order, rank
        keys, counts = [], []
        for left, right in _pairs_of(star, lists, labels[who]):
            a, b = who[left], who[right]
            both = sizes[a] + sizes[b]
            need = -(-percent * both // (100 + percent))
            fits = (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])) & (place[left] < sizes[a] - need + 1 + extra) & (place[right] < sizes[b] - need + 1 + extra) & (docs[a] != docs[b])
            a, b, room = a[fits], b[fits], (both - 2 * need)[fits]
            close = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64) <= room
            a, b = a[close], b[close]
            key, common = np.unique(np.minimum(a, b).astype(np.int64) * len(docs) + np.maximum(a, b), return_counts=True)
            keys.append(key)
            counts.append(common)
        key, back = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
        common = np.bincount(back, np.concatenate([np.zeros(0, np.int64), *counts]), len(key)).astype(np.int64)
        a, b = key // max(len(docs), 1), key % max(len(docs), 1)
        swap = docs[a] > docs[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.table({"a": docs[a], "b": docs[b], "na": sizes[a], "nb": sizes[b], "common": common})

    return run


PAIRS = "a long, b long, na long, nb long, common long"


def _bitmap(nodes: DataFrame):
    """A fixed-size bitmap of hashed ids in the one column of ``nodes``."""
    spark = nodes.sparkSession
    bit = F.pmod(F.xxhash64(nodes.columns[0]), F.lit(BITS)).cast("int")
    runs = nodes.select(bit.alias("bit")).distinct().groupBy((F.col("bit") / 4096).cast("int").alias("run")).agg(F.collect_list((F.col("bit") % 4096).cast("short")).alias("bits"))
    bits = np.zeros(BITS, bool)
    for r in runs.toLocalIterator():
        bits[r.run * 4096 + np.array(r.bits, np.int64)] = True
    return spark.sparkContext.broadcast(np.packbits(bits))


def _needed_sets(n: int, bitmap):
    def run(batches):
        for batch in batches:
            ids, slots = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            need = (bitmap.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1
            keep = [i for i in np.flatnonzero(need) if ids[i] is not None]
            if keep:
                part = batch.column(1).take(pa.array(keep)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([h.tobytes() for h in shingle_sets(part, n)], pa.binary())], ["doc_id", "set"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (small + large - both)


def _verify(percent: int):
    def run(batches):
        at, pivots = None, []
        for batch in batches:
            a, b = [], []
            for p, salt, d, s in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (p, salt) != at:
                    at, pivots = (p, salt), []
                own = np.frombuffer(s.as_buffer(), np.uint64)
                if d == p:
                    pivots.append(own)
                elif any(similar(own, x, percent) for x in pivots):
                    a.append(p)
                    b.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` with the wanted similarity; the smaller id's set goes to groups of its partners."""
    pairs = written(pairs.select("a", "b").distinct(), "join-pairs")
    nodes = pairs.select("a").union(pairs.select("b"))
    bitmap = _bitmap(nodes)
    slots = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).cast("int").alias("slot"))
    sets = slots.mapInArrow(_needed_sets(n, bitmap), "doc_id long, set binary").withColumnRenamed("doc_id", "d")
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    salted = pairs.join(degree, "a").select("a", F.col("b").alias("d"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    own = degree.select("a", F.col("a").alias("d"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = salted.union(own).join(sets, "d").select("a", "salt", "d", "set")
    rows = rows.repartition(partitions(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("d") != F.col("a"))
    return rows.mapInArrow(_verify(percent), "a long, b long")


def candidates(signed: DataFrame, label, buckets: int, heavy, percent: int, extra: int, star: bool) -> DataFrame:
    """(a, b, na, nb, common) from the merged lists of ``signed``; ``label`` orders a star or names what hangs together."""
    dealt = signed.select("doc_id", "n", label.cast("long").alias("label"), "sketch", "short").mapInArrow(_deal(buckets, heavy, star), ", ".join(["bucket int", *(f"{c} binary" for c in DEALT)]))
    return dealt.groupBy("bucket").applyInArrow(_merge(percent, extra, star), PAIRS)


def frequent_shingles(seen: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document frequencies) of the most frequent shingles of ``seen`` (f1, n), at most ``bound``, by hash."""
    hot = written(seen.groupBy("f1").agg(F.sum("n").alias("df")).where("df >= 8"), "join-frequent")
    # the least document frequency of which the table holds all shingles within its bound, from a small histogram
    step = F.floor(F.log2("df") * 16)
    room, least = bound, None
    for at, size in sorted(((r.step, r.n) for r in hot.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True):
        room -= size
        if room < 0:
            break
        least = at
    found = (hot.where(step >= least) if least is not None else hot.limit(0)).toArrow()
    values, df = found["f1"].to_numpy().view(np.uint64), found["df"].to_numpy()
    order = np.argsort(values)
    return values[order], df[order]


def join_components(docs: DataFrame, *, n: int = 4, percent: int = 85, extra: int = 2, frequent: int = 1_000_000, longest: int = 500_000, postings: int = POSTINGS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    spark = bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = written(docs.mapInArrow(_summaries(n), "kind int, doc_id long, n long, f1 long, f2 long"), "join-summaries")
    each = found.where("kind = 0").drop("kind")
    # exact copies: one class per set, named by its smallest id; salted, as a third of all rows may be one class
    keys = ["n", "f1", "f2"]
    salted = each.where("n > 0 and doc_id is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    low = salted.groupBy(*keys, "salt").agg(F.min("doc_id").alias("low"))
    classes = low.groupBy(*keys).agg(F.min("low").alias("rep"))
    same = salted.join(low.join(classes, keys).drop("low"), [*keys, "salt"]).select("doc_id", "rep")
    values, df = frequent_shingles(found.where("kind = 1"), frequent)
    sent = spark.sparkContext.broadcast((values, df))
    parts = -(-df // longest)
    heavy = spark.sparkContext.broadcast((values[parts > 1], parts[parts > 1]))
    signed = docs.mapInArrow(_signatures(n, percent, extra, sent), SIGNATURE)
    signed = written(signed.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id"), "join-signatures")
    total = signed.agg(F.sum(F.octet_length("short")) / 8).first()[0] or 0
    buckets = max(1, math.ceil(total / postings))

    stars = candidates(signed, F.col("cold"), buckets, heavy, percent, extra, True)
    links = written(verified(docs, stars, n, percent), "join-links")
    first = written(connected_components(links, "join-components"), "join-first")

    labelled = signed.join(first, F.col("doc_id") == F.col("node"), "left")
    pairs = candidates(labelled, F.coalesce("component", "doc_id"), buckets, heavy, percent, extra, False)
    summed = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    need = F.least(F.lit(1 + extra), F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent)))
    links = links.union(written(verified(docs, summed.where(F.col("common") >= need), n, percent), "join-links"))

    edges = links.union(same.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    parts_ = connected_components(edges, "join-components")
    return each.join(parts_, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each component, all columns kept; rows of one id stay or go together."""
    parts = join_components(docs, **params)
    kept = parts.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    kept = kept.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select("doc_id")
    rows = docs.alias("rows")
    return rows.join(kept.alias("kept"), F.col("rows.doc_id").eqNullSafe(F.col("kept.doc_id")), "left_semi")
