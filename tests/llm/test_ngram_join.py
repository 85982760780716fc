import random
import re

from gzframe.llm.ngram_join import join_components, one_of_each
from tests.llm.fixtures import DOCS, rows

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(s), top(d)) for d, s in sets)


def near_copies(rng, groups, size):
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 40, 150]))]
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
        out.append(" ".join(base[: len(base) // 2]) + f" only{g}")
    rng.shuffle(out)
    return [(i + 100, t) for i, t in enumerate(out)]


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    docs = near_copies(rng, 40, 9) + [(i, t) for i, t, *_ in rows()]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, join_components(frame).collect())) == brute(docs)


def test_hot_group_and_frequent_shingles(spark):
    rng = random.Random(2)
    hot = "all of these texts hold this long passage that is the same in each one of them".split()
    docs = [(i, " ".join([*hot, *(f"u{i}v{k}" for k in range(rng.choice([0, 1, 1, 2, 30])))])) for i in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, join_components(frame, frequent=5).collect())) == brute(docs)


def test_null_ids_and_empty(spark):
    frame = spark.createDataFrame([*rows(), (None, "no id at all here", None, None, None, None, None)], DOCS)
    got = join_components(frame).collect()
    assert len(got) == len(rows()) + 1
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and 5 in ids
    assert join_components(frame.limit(0)).count() == 0


def test_long_lists_are_cut_into_parts_and_buckets(spark):
    rng = random.Random(4)
    docs = near_copies(rng, 12, 30)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    assert sorted(map(tuple, join_components(frame, longest=5, postings=300).collect())) == want
    assert sorted(map(tuple, join_components(frame, extra=0).collect())) == want


def test_pairs_do_not_grow_with_the_square_of_a_group(spark):
    # a group of near copies that all link: stars and what is left of them, never all pairs
    from pyspark.sql import functions as F

    from gzframe.llm import ngram_join as N

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.sparkContext.broadcast((N.np.zeros(0, N.np.uint64), N.np.zeros(0, N.np.int64)))
    signed = frame.mapInArrow(N._signatures(4, 85, 2, none), N.SIGNATURE)
    stars = N.candidates(signed, F.col("cold"), 1, none, 85, 2, True).count()
    postings = signed.agg(F.sum(F.octet_length("short")) / 8).first()[0]
    assert 399 <= stars < postings < 400 * 399 / 4
    got = join_components(frame).collect()
    assert {r.component_id for r in got} == {0}


def test_sketches_never_rule_out_similar_sets():
    import numpy as np

    from gzframe.llm.ngram_join import sketch

    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, n + 1)), dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert np.bitwise_count(sketch(a) ^ sketch(b)).sum() <= apart


def test_clashing_names_are_kept(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", 1, 1), (2, "a b c d e f", 2, 2), (None, "x", 3, 3)], "doc_id long, text string, _id long, component_id long")
    kept = one_of_each(frame)
    assert kept.columns == frame.columns and sorted(r._id for r in kept.collect()) == [1, 3]
