import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gzframe.llm.katz import GT, HOT, factors, pieces, score, train
from tests.llm.fixtures import DOCS, rows

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP)), None]


def brute(texts, order):
    """Probability of a token after a history, by the plain recursion."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        w = ["<s>"] * (order - 1) + tokens(t)
        for i in range(order - 1, len(w)):
            for k in range(1, order + 1):
                counts[k][tuple(w[i - k + 1 : i + 1])] += 1
    total = sum(counts[1].values())
    d = [None, *(factors(Counter(c.values())) for c in counts[1:])]
    follow = [None, None, *(defaultdict(list) for _ in range(order - 1))]
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            follow[k][g[:-1]].append((g[-1], c))
    unseen = sum((1 - d[1][c]) * c for c in counts[1].values() if c <= GT) / total

    def p(history, w):
        if not history:
            c = counts[1][w,]
            return c * d[1][min(c, GT + 1)] / total if c else unseen
        k = len(history) + 1
        after = follow[k].get(history)
        if not after:
            return p(history[1:], w)
        n = sum(c for _, c in after)
        c = counts[k][(*history, w)]
        if c:
            return c * d[k][min(c, GT + 1)] / n
        left = 1 - sum(x * d[k][min(x, GT + 1)] for _, x in after) / n
        return left / (1 - sum(p(history[1:], v) for v, _ in after)) * p(history[1:], w)

    return p, counts[1], total, unseen


def data():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    docs = [(100 + i, " ".join(rng.choice(words[: rng.choice([5, 20, 60])]) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    return [*docs, *((r[0], r[1]) for r in rows() if r[0] != 7), (7, "UNSEEN words here w1 w2"), (7, "UNSEEN words here w1 w2")]


@pytest.mark.parametrize("order,hot_from", [(1, HOT), (2, HOT), (3, HOT), (2, 4), (3, 4)])
def test_scores_equal_the_plain_recursion(spark, tmp_path, order, hot_from):
    docs = data()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = score(frame, order=order, folder=str(tmp_path / "k"), hot_from=hot_from).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    p, uni, total, _ = brute([t for d, t in docs if not held(d)], order)
    types = len(uni)
    want = []
    for d, t in docs:
        w = ["<s>"] * (order - 1) + tokens(t)
        s = sum(math.log10(p(tuple(w[i - order + 1 : i]), w[i])) for i in range(order - 1, len(w)))
        c = [uni[x,] for x in tokens(t)]
        want.append((d, held(d), len(c), sum(x > 0 for x in c), total, sum(math.log10((x + 0.5) / (total + 0.5 * (types + 1))) for x in c), s))
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_probabilities_sum_to_one():
    p, uni, _, unseen = brute([t for _, t in data()], 2)
    for h in [("w1",), ("w59",), ("nowhere",), ("<s>",)]:
        assert abs(sum(p(h, w) for (w,) in uni) + p(h, "something new") - 1) < 1e-9
    assert 0 < unseen < 1


def test_odd_and_empty(spark, tmp_path):
    frame = spark.createDataFrame(rows(), DOCS)
    assert len(score(frame, folder=str(tmp_path / "a")).collect()) == len(rows())
    assert score(frame.limit(0), folder=str(tmp_path / "b")).count() == 0
    model = train(frame.limit(0), 2, str(tmp_path / "c"))
    assert model.levels[0].total == 0
    with pytest.raises(ValueError):
        train(frame, 4)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_histories_without_discounts_keep_mass_for_the_unseen(spark, tmp_path, order):
    # every count is above GT, so no n-gram of any order is discounted
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    ids = [i for i in range(100) if not held(i)][: 2 * GT]
    out = next(i for i in range(100) if held(i))
    docs = [(i, "a b c") for i in ids] + [(out, "b a new c c")]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(docs, "doc_id long, text string"), order=order, folder=str(tmp_path / "k")).collect()}
    assert math.isfinite(got[out]) and got[out] < got[ids[0]] < 0
    model = train(spark.createDataFrame([(t,) for d, t in docs if d != out], "text string"), order, str(tmp_path / "m"))
    for before in ("a", "a b", "c", "zzz"):
        p = []
        for w in ("a", "b", "c", "new", None):
            _, t, n = next(pieces([" ".join([before, *([w] if w else [])])]))
            p.append(model.probabilities(t, n)[1][len(before.split())])
        assert min(p) > 0 and abs(sum(p) - 1) < 1e-9


def test_words_that_share_forty_bits_are_told_apart(spark, tmp_path):
    model = train(spark.createDataFrame([("a b",)] * 3, "text string"), 2, str(tmp_path / "m"))
    _, known, n = next(pieces(["a b"]))
    other = known.copy()
    other[:2] ^= np.uint64(1 << 63)
    assert model.probabilities(known, n)[0].tolist() == [3, 3, 3]
    assert model.probabilities(other, n)[0].tolist() == [0, 0, 3]
