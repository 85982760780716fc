import random
import re

import pytest

from gzframe.llm.licenses import BAND, BASE, COVER, TEMPLATES, VOTES, K, scan
from tests.llm.fixtures import DOCS, rows

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    "Released under the MIT License. Really: under the (MIT) license!",
    "Apache License, Version 2.0 and CC BY-NC 4.0 and cc by nc",
    "CC BY-NC CC BY-NC under the mit licenses",
    "This work is licensed under the GNU General Public License, version 3.",
    "this program is free software: you can redistribute it and/or modify it freely under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "été under the mit license é",
]


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    hits = [(i, label) for phrase, label in BASE.items() for k in [phrase.split()] for i in range(len(w)) if w[i : i + len(k)] == k]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_equals_brute_force_and_labels_are_added(spark):
    data = [*rows(), *((100 + i, t, None, None, None, None, None) for i, t in enumerate(TEXTS))]
    got = scan(spark.createDataFrame(data, DOCS)).collect()
    want = sorted((r[0], *base(r[1])) for r in data)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=lambda r: r[0]) == want
    labels = {r.doc_id: r.labels for r in got}
    assert labels[103] == "gpl-3" and labels[104] == "gpl-2" and labels[100] == "mit" and labels[101] == "apache-2,cc-by-nc"
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)
    assert {r.doc_id: r.score for r in got}[4] == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def covers(text, phrase):
    """The greatest cover of ``phrase`` that a place in ``text`` has, by plain counting of the words it shares there in order."""
    w, t = words(text), phrase.split()
    grams = {}
    for i in range(len(w) - K + 1):
        grams.setdefault(tuple(w[i : i + K]), []).append(i)
    hits = [(i - j, j) for j in range(len(t) - K + 1) for i in grams.get(tuple(t[j : j + K]), [])]
    best = 0
    for at in {d for d, _ in hits}:
        there = {j for d, j in hits if at <= d <= at + BAND}
        if len(there) >= VOTES * (len(t) - K + 1):
            best = max(best, len({j + k for j in there for k in range(K)}) / len(t))
    return best


MPL = "licensed under the mozilla public license version 2 0"


def test_spans_are_verified(spark):
    rng = random.Random(3)
    texts = [
        *[" ".join(["licensed under the mozilla"] * n) for n in (1, 4, 50)],
        "public license version 2 0 licensed under the mozilla",
        "licensed under the mozilla a b c d e f g h i public license version 2 0",
        "code licensed under the Mozilla Foundation public license, version 2.0",
        "mozilla public license version 2 0 " * 3,
        MPL,
        "x " * 3000 + MPL + " y" * 3000,
    ]
    phrases = list(TEMPLATES)
    for _ in range(60):
        t = rng.choice(phrases).split()
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = rng.choice([[], ["put", "in"], t[:4], ["z"]])
        texts.append(" ".join(t * rng.choice([1, 1, 2])))
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        found = {p: covers(text, p) for p in phrases}
        exact = any(f" {b} " in f" {' '.join(words(text))} " for b in BASE)
        good = [c for c in found.values() if c >= COVER]
        assert got[i].score == pytest.approx(1.0 if exact else max(good, default=0.0)), text
        assert set(got[i].labels.split(",")) - {""} <= {TEMPLATES[p] for p, c in found.items() if c >= COVER} | set(BASE.values())
    assert [got[i].labels for i in range(9)] == ["", "", "", "", "", "mpl-2", "", "mpl-2", "mpl-2"]


def test_empty(spark):
    assert scan(spark.createDataFrame([], DOCS)).count() == 0
