import random

from gzframe.llm.decontamination import Index, find_leaks, question_and_answer, without_leaks, words_of
from tests.llm.fixtures import DOCS, rows

ITEMS = [
    (1, "What is the capital city of the old northern kingdom by the sea? It is the white harbour town of Eriksund."),
    (2, "Name three rivers that meet below the castle hill. Alba, Merra and the small river Tonn do meet there."),
    (3, "one two three"),
    (4, None),
    (5, ""),
]


def filler(rng, n):
    return " ".join(f"word{rng.randrange(3000)}" for _ in range(n))


def test_planted_passages_are_found(spark):
    rng = random.Random(7)
    docs = [(i, filler(rng, 300)) for i in range(20)]
    docs += [(100, f"{filler(rng, 700)} {ITEMS[0][1]} {filler(rng, 50)}"), (101, ITEMS[1][1].upper()), (102, filler(rng, 90) + " " + ITEMS[1][1].replace("castle", "garden"))]
    docs += [(103, "What is the capital city of the old northern kingdom by the sea? Nobody knows."), (104, "x one two three y"), (105, "one three two"), (106, None), (107, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(frame, bench, ["doc_id"]).collect()}
    assert got == {(100, 1), (101, 2), (102, 2), (104, 3)}
    blocks = {(r.doc_id, r.item_id) for r in find_leaks(frame, bench, ["doc_id"], index_items=1).collect()}
    assert blocks == got
    for items in (4096, 1):
        assert sorted(r.doc_id for r in without_leaks(frame, bench, index_items=items).collect()) == sorted(d for d, _ in docs if d not in (100, 101, 102, 104))


def test_question_and_answer_with_words_between(spark):
    question, answer = "Which of the five old bridges over the river was built before all others?", "The stone one."
    texts = [f"{question} {answer}", f"{question} Answer: {answer}", f"{question} a) wooden b) iron c) {answer}", f"{question} The wooden one.", f"stone {question} one the"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, f"{question} {answer}")], "item_id long, text string")
    assert sorted(r.doc_id for r in find_leaks(frame, bench, ["doc_id"]).collect()) == [0, 1, 2]


def covered(words, part, item):
    """Share of an item's part that five-word shingles of the item, found anywhere in ``words``, cover."""
    grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    hit = [False] * len(item)
    for i in range(len(item) - 4):
        if tuple(item[i : i + 5]) in grams:
            hit[i : i + 5] = [True] * 5
    return sum(hit[part]) / max(1, len(hit[part]))


def test_leaks_equal_comparing_every_pair(spark):
    rng = random.Random(21)
    items = [(i, f"{filler(rng, rng.randrange(8, 20))}? {filler(rng, rng.randrange(6, 12))}.") for i in range(40)]
    docs = []
    for d in range(120):
        parts = [filler(rng, rng.randrange(5, 200))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "other"
            parts += [" ".join(w), filler(rng, rng.randrange(50))]
        docs.append((d, " ".join(parts)))
    want = set()
    for d, text in docs:
        for i, item in items:
            q = len(words_of(question_and_answer(item)[0]))
            w, own = words_of(text), words_of(item)
            if covered(w, slice(0, q), own) >= 0.8 and covered(w, slice(q, None), own) >= 0.8:
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()}
    assert got == want and len(want) > 20


def test_clashing_names_are_kept(spark):
    frame = spark.createDataFrame([(1, ITEMS[0][1], 5, 6), (2, "clean text", 7, 8)], "doc_id long, text string, _row long, _leaks long")
    kept = without_leaks(frame, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(2, "clean text", 7, 8)] and kept.columns == frame.columns


def test_search_equals_scoring_every_item():
    rng = random.Random(5)
    items = [(i, *question_and_answer(filler(rng, 12) + ". " + filler(rng, 5) + ".")) for i in range(60)]
    index = Index(items, 0.3)
    import numpy as np

    for _ in range(50):
        words = words_of(filler(rng, 20) + " " + rng.choice(items)[1][:40])
        terms = np.unique([index.vocabulary[w] for w in words if w in index.vocabulary])
        want = {}
        for t in terms:
            for p in range(index.start[t], index.start[t + 1]):
                want[int(index.items[p])] = want.get(int(index.items[p]), 0) + index.impacts[p]
        want = {i for i, s in want.items() if s >= index.threshold[i]}
        assert {i for i, _ in index.search(terms)} == want


def test_odd_and_empty(spark):
    frame = spark.createDataFrame(rows(), DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(frame, bench, ["doc_id"]).count() == 0
    kept = without_leaks(frame, bench)
    assert kept.columns == frame.columns and kept.count() == len(rows())
    assert find_leaks(frame.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string"), ["doc_id"]).count() == 0
