"""Language identification and toxicity: held-out accuracy and odd rows."""

import random
import zlib

import numpy as np

from gzframe.llm import langid, toxicity
from tests.llm.fixtures import DOCS, rows

WORDS = {
    "en": "the of and with that this house water stone green never under".split(),
    "de": "der die und nicht über schön haus wasser stein grün niemals unter".split(),
    "fr": "le la et pas sur très maison eau pierre vert jamais sous".split(),
}


def texts(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((1000 + i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(4, 40))), lang))
    return out


def test_language_accuracy_on_held_out_rows(spark):
    data = [*texts(random.Random(8), 300), *((r[0], r[1], r[2]) for r in rows()), (50, "1234 --", "en"), (None, "the house", "en")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = langid.identify(frame).collect()
    assert len(got) == len(data)
    want = {d: lang for d, _, lang in data}
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 1000 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (4, 5, 6, 50))
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.keep_identified(spark.createDataFrame(rows(), DOCS))
    assert kept.columns == DOCS.replace(",", "").split()[::2]


def test_language_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(frame).collect()] == ["und"]
    assert langid.identify(frame.limit(0)).count() == 0


def test_long_texts_score_as_in_one_piece(monkeypatch):
    rng = np.random.default_rng(0)
    model = langid.LanguageModel(["a", "b"], rng.standard_normal((1 << 15, 2)).astype(np.float32), np.zeros(2), 15)
    some = ["", "x", "ab", "some longer text " * 30, "é"]
    whole = model.logits(some)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.allclose(model.logits(some), whole, atol=1e-5)
    assert (langid.counts_of(some[3], 15).sum() == sum(len(some[3]) - k for k in range(3)))


def test_isotonic_rises_and_trees_separate():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    y = (x[:, 1] > 0.6).astype(float)
    raw = toxicity.Trees(rounds=20).fit(x, y).raw(x)
    xs, ys = toxicity.isotonic(raw, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    assert ((np.interp(raw, xs, ys) > 0.5) == (y > 0)).mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(WORDS["en"]) for _ in range(rng.randrange(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["slime", "filth", "vermin", "f1lth"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "word " * 30_000), (None, "no id"), (0, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = toxicity.score(frame, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95


def test_toxicity_without_labels(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(frame, none).collect()] == [0.0]
    assert toxicity.score(frame.limit(0), none).count() == 0


def slow_features(text, lexicon, begins):
    """The rates of a text by plain loops over its characters and words."""
    raw = text.split()
    w = [x.strip(toxicity.EDGES) for x in text.lower().split()]
    n, size, letters = max(1, len(raw)), max(1, len(text)), sum(map(len, w)) or 1
    unmask = lambda x: "".join(toxicity.DISGUISE.get(c, c) for c in x)
    exact = [x in lexicon for x in w]
    begin = [any(x[:k] in begins for k in (4, 5, 6)) for x in w]
    masked = [bool(x) and not x.isalpha() and not x.isdigit() and unmask(x) != x and unmask(x) in lexicon for x in w]
    hits = [i for i in range(len(w)) if exact[i] or begin[i] or masked[i]]
    person = [i for i, x in enumerate(w) if x in toxicity.SECOND_PERSON]
    threes = i = 0
    while i < len(text):
        if text[i] != "\n" and text[i : i + 3] == text[i] * 3:
            threes, i = threes + 1, i + 3
        else:
            i += 1
    return [
        sum(exact) / n, sum(begin) / n, sum(masked) / n, float(bool(hits)), np.log1p(len(hits)), len({w[i] for i in hits}), len(person) / n,
        sum(any(abs(i - p) <= 5 for p in person) for i in hits) / n, sum(c.isupper() for c in text) / letters, sum(x.isupper() for x in raw) / n,
        text.count("!") / n, text.count("?") / n, (size - letters - text.count(" ") - text.count("\n")) / size,
        sum(len(x) for x in w if x.isdigit()) / size, sum(bool(x) and not x.isalpha() and bool(toxicity.INSIDE.search(x)) for x in w) / n, threes / size, letters / n, np.log1p(n),
    ]


def test_features_follow_one_rule_at_any_length():
    rng = random.Random(4)
    lexicon, begins = frozenset(["slime", "filth"]), frozenset(["verm"])
    line = "Ōkami ŽIVOT ДОМ ΣΟΦΙΑ you f1lth! slimeee aaaa\n\n\n "
    texts = ["", line, *("".join(rng.choices("aAbŽД you slime f1lth vermin !?1\n", k=k)) for k in (5, 50, 700))]
    for t in texts:
        assert np.allclose(toxicity.features(t, lexicon, begins), slow_features(t, lexicon, begins)), t
    name = toxicity.FEATURES.index
    one = toxicity.features(line, lexicon, begins)
    for k in (30, 60, 5000):  # below and above 2,000 and 200,000 characters
        many = toxicity.features(line * k, lexicon, begins)
        assert all(many[name(f)] == np.float64(one[name(f)]) or abs(many[name(f)] - one[name(f)]) < 1e-12 for f in ("capitals", "repeats", "shouted", "words", "disguised"))


def test_toxicity_query_equals_scoring_each_text(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice([*WORDS["en"], *(["slime", "f1lth"] if i % 3 == 0 else [])]) for _ in range(40))) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    keep = spark.createDataFrame([(i,) for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long")
    model = toxicity.train(frame.join(keep, "doc_id"), labels.join(keep, "doc_id"))
    want = {}
    for i, t in docs:
        x = slow_features(t, model.lexicon, model.begins)
        raw = model.trees.base
        for tree in model.trees.trees:
            at = 0
            while tree[at][0] >= 0:
                at = 2 * at + (2 if x[tree[at][0]] > tree[at][1] else 1)
            raw += tree[at][2]
        want[i] = float(np.interp(raw, *model.knots))
    got = {r.doc_id: r.score for r in toxicity.score(frame, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_language_query_equals_scoring_each_text(spark):
    data = texts(random.Random(12), 150)
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    keep = [d for d in data if zlib.crc32(str(d[0]).encode()) % 3 != 1]
    model = langid.train(spark.createDataFrame(keep, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(frame).collect()}
    for i, t, _ in data:
        c = langid.counts_of(t, model.bits)
        p = langid.softmax((c @ model.table.astype(np.float64) / c.sum() + model.bias) / model.temperature)
        assert got[i].lang_pred == model.labels[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-4


def test_rare_languages_are_learned_and_repeated_ids_are_one_example(spark):
    rng = random.Random(13)
    data = [(i, " ".join(rng.choice(WORDS["en"]) for _ in range(20)), "en") for i in range(3000)] + [(5000 + i, " ".join(rng.choice(WORDS["fr"]) for _ in range(20)), "fr") for i in range(12)]
    data += [(1, data[1][1], "en")] * 500
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    s = langid.Settings(sample_rows=200)
    model = langid.train(frame, s)
    assert model.labels == ["en", "fr"]
    assert langid.train(frame.repartition(5), s).table.tobytes() == model.table.tobytes()
    assert len(langid.sampled_ids(frame.select("doc_id", "lang"), s)) <= 200
