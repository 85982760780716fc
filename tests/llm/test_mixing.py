import random
import re

import pytest

from gzframe.llm.mixing import Mix, mix_documents, shard_counts, water_fill
from tests.llm.fixtures import DOCS, rows


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_water_fill_reshares_the_excess():
    assert water_fill([10, 100, 100], [3, 1, 2], 1.5, 2.0) == pytest.approx([20, 295 / 3, 590 / 3])
    assert water_fill([], [], 1.5, 2.0) == []
    assert sum(water_fill([5, 0, 7], [3, 1, 2], 1.5, 2.0)) == pytest.approx(18)


def test_shard_counts_keep_the_quotas():
    got = shard_counts([100, 0, 57], 7, 3)
    assert got.sum(axis=0).tolist() == [100, 0, 57]
    assert (got == shard_counts([100, 0, 57], 7, 3)).all()


def test_documents_meet_the_targets(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    mix = Mix(docs, block=8)
    got = mix.documents().collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], size(r[1])) for r in rows())
    by, source = {}, {r[0]: r[3] for r in rows()}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((source[r.doc_id], r.target), []).append(r.taken)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 1
    again = Mix(docs, block=8).documents().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mix.filled().groupBy().sum("words").first()[0] == sum(r.taken for r in got)


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    from gzframe.llm.mixing import permuted

    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(5))).collect()]
        assert sorted(got) == list(range(n))


def test_empty_and_copies(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    assert Mix(docs.limit(0)).documents().count() == 0
    assert mix_documents(docs.limit(0)).count() == 0
    copies = mix_documents(docs, block=8)
    assert copies.columns == docs.columns
    assert copies.count() > 0


def test_mixed_words_of_long_documents_meet_the_targets(spark):
    # documents over many blocks; ratios below one half and between whole numbers
    docs = [(i, " \n".join(f"{s}{i}x{j}" for j in range(n)) + "\t", s) for s, ids, n in (("a", range(4), 500), ("b", range(10, 40), 700), ("c", range(50, 53), 9)) for i in ids]
    docs += [(60, None, "a"), (61, "  ", "b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    params = {"block": 64, "weights": (2, 5, 1), "share": 0.37}
    target = {r.source: r.target for r in Mix(frame, **params).sources.collect()}
    got = mix_documents(frame, **params).collect()
    texts = {d: t for d, t, _ in docs}
    for s, wanted in target.items():
        assert abs(sum(size(r.text) for r in got if r.source == s) - wanted) <= 1
    assert all(r.text in texts[r.doc_id] for r in got)
    assert any(r.text != texts[r.doc_id] for r in got)
    twice = mix_documents(frame, **{**params, "share": 2.0}).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in twice) == sorted(d for d in docs if size(d[1]) for _ in range(2))


def test_null_ids_are_mixed(spark):
    docs = [(None if i % 3 else i, f"w{i} " * 20, "a" if i % 2 else None) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix = Mix(frame, block=8)
    got = mix_documents(frame, block=8).collect()
    for r in mix.sources.collect():
        assert abs(sum(size(x.text) for x in got if x.source == r.source) - r.target) <= 1
    assert sum(size(r.text) for r in got if r.doc_id is None) == mix.documents().where("doc_id is null").groupBy().sum("taken").first()[0] > 0


def test_taken_words_equal_laying_out_the_blocks(spark):
    rng = random.Random(10)
    docs = [(i, " ".join("w" for _ in range(rng.randrange(60))) if i % 11 else None, rng.choice(["a", "b", None])) for i in range(90)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix = Mix(frame, block=16)
    rank = {r.source: r["rank"] for r in mix.sources.collect()}
    slots = mix.slots().collect()
    assert len({(r["rank"], r.slot) for r in slots}) == len(slots) == mix.total_slots
    taken = {d: 0 for d, _, _ in docs}
    for source, k in rank.items():
        # the words of a source one after another, each with its document
        line = [d for d, t, s in sorted(docs) if s == source for _ in range(size(t))]
        for r in (r for r in slots if r["rank"] == k):
            for d in line[r.block * 16 : r.block * 16 + 16][: r["take"]]:
                taken[d] += 1
    assert {r.doc_id: r.taken for r in mix.documents().collect()} == taken


def test_clashing_names_are_kept(spark):
    frame = spark.createDataFrame([(i, "a b c " * 9, "s", i, i) for i in range(20)], "doc_id long, text string, source string, _row long, _parts long")
    got = mix_documents(frame, block=8)
    assert got.columns == frame.columns and all(r._row == r._parts == r.doc_id for r in got.collect())


def test_slots_come_in_runs(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), DOCS)
    whole = sorted(map(tuple, Mix(docs, block=8).slots().collect()))
    monkeypatch.setattr("gzframe.llm.mixing.SLOT_RUN", 7)
    assert sorted(map(tuple, Mix(docs, block=8).slots().collect())) == whole
