import random
import zlib

import numpy as np
import pytest

from gzframe.llm import langid
from tests.llm.test_models import WORDS
from tests.llm.test_token_files import PATH, whole

pytest.importorskip("corpus_pipeline")


def make(tmp_path, spark):
    """Documents in three languages with copies, near copies, benchmark passages and junk; the benchmark."""
    rng = random.Random(11)
    docs = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(rng.randrange(30, 90))]
        docs.append([i, " ".join(words), lang, f"src{i % 3}", 0])
    item = " ".join(f"{rng.choice(WORDS['en'])}{rng.choice(WORDS['de'])}" for _ in range(24)) + ". " + " ".join(rng.choice(WORDS["fr"]) + "x" for _ in range(6)) + "."
    for k in (200, 201, 202):
        docs[k][1] = docs[5][1]
    docs[203][1] = docs[6][1] + " onemore"
    for k in (50, 51):
        docs[k][1] += " " + item
    docs += [[300, "12345 678 -- 99", "en", "src0", 0], [301, None, None, "src1", 0], [302, "", "de", None, 0]]
    spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, item


def test_every_stage_takes_effect(spark, tmp_path):
    import corpus_pipeline as P

    docs, item = make(tmp_path, spark)
    d = str(tmp_path)
    now = spark.read.parquet(f"{d}/documents.parquet")
    ids = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, d)
        assert out.columns == now.columns
        out.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        ids[name] = sorted(r.doc_id for r in now.select("doc_id").collect())
    assert not {300, 301, 302} & set(ids["language_id"]) and len(ids["language_id"]) >= 235
    gone = set(ids["language_id"]) - set(ids["ngram_join"])
    assert gone == {200, 201, 202, 203} & set(ids["language_id"])
    assert set(ids["ngram_join"]) - set(ids["decontamination"]) == {50, 51} & set(ids["ngram_join"])
    mixed = ids["source_mixing"]
    assert set(mixed) <= set(ids["decontamination"]) and max(map(mixed.count, mixed)) == 2
    # the last stage against encoding each text by itself
    got = sorted(map(tuple, P.STAGES[-1][1](spark, now, d).collect()), key=lambda r: r[1])
    want, start = [], 0
    # rows of one doc_id follow their ids as bytes
    for doc_id, _, t in sorted((r.doc_id, np.array(t, "<u2").tobytes(), t) for r in now.collect() for t in [[*whole(r.text), 1]]):
        want.append((doc_id, start, len(t), zlib.crc32(np.array(t, "<u4").tobytes())))
        start += len(t)
    assert got == want and PATH and langid and item


def test_empty(spark, tmp_path):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
