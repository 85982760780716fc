import json
import random
import zlib

import numpy as np
import pytest

from gzframe.llm.token_files import WordEncoder, encoder, read_token_files, write_token_files
from tests.llm.fixtures import DOCS, rows

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def whole(text):
    return tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    texts = [r[1] for r in rows()] + ["Word. WORD!! wörd, été?! x2. 12% a.b. (c) \"q\"|| don't. it's, ½. x² ٣٤. <|endoftext|>. Ǆ. ẞß! e\u0301. é\u0301, \u0301. ﬁ. a\u200b. b\ufe0f!", "a\x1cb \x85c d <|STARTOFTEXT|>x<|startoftext|>", " ́a b́ I'll 5's", "İstanbul ΣΑΣ ﬁ"]
    enc = WordEncoder(PATH, "<u2")
    for t, got in zip(texts, enc(texts, b""), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == whole(t)
    monkeypatch.setattr("gzframe.llm.token_files.CACHE_WORDS", 5)
    small = WordEncoder(PATH, "<u2")
    assert small(texts, b"") == enc(texts, b"")


#: Letters whose lower case is longer or ends in a mark, marks that compose, digits of other scripts, white space and tails.
LETTERS = [*"aZéÉİıßẞΣςσǅﬁKÅΩàб٣½²Ⅳ", "\u0301", "\u0307", "\u0345", "\u200b", "\ufe0f", *".,;:!?)]}%#*$&\"|'<", " ", "\t", "\u00a0", "\u0085", "\x1c", "'s", "'ll", "<|endoftext|>"]


def test_fuzzed_texts():
    rng = random.Random(5)
    texts = ["DENİZLİ.", "TÜRKİYE, İZMİR BELEDİYESİ!", *("".join(rng.choices(LETTERS, k=rng.randrange(1, 12))) for _ in range(20_000))]
    enc, lib = WordEncoder(PATH, "<u2"), tokenizers.Tokenizer.from_file(PATH)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, got, ids in zip(texts, enc(texts, b""), want, strict=True) if np.frombuffer(got, "<u2").tolist() != ids]
    assert not wrong


def test_other_tokenizers_take_whole_texts(tmp_path):
    kind = json.load(open(PATH))
    assert isinstance(encoder(PATH, "<u2"), WordEncoder)
    kind["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    other = str(tmp_path / "other.json")
    json.dump(kind, open(other, "w"))
    enc = encoder(other, "<u2")
    assert not isinstance(enc, WordEncoder)
    text = "two words. İZMİR."
    assert np.frombuffer(enc([text], b"")[0], "<u2").tolist() == tokenizers.Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids
    assert enc([None], b"\1\0") == [b"\1\0"]


def test_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([*rows(), (None, "no id", None, None, None, None, None)], DOCS)
    folder, manifest = write_token_files(docs, PATH, str(tmp_path / "t"), shards=3)
    got = sorted(map(tuple, read_token_files(spark, folder).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in [*rows(), (None, "no id")]), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole(text), 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert sum(m["n_docs"] for m in manifest) == len(want)


def test_empty(spark, tmp_path):
    folder, manifest = write_token_files(spark.createDataFrame([], DOCS), PATH, str(tmp_path / "e"))
    assert manifest == [] and read_token_files(spark, folder).count() == 0
