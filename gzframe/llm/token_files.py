"""Operator 5: token ids as flat binary files.

A shard is three files: ``<shard>.bin`` (little-endian unsigned 16- or 32-bit
ids), ``<shard>.idx`` (64-bit offsets, one more than documents, in ids from
the shard's start) and ``<shard>.doc`` (64-bit document ids; a null id is the
smallest 64-bit integer). Shards follow ascending doc_id; a shard's base is
the prefix sum of the id counts before it. Files are written under a
temporary name and renamed, so a repeated task leaves the same files.

Where a tokenizer's normaliser and pre-tokenizer are exactly those of
``BY_WORD``, white space always ends a token and nothing joins across it: texts
are then encoded word by word through a bounded cache of encoded words, and a
word of ASCII letters and digits apart from the marks after it. All other words
take the library's whole path, as do the whole texts of any other tokenizer.
Tests compare with whole-text encoding.

Defined cases: null or empty text has the end id alone; texts of any length are
encoded whole; rows of equal doc_id are all written, in order of their ids as
bytes; an empty table writes no file and gives no row; further columns are
ignored."""

from __future__ import annotations

import json
import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gzframe.llm.common import bounded_batches, fresh_path, local_path, partitions, slices

NULL_ID = -(2**63)
#: Encoded words kept by a worker; the cache starts anew when it is full.
CACHE_WORDS = 700_000
#: Words longer than this are encoded but not kept.
CACHE_CHARS = 64
#: Marks that a word can end with and that are always tokens of their own kind (no apostrophe, no special token's bracket).
TAIL = ".,;:!?)]}%#*$&\"|"


#: The end of the Latin, Greek and Cyrillic blocks, and the one letter whose lower case is a letter and a mark.
PLAIN_BELOW, MARKED = "\u0530", "\u0130"

# The normaliser and pre-tokenizer for which words can be encoded apart.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


class Encoder:
    """Ids of whole texts, as bytes of ``dtype``, by the library alone."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.code = Tokenizer.from_file(path), {"<u2": "H", "<u4": "I"}[dtype]
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encoded(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 20_000):
            out += [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]
        return out

    def __call__(self, texts: list[str | None], end: bytes) -> list[bytes]:
        return [ids + end for ids in self.encoded([t or "" for t in texts])]


class WordEncoder(Encoder):
    """The same through a cache of words, for tokenizers that are as ``BY_WORD`` says."""

    def __init__(self, path: str, dtype: str):
        super().__init__(path, dtype)
        self.cache: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each word: one of ASCII lower-case letters alone is one piece for the library's model, others take its whole path."""
        plain = [w.isascii() and w.isalpha() and w.islower() for w in words]
        ready = iter(self.encoded([w for w, p in zip(words, plain, strict=True) if not p]))
        tokenize, packed = self.tokenizer.model.tokenize, self.packed
        return [packed([t.id for t in tokenize(w)]) if p else next(ready) for w, p in zip(words, plain, strict=True)]

    def learn(self, words: list[str]) -> None:
        """Put the ids of ``words`` in the cache, by their core and tail where that is exact."""
        cores, cache = self.cores, self.cache
        whole, cased, tailed = [], [], []
        for w in words:
            if w.isalnum():
                # ASCII letters lose their case in the tokenizer too
                if w.isascii() and (low := w.lower()) != w:
                    cased.append((w, low))
                else:
                    whole.append(w)
                continue
            core = w.rstrip(TAIL)
            if len(core) == len(w) or not core.isalnum():
                whole.append(w)
            elif core.isascii():
                tailed.append((w, core.lower(), w[len(core) :]))
            elif max(core) < PLAIN_BELOW and MARKED not in core:
                # long-established letters stay letters or digits whatever is done to them, but for the one whose lower case ends in a mark
                tailed.append((w, core, w[len(core) :]))
            else:
                whole.append(w)
        cache.update(zip(whole, self.ids_of(whole), strict=True))
        missing = {k for _, k in cased}
        for _, core, tail in tailed:
            missing.add(core)
            missing.add(tail)
        new = [k for k in missing if k not in cores and k not in cache]
        cores.update(zip(new, self.ids_of(new), strict=True))
        known = lambda k: cores[k] if k in cores else cache[k]
        for w, k in cased:
            cache[w] = known(k)
        for w, core, tail in tailed:
            cache[w] = known(core) + known(tail)

    def __call__(self, texts: list[str | None], end: bytes) -> list[bytes]:
        # str.split() ends words at all white space of the tokenizer and at 0x1C-0x1F, which are none for it
        words = [t.split() if t and not any(c in t for c in "\x1c\x1d\x1e\x1f") else t.translate(BLANKS).split(" ") if t else [] for t in texts]
        missing = set().union(*words).difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache, missing = {}, set().union(*words)
        if len(self.cores) > CACHE_WORDS:
            self.cores = {}
        self.learn(list(missing))
        get = self.cache.__getitem__
        out = [b"".join(map(get, w)) + end for w in words]
        for w in missing:
            if len(w) > CACHE_CHARS:
                del self.cache[w]
                self.cores.pop(w, None)
        return out


#: The ASCII white space, made plain blanks.
BLANKS = {c: " " for c in range(0x09, 0x0E)}


@lru_cache(maxsize=1)
def encoder(path: str, dtype: str) -> Encoder:
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    by_word = all(kind.get(k) == v for k, v in BY_WORD.items()) and not any(any(c.isspace() for c in x["content"]) or x["lstrip"] or x["rstrip"] for x in kind["added_tokens"])
    return (WordEncoder if by_word else Encoder)(path, dtype)


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return 1 + max([*d["model"]["vocab"].values(), *(x["id"] for x in d["added_tokens"])])


def write_token_files(docs: DataFrame, tokenizer: str, out: str | None = None, *, end_id: int = 1, shards: int | None = None) -> tuple[str, list[dict]]:
    """Encode ``docs`` (doc_id, text) and write its shards under ``out`` (a mounted shared folder).

    Returns the folder and the manifest: shard, n_docs, n_tokens, base."""
    spark = bounded_batches(docs.sparkSession)
    folder = local_path(out or fresh_path(spark, "tokens"))
    os.makedirs(folder, exist_ok=True)
    dtype = "<u2" if vocabulary_size(tokenizer) <= 65536 else "<u4"
    parts = partitions(spark)
    shards = shards or 4 * parts
    cuts = sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.2 / shards))) if shards > 1 else []
    end = np.array([end_id], dtype=dtype).tobytes()

    def encode(batches):
        enc, bounds = encoder(tokenizer, dtype), np.array(cuts, dtype=np.float64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            shard = np.searchsorted(bounds, np.array([-np.inf if i is None else i for i in ids], dtype=np.float64), side="right").astype(np.int32)
            i = 0
            for texts in slices(batch.column(1)):
                j = i + len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(shard[i:j]), pa.array(ids[i:j], pa.int64()), pa.array(enc(texts.to_pylist(), end), pa.binary())], ["shard", "doc_id", "ids"])
                i = j

    def write(batches):
        width = int(dtype[2])
        at, file, docs_, offsets, tmp = None, None, [], [0], ""

        def finish():
            file.close()
            np.array(offsets, dtype="<i8").tofile(tmp + ".idx")
            np.array(docs_, dtype="<i8").tofile(tmp + ".doc")
            for kind in ("bin", "idx", "doc"):
                os.replace(f"{tmp}.{kind}", f"{folder}/{at:06d}.{kind}")
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([len(docs_)], pa.int64()), pa.array([offsets[-1]], pa.int64())], ["shard", "n_docs", "n_tokens"])

        for batch in batches:
            for shard, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != at:
                    if file:
                        yield finish()
                    at, docs_, offsets, tmp = shard, [], [0], f"{folder}/.{shard:06d}-{os.getpid()}-{os.urandom(4).hex()}"
                    file = open(tmp + ".bin", "wb")  # noqa: SIM115
                data = ids.as_buffer()
                file.write(data)
                docs_.append(NULL_ID if doc_id is None else doc_id)
                offsets.append(offsets[-1] + data.size // width)
        if file:
            yield finish()

    coded = docs.select("doc_id", "text").mapInArrow(encode, "shard int, doc_id long, ids binary")
    rows = coded.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(write, "shard int, n_docs long, n_tokens long").collect()
    manifest, base = [], 0
    for r in sorted(rows, key=lambda r: r.shard):
        manifest.append({"shard": r.shard, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "base": base})
        base += r.n_tokens
    with open(f"{folder}/manifest.json", "w") as f:
        json.dump({"dtype": dtype, "end_id": end_id, "shards": manifest}, f)
    return folder, manifest


def read_token_files(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the memory-mapped files.

    The checksum is over the ids as little-endian unsigned 32-bit integers, whatever their width on disk."""
    with open(f"{folder}/manifest.json") as f:
        info = json.load(f)
    schema, dtype = "doc_id long, start long, n_tokens long, ids_crc32 long", info["dtype"]
    if not info["shards"]:
        return spark.createDataFrame([], schema)

    def read(batches):
        for batch in batches:
            for shard, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                offsets, doc_ids = (np.memmap(f"{folder}/{shard:06d}.{kind}", dtype="<i8", mode="r") for kind in ("idx", "doc"))
                ids = np.memmap(f"{folder}/{shard:06d}.bin", dtype=dtype, mode="r")
                for i in range(0, len(doc_ids), 10_000):
                    o = np.asarray(offsets[i : i + 10_001])
                    crc = [zlib.crc32(ids[o[k] : o[k + 1]].astype("<u4")) for k in range(len(o) - 1)]
                    found = np.asarray(doc_ids[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(found, mask=found == NULL_ID), pa.array(o[:-1] + base), pa.array(np.diff(o)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame([(s["shard"], s["base"]) for s in info["shards"]], "shard int, base long")
    return rows.repartition(min(len(info["shards"]), 4 * partitions(spark))).mapInArrow(read, schema)
