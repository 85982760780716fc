"""Files of a mounted path are read in bounded pieces: no relation here may have a file or its payload in a row."""

import hashlib
import io
import random
import tracemalloc
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from gzframe.operators import relations as R
from gzframe.plans import files
from gzframe.sources import mounted, reader
from gzframe.sources.reader import GzReader, read, write
from gzframe.streaming import pipes
from tests.gz.build import CORRUPT, member

TEXTS = ["", "\n", "\r", "\r\n\n\r\r\n\n\r\n\r" * 30, "no end", "é\r\n日本\rend\n" * 40_000, *("".join(random.Random(k).choices("ab\n\r\x0b\x85é ", k=200)) for k in range(9))]


@contextmanager
def no_content(spark):
    """Spark gives no file's content: a row may have 10 bytes of it."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def put(folder, texts):
    for i, t in enumerate(texts):
        data = t.encode()
        (folder / f"{i}.gz").write_bytes(member(data[:9]) + member(data[9:]))


def by_file(rows):
    got = {}
    for r in rows:
        got.setdefault(int(r.path.rsplit("/", 1)[1][:-3]), []).append((r.line_no, r.line))
    return {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("newline", ["", "\n", "\r", "\r\n"])
def test_lines_kept_without_the_content_in_a_row(spark, tmp_path, newline):
    put(tmp_path, TEXTS)
    with no_content(spark):
        got = by_file(read(spark, str(tmp_path), "rt", newline=newline).collect())
    for i, t in enumerate(TEXTS):
        assert got.get(i, []) == list(enumerate(io.TextIOWrapper(io.BytesIO(t.encode()), "utf-8", newline=newline)))


def test_lines_of_a_file_are_not_held(tmp_path):
    (tmp_path / "a.gz").write_bytes(member(b"a line of some length\r\n" * 3_000_000, level=1))
    tracemalloc.start()
    n = sum(b.num_rows for b in mounted.line_batches(str(tmp_path / "a.gz"), "", "utf-8", "strict", None, "FAILFAST"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3_000_000 and peak < 12 * 2**20


def test_no_line_of_a_stream_that_is_not_valid(spark, tmp_path):
    (tmp_path / "0.gz").write_bytes(member(b"good\n"))
    (tmp_path / "1.gz").write_bytes(CORRUPT["crc"])
    rows = GzReader(spark).option(mode="PERMISSIVE").load(str(tmp_path)).lines().collect()
    assert by_file(rows) == {0: [(0, "good\n")]}
    with pytest.raises(Exception, match="CRC-32"):
        read(spark, str(tmp_path), "rt").collect()
    with pytest.raises(Exception, match="CRC-32"):
        next(mounted.line_batches(str(tmp_path / "1.gz"), None, "utf-8", "strict", None, "FAILFAST"))
    (tmp_path / "1.gz").write_bytes(member(b"\xff\n"))
    with pytest.raises(Exception, match="DECODE"):
        read(spark, str(tmp_path), "rt").collect()
    assert [r.line for r in read(spark, str(tmp_path / "1.gz"), "rt", errors="replace").collect()] == ["�\n"]
    with pytest.raises(Exception, match="exceeded 3 bytes"):
        read(spark, str(tmp_path / "0.gz"), "rt", max_decompressed_size=3).collect()


def test_appended_files_verified_without_the_content_in_a_row(spark, tmp_path):
    (tmp_path / "0.gz").write_bytes(member(b"one") + member(b"three") + b"\0\0")
    (tmp_path / "1.gz").write_bytes(member(b"four") + CORRUPT["crc"])
    reader = GzReader(spark).load(str(tmp_path))
    want = R.streams(reader.df, ["path"], mode="PERMISSIVE").orderBy("path")
    with no_content(spark):
        got = reader.option(mode="PERMISSIVE").streams().orderBy("path")
        rows = got.collect()
        with pytest.raises(Exception, match="CRC-32"):
            reader.option(mode="FAILFAST").verify().collect()
    assert rows == want.collect() and got.dtypes == want.dtypes
    assert [(r.member_count, r.uncompressed_size, r.error_class) for r in rows[:1]] == [(2, 8, None)] and rows[1].error_class == "BAD_GZIP"


def test_whole_files_digested_without_the_content_in_a_row(spark, tmp_path):
    put(tmp_path, TEXTS)
    (tmp_path / "99.gz").write_bytes(CORRUPT["crc"])
    reader = GzReader(spark).option(mode="PERMISSIVE").load(str(tmp_path))
    with no_content(spark):
        got = {int(r.path.rsplit("/", 1)[1][:-3]): r.digest for r in reader.digests().collect()}
        with pytest.raises(Exception, match="CRC-32"):
            reader.option(mode="FAILFAST").digests().collect()
    assert got == {99: None} | {i: hashlib.md5(t.encode()).hexdigest() for i, t in enumerate(TEXTS)}


def test_query_of_whole_files_without_the_content_in_a_row(spark):
    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        want.setdefault(f"docs-{r.lang}", hashlib.md5()).update(r.text.encode())
    with no_content(spark):
        assert {r.name: r.digest for r in files.files_read_whole(spark, folder).collect()} == {k: v.hexdigest() for k, v in want.items()}


def test_lines_of_universal_newlines_without_the_content_in_a_row(spark, tmp_path):
    put(tmp_path, TEXTS)
    with no_content(spark):
        got = by_file(read(spark, str(tmp_path), "rt").collect())
    for i, t in enumerate(TEXTS):
        assert got.get(i, []) == list(enumerate(io.TextIOWrapper(io.BytesIO(t.encode()), "utf-8")))


def test_file_of_text_lines_is_written_by_several_tasks_in_order(spark):
    folder, want = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        want[f"docs-{r.lang}"] = want.get(f"docs-{r.lang}", "") + r.text + "\n"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = files._text_files(spark, folder, "\r\n")
        rows = files.files_text_lines(spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.member_count for r in GzReader(spark).load(path).verify().collect()) > len(want)
    got = {}
    for r in sorted(rows, key=lambda r: (r.name, r.line_no)):
        got.setdefault(r.name, []).append((r.line_no, r.line))
    assert got == {k: list(enumerate(io.StringIO(v, newline="\n"))) for k, v in want.items()}


class Batches(reader.GzWriterSource):
    """Leaves the sizes of its batches beside the folder."""

    def write(self, iterator):
        sizes = []
        out = super().write(sizes.append(b.nbytes) or b for b in iterator)
        with open(f"{self.folder}-batches", "a") as f:
            f.writelines(f"{n}\n" for n in sizes)
        return out


class Watched(reader.GzStreamSource):
    def writer(self, schema, overwrite):
        return Batches(dict(self.options), overwrite)


def test_task_of_the_sink_gets_rows_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reader, "register_source", lambda spark: spark.dataSource.register(Watched))
    rows = spark.range(0, 800, 1, 1).select(F.lit("a").alias("name"), F.repeat(F.lit("x\n"), 25_000).alias("data"))
    write(rows, str(tmp_path / "out"), "wt", newline="\n")
    sizes = [int(x) for x in (tmp_path / "out-batches").read_text().split()]
    assert sum(sizes) >= 800 * 50_000 and max(sizes) < 2 * reader.BATCH_BYTES
    assert GzReader(spark).load(str(tmp_path / "out")).verify().first().uncompressed_size == 800 * 50_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


@pytest.mark.parametrize("newline", [None, "", "\r"])
def test_whole_texts_digested_without_the_content_in_a_row(spark, tmp_path, newline):
    put(tmp_path, TEXTS)
    reader = GzReader(spark).option(newline=newline).load(str(tmp_path))
    want = {r.path: hashlib.md5(r.text.encode()).hexdigest() for r in reader.text().collect()}
    with no_content(spark):
        got = reader.text_digests().collect()
    assert {r.path: r.digest for r in got} == want and len(got) == len(TEXTS)


def test_stream_of_lines_without_the_content_in_a_row(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", TEXTS)
    with no_content(spark):
        lines = pipes.stream_lines(spark, str(tmp_path / "in"), newline="\n", max_files=4)
        q = lines.writeStream.format("memory").queryName("mounted_lines").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = by_file(spark.table("mounted_lines").collect())
    for i, t in enumerate(TEXTS):
        assert got.get(i, []) == list(enumerate(io.TextIOWrapper(io.BytesIO(t.encode()), "utf-8", newline="\n")))
