import gzip
import io
import json
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gzframe import kernel
from gzframe.functions import columns as C
from gzframe.operators import relations as R
from gzframe.sources.reader import COMMIT_FILE, GzReader, GzWriterSource, member_chunks, member_payloads, member_ranges, parse_mode, read, register_source, write
from tests.gz.build import CORRUPT, GOOD, member

RICH = "héllo\n\nplain\r\ncr only\rmixed\n\rVT\x0b FF\x0c FS\x1c NEL\x85 LS  PS  end\n日本\r\nlast"
TEXTS = [RICH, "", "\n", "\r", "\r\n", "\r\n\n\r\r\n\n\r\n\r" * 30, "no end", *("".join(random.Random(k).choice("ab\n\r\x0b\x85é ") for _ in range(40)) for k in range(40))]


@pytest.mark.parametrize("newline", [None, "", "\n", "\r", "\r\n"])
def test_lines_equal_the_text_layer(spark, newline):
    rows = [(i, t, bytearray(member(t.encode()[:9]) + member(t.encode()[9:]))) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id int, text string, content binary")
    got = {}
    for r in R.gz_lines(df, ["id"], newline=newline).collect():
        got.setdefault(r.id, []).append((r.line_no, r.line))
    for i, t in enumerate(TEXTS):
        want = list(io.TextIOWrapper(io.BytesIO(t.encode()), encoding="utf-8", newline=newline))
        assert [line for _, line in sorted(got.get(i, []))] == want


def test_offsets_limits_kinds_and_binary_lines(spark):
    df = spark.createDataFrame([(1, RICH), (2, "")], "id int, text string")
    rows = R.with_offsets(R.lines(df, ["id"], "text", ""), ["id"]).orderBy("line_no").collect()
    data = RICH.encode()
    assert all(data[r.byte_offset :].startswith(r.line.encode()) and RICH[r.char_offset :].startswith(r.line) for r in rows)
    assert R.lines_from(R.with_offsets(R.lines(df, ["id"], "text", ""), ["id"]), 10).count() == sum(r.byte_offset >= 10 for r in rows)
    f = io.TextIOWrapper(io.BytesIO(data), encoding="utf-8", newline="")
    want = []
    while part := f.readline(4):
        want.append(part)
    one = df.where("id = 1").select(
        C.limited_lines("text", 4, "").alias("limited"), C.seen_newlines("text").alias("seen"), C.split_binary_lines(F.col("text").cast("binary")).alias("b"), C.limited_lines("text", 0).alias("none"), C.read_text("text", 1, 4).alias("t")
    ).first()
    assert one.limited == want
    assert one.seen == ["\r", "\n", "\r\n"] and [bytes(b) for b in one.b] == io.BytesIO(data).readlines() and one.none == [] and one.t == RICH[1:5]
    assert df.where("id = 2").select(C.seen_newlines("text")).first()[0] is None


def test_limited_lines_equal_the_text_layer(spark):
    rng = random.Random(3)
    texts = ["", "\r\n", "ab\r\ncd\r\n", "\r\r\n\n", *("".join(rng.choices("ab\r\né", k=rng.randrange(1, 30))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for newline in (None, "", "\n", "\r", "\r\n"):
        for limit in (1, 2, 3, 7):
            got = dict(df.select("id", C.limited_lines("text", limit, newline)).collect())
            for i, t in enumerate(texts):
                f, want = io.TextIOWrapper(io.BytesIO(t.encode()), encoding="utf-8", newline=newline), []
                while part := f.readline(limit):
                    want.append(part)
                assert got[i] == want, (newline, limit, t)


def test_corpus_through_spark(spark):
    rows = [(n, bytearray(d)) for n, d in CORRUPT.items()] + [("good", bytearray(GOOD)), ("empty", bytearray(b"")), ("null", None)]
    df = spark.createDataFrame(rows, "name string, content binary")
    got = {r.name: r for r in R.streams(df, ["name"], mode="PERMISSIVE").collect()}
    assert all(got[n].error_class == "BAD_GZIP" for n in CORRUPT)
    assert got["good"].error_class is None and got["good"].member_count == 1 and got["empty"].member_count == 0 and got["null"].member_count is None
    with pytest.raises(Exception, match="CRC"):
        R.streams(df.where("name = 'crc'"), ["name"]).collect()
    assert R.members(df.where("name = 'junk'"), ["name"], mode="PERMISSIVE").count() == 1
    saved = df.where("name = 'crc'").select(C.gz_recover("content").alias("r")).first().r
    assert bytes(saved.payload_prefix) == b"hello world\n" * 100 and saved.error_class == "BAD_GZIP"
    assert df.where("name = 'crc'").select(C.gz_decompress("content", mode="PERMISSIVE")).first()[0] is None


def test_chunks_and_ordered_chunks(spark):
    payload = bytes(random.Random(1).randbytes(10_000))
    df = spark.createDataFrame([(1, bytearray(member(payload[:7000]) + member(payload[7000:])))], "id int, content binary")
    rows = R.chunks(df, ["id"], size=999).orderBy("seq").collect()
    assert b"".join(r.data for r in rows) == payload and [r.byte_offset for r in rows] == list(range(0, 10_000, 999))
    pieces = spark.createDataFrame([(1, k, bytearray(payload[k * 100 : k * 100 + 100])) for k in range(100)], "id int, n int, data binary").repartition(4)
    files = R.encode_chunks(pieces, ["id"], "n", "data", mtime=5, original_filename="x.gz")
    m = R.members(files, ["id"]).first()
    assert m.uncompressed_size == 10_000 and m.mtime == 5 and m.original_filename == "x"
    blob = bytes(files.first().content)
    fed = spark.createDataFrame([(1, k, bytearray(blob[k * 13 : k * 13 + 13])) for k in range(len(blob) // 13 + 1)], "id int, n int, b binary")
    assert b"".join(r.data for r in R.decode_chunks(fed, ["id"], "n", "b", size=4096).orderBy("seq").collect()) == payload


def test_batches(spark):
    df = spark.createDataFrame([(1, "aa\nbbbb\nc\ndddddd\ne"), (2, "")], "id int, text string")
    got = [r.lines for r in R.batches(df, ["id"], "text", 5, "\n").orderBy("batch").collect()]
    assert got == [["aa\n", "bbbb\n"], ["c\n", "dddddd\n"], ["e"]]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            R.batches(df, ["id"], "text", bad)
    with pytest.raises(TypeError):
        R.batches(df, ["id"], "text", True)


def test_positions(spark):
    df = spark.createDataFrame([(bytearray(b"0123456789"),)], "p binary")
    pick = lambda c: bytes(df.select(c).first()[0])
    assert pick(C.byte_range("p", 3)) == b"3456789" and pick(C.byte_range("p", 3, 2)) == b"34" and pick(C.byte_range("p", 30, 2)) == b""
    assert pick(C.read_from("p", C.seek_position("p", -3, 2))) == b"789" and pick(C.read_from("p", C.seek_position("p", -30, 2), 1)) == b"0"
    assert pick(C.read_from("p", C.seek_position("p", 30))) == b"" and pick(C.read_from("p", C.seek_position("p", 2, 1, 3), 2)) == b"56"
    assert pick(C.zero_fill("p", 12)) == b"0123456789\0\0" and pick(C.peek("p", 4)) == b"0123"
    with pytest.raises(OSError):
        C.seek_position("p", -1)
    with pytest.raises(Exception, match="negative seek"):
        df.select(C.seek_position("p", -4, 1, 3)).collect()


def test_text_columns(spark):
    df = spark.createDataFrame([(bytearray("é".encode("latin-1")), "a\nb")], "p binary, t string")
    assert df.select(C.decode_text("p", "latin-1")).first()[0] == "é"
    assert df.select(C.decode_text("p", "utf-8", "replace")).first()[0] == "�"
    with pytest.raises(Exception, match="DECODE"):
        df.select(C.decode_text("p")).collect()
    assert bytes(df.select(C.encode_text("t", "utf-16-le", newline="\r\n")).first()[0]) == "a\r\nb".encode("utf-16-le")
    assert df.select(C.embedded_name(F.lit("/a/b.txt.gz")), C.embedded_name(F.lit("日")), C.normalized_mtime(F.lit(3.9)), C.normalized_mtime(F.lit(-1.0))).first()[:] == ("b.txt", None, 3, None)
    with pytest.raises(LookupError):
        C.decode_text("p", "no-such-encoding")
    with pytest.raises(ValueError):
        C.translate_on_read("t", "x")


def test_files_source_sink_and_member_parallel(spark, tmp_path):
    register_source(spark)
    folder = str(tmp_path / "out")
    df = spark.createDataFrame([("a", b"one\n"), ("b", b"two\n"), ("a", b"three\n")], "name string, data binary").coalesce(1)
    write(df, folder, "wb", mtime=3)
    assert {r.path.rsplit("/", 1)[1]: bytes(r.payload) for r in read(spark, folder).collect()} == {"a.gz": b"one\nthree\n", "b.gz": b"two\n"}
    write(df.where("name = 'b'"), folder, "ab", mtime=3)
    m = GzReader(spark).load(folder).members().where("path like '%b.gz'").orderBy("index").collect()
    assert [x["index"] for x in m] == [0, 1] and {x.original_filename for x in m} == {"b"} and {x.mtime for x in m} == {3}
    with pytest.raises(Exception, match="exists"):
        write(df, folder, "xb")
    write(df.where("name = 'b'"), folder, "wb")
    assert GzReader(spark).load(folder).streams().count() == 1
    big = str(tmp_path / "big.gz")
    with open(big, "wb") as f:
        f.write(b"".join(member(b"%d" % k * 1000) + b"\0" * k for k in range(5)))
    serial = spark.read.format("gzstream").option("chunk_size", 700).load(big)
    split = spark.read.format("gzstream").option("chunk_size", 700).option("split", "member").load(big)
    assert split.rdd.getNumPartitions() == 5 and serial.rdd.getNumPartitions() == 1
    whole = lambda d: b"".join(bytes(r.data) for r in d.orderBy("byte_offset").collect())
    assert whole(serial) == whole(split) == b"".join(b"%d" % k * 1000 for k in range(5))
    reader = GzReader(spark).load(big)
    for ranges in (None, reader.members()):
        parts = member_payloads(reader.df, ranges).orderBy("index").collect()
        assert [bytes(p.payload) for p in parts] == [b"%d" % k * 1000 for k in range(5)]


def test_members_are_listed_and_read_by_jobs(spark, tmp_path):
    for name, n in (("a", 3), ("b", 1)):
        (tmp_path / f"{name}.gz").write_bytes(b"".join(member(f"{name}{k}".encode() * 700) + b"\0" * 5 for k in range(n)))
    ranges = member_ranges(spark, str(tmp_path))
    assert [(r["index"], r.uncompressed_offset, r.uncompressed_size) for r in ranges.where("path like '%a.gz'").orderBy("index").collect()] == [(k, 1400 * k, 1400) for k in range(3)]
    got = member_chunks(spark, str(tmp_path), 512).orderBy("path", "byte_offset").collect()
    assert b"".join(bytes(r.data) for r in got) == b"".join(f"{n}".encode() * 700 for n in ("a0", "a1", "a2", "b0"))
    ranges.write.json(str(tmp_path / "_ranges"))
    split = spark.read.format("gzstream").option("split", "member").option("ranges", str(tmp_path / "_ranges")).load(str(tmp_path))
    assert split.rdd.getNumPartitions() == 4 and split.count() == 4


def test_commits_can_be_repeated(tmp_path):
    def writer(overwrite=False, **options):
        return GzWriterSource({"path": str(tmp_path / "out"), "mtime": "0", **options}, overwrite)

    def batch(*rows):
        return iter([pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["name", "data"])])

    def files():
        return {f.name: gzip.decompress(f.read_bytes()) for f in (tmp_path / "out").iterdir() if f.suffix == ".gz"}

    w = writer()
    w.commit([w.write(batch(("a", b"1"), ("b", b"2"), ("a", b"3")))])
    assert files() == {"a.gz": b"13", "b.gz": b"2"}
    (tmp_path / "out" / "notes.txt").write_text("not ours")
    # a commit that stops half way, and is then run again, appends once
    w = writer()
    messages = [w.write(batch(("a", b"4"), ("b", b"5"))), w.write(batch(("a", b"6")))]
    join, done = w._join, []

    def stops(target, before, tmps):
        if done:
            raise OSError("machine lost")
        done.append(target)
        join(target, before, tmps)

    w._join = stops
    with pytest.raises(OSError):
        w.commit(messages)
    assert all(v.startswith((b"13", b"2")) for v in files().values())
    w._join = join
    w.commit(messages)
    assert files() == {"a.gz": b"1346", "b.gz": b"25"}
    report = json.loads((tmp_path / "out" / COMMIT_FILE).read_text())
    assert {(r["file"], r["uncompressed_size"], r["crc32"]) for r in report} == {("a.gz", 1, zlib.crc32(b"4")), ("a.gz", 1, zlib.crc32(b"6")), ("b.gz", 1, zlib.crc32(b"5"))}
    w = writer(overwrite=True)
    w.commit([w.write(batch(("b", b"new")))])
    assert files() == {"b.gz": b"new"} and (tmp_path / "out" / "notes.txt").exists()
    w = writer()
    w.abort([w.write(batch(("c", b"x")))])
    assert files() == {"b.gz": b"new"} and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".")]
    for bad in (None, "", "a/b", ".a", "_a"):
        with pytest.raises(ValueError):
            writer().write(batch((bad, b"x")))


def test_reader_options_and_text(spark, tmp_path):
    with open(tmp_path / "t.gz", "wb") as f:
        f.write(kernel.compress("a\r\nb\r\nc".encode("utf-16"), mtime=0))
    got = [r.line for r in read(spark, str(tmp_path / "t.gz"), "rt", encoding="utf-16").orderBy("line_no").collect()]
    assert got == ["a\n", "b\n", "c"]
    assert GzReader(spark).option(encoding="utf-16", hint=3).load(str(tmp_path)).batches().count() == 2
    assert GzReader(spark).load(str(tmp_path)).files().columns == ["path", "modificationTime", "length"]
    assert GzReader(spark).option(chunk_size=4).load(str(tmp_path)).chunks().count() == 4
    with pytest.raises(TypeError):
        GzReader(spark).option(nonsense=1)
    with pytest.raises(ValueError):
        read(spark, "x", "rb", encoding="utf-8")
    for bad in ("", "rw", "rbt", "q", "rr", "b"):
        with pytest.raises(ValueError):
            parse_mode(bad)
    assert parse_mode("tr+") == ("r", True, True)


def test_sql_functions(spark):
    C.register(spark)
    got = spark.sql("SELECT gz_verify(b).member_count AS n, cast(gz_decompress(b) AS string) AS t FROM (SELECT gz_compress(cast('a\nb' AS binary)) AS b)").first()
    assert got.n == 1 and got.t == "a\nb"
    assert spark.sql("SELECT m.uncompressed_size AS n FROM (SELECT gz_compress(cast('abc' AS binary)) AS b) s, LATERAL gz_members(s.b) m").first().n == 3
    assert spark.sql("SELECT l.line AS line FROM (SELECT gz_compress(cast('a\nb' AS binary)) AS b) s, LATERAL gz_lines(s.b, '\n') l ORDER BY l.line_no").collect()[1].line == "b"
    assert spark.sql("SELECT count(*) AS n FROM (SELECT gz_compress(cast('abcde' AS binary)) AS b) s, LATERAL gz_chunks(s.b, 2) c").first().n == 3


def test_fast_compress_warns(spark):
    with pytest.warns(UserWarning):
        C.gz_compress("x", fast_compress=True)
