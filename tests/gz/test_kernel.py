import ast
import gzip
import random
import struct
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gzframe import kernel
from tests.gz.build import CORRUPT, GOOD, flip, member

SIZES = [1, 2, 3, 7, 64, 1024, 2**18]


def decode(data, feed=2**18, **options):
    report = kernel.Report()
    return b"".join(kernel.scan([data[i : i + feed] for i in range(0, len(data), feed)], report, **options)), report


@pytest.mark.parametrize("name", CORRUPT)
@pytest.mark.parametrize("feed", [1, 7, 2**18])
def test_corrupt_streams_are_refused(name, feed):
    with pytest.raises(kernel.BadGzip):
        decode(CORRUPT[name], feed)


def test_member_fields():
    _, r = decode(member(b"hello", filename="data.bin"))
    m = r.members[0]
    assert (m.index, m.compressed_offset, m.uncompressed_size, m.original_filename, m.flags, m.crc32, m.trailer_isize) == (0, 0, 5, "data.bin", 8, 0x3610A686, 5)
    assert m.comment is None and m.extra is None and m.compressed_size == r.compressed_size


def test_empty_stream_and_empty_member():
    assert decode(b"")[1] == kernel.Report(finished=True)
    out, r = decode(kernel.compress(b""))
    assert out == b"" and r.member_count == 1 and r.uncompressed_size == 0


def test_padding_counts_for_the_stream_only():
    a, b = member(b"a"), member(b"bb", mtime=7)
    out, r = decode(a + b"\0" * 7 + b + b"\0" * 32, 5)
    assert out == b"abb" and r.compressed_size == len(a) + len(b) + 39 and r.mtime == 7
    assert [(m.compressed_offset, m.compressed_size) for m in r.members] == [(0, len(a)), (len(a) + 7, len(b))]


@pytest.mark.parametrize("feed", [1, 64, 2**18])
def test_limit_is_exact_and_cumulative(feed):
    data = member(b"x" * 600) + member(b"y" * 400)
    assert decode(data, feed, limit=1000)[0] == b"x" * 600 + b"y" * 400
    report, got = kernel.Report(), []
    with pytest.raises(kernel.LimitExceeded):
        for part in kernel.scan([data[i : i + feed] for i in range(0, len(data), feed)], report, limit=999):
            got.append(part)
    assert b"".join(got) == b"x" * 600 + b"y" * 399 and report.uncompressed_size == 999 and report.member_count == 1


def test_members_before_a_failure_stay_valid():
    report = kernel.Report()
    with pytest.raises(kernel.BadGzip):
        list(kernel.scan([member(b"one") + flip(member(b"two"), -8)], report))
    assert [m.uncompressed_size for m in report.members] == [3]


@given(st.lists(st.tuples(st.binary(max_size=500), st.integers(0, 9), st.integers(0, 16), st.integers(0, 2**32 - 1), st.none() | st.binary(max_size=16), st.none() | st.text(st.characters(max_codepoint=255, exclude_characters="\0"), max_size=16), st.booleans()), max_size=5), st.sampled_from(SIZES))
@settings(max_examples=150, deadline=None)
def test_random_members(members, size):
    data, want, at = b"", [], 0
    for payload, level, pad, mtime, extra, text, check in members:
        m = member(payload, level=level, mtime=mtime, extra=extra, filename=text, comment=text, header_crc=check)
        want.append((at, len(m), len(payload), mtime, text, text, extra))
        data += m + b"\0" * pad
        at = len(data)
    out, r = decode(data, size, chunk_size=size)
    assert out == b"".join(m[0] for m in members) == (gzip.decompress(data) if data else b"")
    assert [(m.compressed_offset, m.compressed_size, m.uncompressed_size, m.mtime, m.original_filename, m.comment, m.extra) for m in r.members] == want
    assert r.compressed_size == len(data)


@given(st.integers(0, len(GOOD) - 1), st.integers(1, 255))
@settings(max_examples=150, deadline=None)
def test_what_the_standard_library_refuses_is_refused(at, mask):
    data = flip(GOOD, at, mask)
    try:
        want = gzip.decompress(data)
    except (OSError, EOFError, zlib.error):
        with pytest.raises(kernel.GzipStreamError):
            decode(data)
    else:
        try:
            assert decode(data)[0] == want
        except kernel.BadGzip:
            assert data[3] & (kernel.RESERVED | kernel.FHCRC)


@given(st.lists(st.binary(max_size=300), max_size=6), st.integers(-1, 9), st.integers(0, 2**32 - 1))
@settings(max_examples=80, deadline=None)
def test_encode_is_one_member(chunks, level, mtime):
    data = b"".join(kernel.encode(chunks, level=level, mtime=mtime, flush_every=2))
    assert gzip.decompress(data) == b"".join(chunks)
    assert decode(data)[1].member_count == 1 and struct.unpack_from("<I", data, 4)[0] == mtime


def test_header_of_writers():
    head = lambda **o: kernel.compress(b"x", mtime=1.9, **o)
    assert head()[:10] == b"\x1f\x8b\x08\x00\x01\x00\x00\x00\x00\xff"
    assert head(level=9)[8] == 2 and head(level=1)[8] == 4
    assert decode(head(path="/a/b/café.txt.gz"))[1].members[0].original_filename == "café.txt"
    assert decode(head(original_filename="日本.gz"))[1].members[0].original_filename is None
    assert kernel.compress(b"x")[4:8] != b"\0\0\0\0"


@pytest.mark.parametrize("bad", [{"level": 10}, {"mtime": -1}, {"mtime": 2**32}, {"original_filename": "a\0b"}])
def test_arguments_are_checked_at_the_call(bad):
    with pytest.raises(ValueError):
        kernel.encode([], **bad)


@pytest.mark.parametrize("bad", [{"level": True}, {"level": "6"}, {"mtime": "1"}, {"original_filename": 3}])
def test_argument_types_are_checked(bad):
    with pytest.raises(TypeError):
        kernel.encode([], **bad)


def test_strict_size(monkeypatch):
    monkeypatch.setattr(kernel, "UINT32", 10)
    with pytest.raises(kernel.SizeOverflow):
        kernel.compress(b"x" * 11, mtime=0, strict_size=True)


def test_kernel_imports_neither_spark_nor_io():
    names = {a.name for n in ast.walk(ast.parse(open(kernel.__file__).read())) if isinstance(n, ast.Import) for a in n.names}
    assert not names & {"pyspark", "pyarrow", "io", "gzip"}


def seconds(f):
    best = float("inf")
    for _ in range(3):
        began = time.perf_counter()
        f()
        best = min(best, time.perf_counter() - began)
    return best


@pytest.mark.parametrize("feed", [2**16, 2**30])
def test_time_follows_the_input(feed):
    # four times the input takes about four times as long; sixteen times would be its square
    noise = random.Random(1).randbytes(2**24)
    inputs = [(member(b"x", filename="n" * n), member(b"x", filename="n" * 4 * n)) for n in [2**22]]
    inputs += [(member(noise[: 2**22]), member(noise)), (member(b"\0" * 2**22), member(b"\0" * 2**24)), (member(b"hello") * 1000, member(b"hello") * 4000), (member(b"a") + b"\0" * 2**22 + member(b"b"), member(b"a") + b"\0" * 2**24 + member(b"b"))]
    for small, large in inputs:
        assert seconds(lambda: decode(large, feed)) < 9 * seconds(lambda: decode(small, feed)) + 0.02  # noqa: B023


def test_long_header_text_is_refused_as_it_comes():
    read = []

    def feeds():
        yield member(b"x", filename="n")[:10]
        while True:
            read.append(1)
            yield b"n" * 2**20

    with pytest.raises(kernel.BadGzip, match="too long"):
        list(kernel.scan(feeds(), kernel.Report()))
    assert len(read) <= kernel.MAX_HEADER // 2**20 + 1


def test_encoder_reports_sizes_and_checksum():
    e = kernel.MemberEncoder(mtime=0)
    data = e.begin() + e.feed(b"abc") + e.feed(b"de") + e.finish()
    assert gzip.decompress(data) == b"abcde" and (e.uncompressed_size, e.compressed_size, e.crc32) == (5, len(data), zlib.crc32(b"abcde"))
