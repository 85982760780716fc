"""RFC 1952 on bytes: one scanner and one encoder, without Spark and without I/O.

Everything that validates or produces gzip data goes through ``scan`` and
``encode``; the Spark layers are wrappers around them."""

from __future__ import annotations

import os
import re
import struct
import time
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

# Fixed values of the format and of the contract.
MAGIC = b"\x1f\x8b"
DEFLATE = 8
FHCRC, FEXTRA, FNAME, FCOMMENT = 2, 4, 8, 16
RESERVED = 0xE0
OS_UNKNOWN = 255
MAX_HEADER = MAX_CHUNK = 128 * 2**20
CHUNK = 256 * 2**10
LEVEL = 6
#: Bytes given to the decoder at a time.
LEAST_FEED, MOST_FEED = 2**10, 2**16
UINT32 = 2**32 - 1


class GzipStreamError(Exception):
    """A failure with the class that permissive relations report."""

    error_class = "IO"


class BadGzip(GzipStreamError):
    error_class = "BAD_GZIP"


class LimitExceeded(GzipStreamError):
    error_class = "LIMIT_EXCEEDED"


class SizeOverflow(GzipStreamError):
    error_class = "ISIZE_OVERFLOW"


@dataclass
class Member:
    index: int
    compressed_offset: int
    compressed_size: int
    uncompressed_size: int
    mtime: int
    original_filename: str | None
    comment: str | None
    extra: bytes | None
    flags: int
    crc32: int
    trailer_isize: int


@dataclass
class Report:
    """What a scan has validated so far; members commit with their trailers, ``mtime`` with a completed header."""

    members: list[Member] = field(default_factory=list)
    member_count: int = 0
    compressed_size: int = 0
    uncompressed_size: int = 0
    mtime: int | None = None
    finished: bool = False


def check_chunk_size(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError("chunk size must be an integer")
    if not 0 < n <= MAX_CHUNK:
        raise ValueError(f"chunk size must be between 1 and {MAX_CHUNK}")
    return n


def check_positive(n: int | None, name: str) -> int | None:
    if n is None:
        return None
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError(f"{name} must be a positive integer or None")
    if n <= 0:
        raise ValueError(f"{name} must be positive")
    return n


def check_level(level: int) -> int:
    if isinstance(level, bool) or not isinstance(level, int):
        raise TypeError("compression level must be an integer")
    if not -1 <= level <= 9:
        raise ValueError("compression level must be between -1 and 9")
    return level


def check_mtime(mtime: float | None) -> int | None:
    if mtime is None:
        return None
    if not isinstance(mtime, (int, float)):
        raise TypeError("mtime must be a number")
    if mtime < 0 or int(mtime) > UINT32:
        raise ValueError(f"mtime must be between 0 and {UINT32}")
    return int(mtime)


def header_filename(explicit: str | bytes | None, path: str | bytes | None = None) -> bytes:
    """The FNAME to write: base name without ``.gz``; empty when there is none or it is not Latin-1."""
    name = path if explicit is None else explicit
    if name is None:
        return b""
    if not isinstance(name, (str, bytes)):
        raise TypeError("original filename must be text or bytes")
    if isinstance(name, str):
        try:
            name = os.path.basename(name).encode("latin-1")
        except UnicodeEncodeError:
            return b""
    if b"\0" in name:
        raise ValueError("original filename cannot contain NUL")
    return os.path.basename(name).removesuffix(b".gz")


class _Source:
    """Unread input: one chunk and a place in it. Nothing is joined or cut that need not be, so feeds of any size cost their length."""

    def __init__(self, chunks: Iterable[bytes], report: Report):
        self.chunks, self.report = iter(chunks), report
        self.data, self.at, self.before = b"", 0, 0

    @property
    def offset(self) -> int:
        return self.before + self.at

    def more(self) -> bool:
        """Take the next chunk that holds anything; the one before it has been read."""
        for chunk in self.chunks:
            if chunk:
                self.before += len(self.data)
                self.data, self.at = bytes(chunk), 0
                self.report.compressed_size += len(chunk)
                return True
        return False

    def take(self, n: int, what: str) -> bytes:
        """The next ``n`` bytes."""
        end = self.at + n
        if end <= len(self.data):
            found, self.at = self.data[self.at : end], end
            return found
        parts = []
        while n:
            if self.at == len(self.data) and not self.more():
                raise BadGzip(f"stream ended in {what}")
            parts.append(self.data[self.at : self.at + n])
            self.at += len(parts[-1])
            n -= len(parts[-1])
        return b"".join(parts)

    def take_text(self, room: int, what: str) -> bytes:
        """The bytes up to the next zero byte, which is taken too; at most ``room`` of both."""
        parts, size = [], 0
        while True:
            if self.at == len(self.data) and not self.more():
                raise BadGzip(f"stream ended in {what}")
            end = self.data.find(b"\0", self.at, self.at + room - size)
            last = end >= 0
            parts.append(self.data[self.at : end if last else self.at + room - size])
            size += len(parts[-1])
            self.at += len(parts[-1]) + last
            if last:
                return b"".join(parts)
            if size >= room:
                raise BadGzip("gzip header is too long")

    def at_member(self, padded: bool) -> bool:
        """Whether another member follows; zero bytes may stand between and after members, not before the first."""
        while True:
            if self.at < len(self.data):
                if not padded or self.data[self.at]:
                    return True
                found = _NOT_ZERO.search(self.data, self.at)
                self.at = found.start() if found else len(self.data)
                if found:
                    return True
            if not self.more():
                return False


_NOT_ZERO = re.compile(rb"[^\0]")
#: How a header without optional fields begins.
_PLAIN = MAGIC + bytes([DEFLATE, 0])


def _header(source: _Source) -> tuple[int, int, str | None, str | None, bytes | None]:
    """Parse the header at the source's position: flags, mtime, filename, comment, extra."""
    if source.data.startswith(_PLAIN, source.at) and source.at + 10 <= len(source.data):
        at, source.at = source.at, source.at + 10
        return 0, int.from_bytes(source.data[at + 4 : at + 8], "little"), None, None, None
    fixed = source.take(2, "a member header")
    if fixed != MAGIC:
        raise BadGzip("not a gzip member")
    fixed += source.take(1, "a member header")
    if fixed[2] != DEFLATE:
        raise BadGzip(f"unknown compression method {fixed[2]}")
    fixed += source.take(1, "a member header")
    flags = fixed[3]
    if flags & RESERVED:
        raise BadGzip(f"reserved header flags are set: {flags:#04x}")
    fixed += source.take(6, "a member header")
    mtime = int.from_bytes(fixed[4:8], "little")
    if not flags:
        return flags, mtime, None, None, None
    size, crc, extra, texts = len(fixed), zlib.crc32(fixed), None, {FNAME: None, FCOMMENT: None}
    if flags & FEXTRA:
        length = source.take(2, "the extra field")
        extra = source.take(int.from_bytes(length, "little"), "the extra field")
        size, crc = size + 2 + len(extra), zlib.crc32(extra, zlib.crc32(length, crc))
    for flag in texts:
        if flags & flag:
            raw = source.take_text(MAX_HEADER - size, "a header text")
            size, crc = size + len(raw) + 1, zlib.crc32(b"\0", zlib.crc32(raw, crc))
            texts[flag] = raw.decode("latin-1")
    if flags & FHCRC:
        if int.from_bytes(source.take(2, "the header checksum"), "little") != crc & 0xFFFF:
            raise BadGzip("header checksum does not match")
        size += 2
    if size > MAX_HEADER:
        raise BadGzip("gzip header is too long")
    return flags, mtime, texts[FNAME], texts[FCOMMENT], extra


def scan(chunks: Iterable[bytes], report: Report, *, limit: int | None = None, chunk_size: int = CHUNK, collect: bool = True) -> Iterator[bytes]:
    """Validate a whole stream, yielding payload of at most ``chunk_size`` bytes at a time.

    ``report`` grows as parts are validated. Payload is delivered before its
    trailer is checked; only a scan that ends without an exception has
    validated the stream. Beyond ``limit`` bytes exactly ``limit`` are
    delivered, then LimitExceeded is raised."""
    check_positive(limit, "max_decompressed_size")
    check_chunk_size(chunk_size)
    source = _Source(chunks, report)
    while source.at_member(report.member_count > 0):
        start = source.offset
        flags, mtime, name, comment, extra = _header(source)
        report.mtime = mtime
        inflate, crc, total, feed = zlib.decompressobj(-zlib.MAX_WBITS), 0, 0, LEAST_FEED
        while not inflate.eof:
            if source.at == len(source.data) and not source.more():
                raise BadGzip("stream ended in member data")
            room = chunk_size if limit is None else min(chunk_size, limit - report.uncompressed_size + 1)
            # what the decoder leaves of a feed is copied, so feeds are small at first and no larger than their output
            piece = source.data[source.at : source.at + max(LEAST_FEED, min(feed, room))]
            feed = min(4 * feed, MOST_FEED)
            try:
                out = inflate.decompress(piece, room)
            except zlib.error as e:
                raise BadGzip(f"member data is corrupt: {e}") from None
            source.at += len(piece) - len(inflate.unused_data if inflate.eof else inflate.unconsumed_tail)
            if not out:
                continue
            if limit is not None and report.uncompressed_size + len(out) > limit:
                out = out[: limit - report.uncompressed_size]
                report.uncompressed_size += len(out)
                if out:
                    yield out
                raise LimitExceeded(f"decompressed output exceeded {limit} bytes")
            crc, total = zlib.crc32(out, crc), total + len(out)
            report.uncompressed_size += len(out)
            yield out
        want, isize = struct.unpack("<II", source.take(8, "a member trailer"))
        if want != crc:
            raise BadGzip(f"CRC-32 does not match: stored {want:#010x}, computed {crc:#010x}")
        if isize != total & UINT32:
            raise BadGzip("stored size does not match")
        if collect:
            report.members.append(Member(report.member_count, start, source.offset - start, total, mtime, name, comment, extra, flags, crc, isize))
        report.member_count += 1
    report.finished = True


def pieces(data: bytes | memoryview, n: int = CHUNK) -> Iterator[bytes]:
    return (bytes(data[i : i + n]) for i in range(0, len(data), n))


def inspect(data: bytes, limit: int | None = None) -> Report:
    report = Report()
    for _ in scan(pieces(data), report, limit=limit):
        pass
    return report


def decompress(data: bytes, limit: int | None = None) -> bytes:
    return b"".join(scan(pieces(data), Report(), limit=limit, collect=False))


def member_header(filename: bytes, mtime: int | None, level: int) -> bytes:
    xfl = {9: 2, 1: 4}.get(level, 0)
    seconds = int(time.time()) if mtime is None else mtime
    return MAGIC + struct.pack("<BBIBB", DEFLATE, FNAME if filename else 0, seconds, xfl, OS_UNKNOWN) + (filename + b"\0" if filename else b"")


def encode(chunks: Iterable[bytes], *, level: int = LEVEL, mtime: float | None = None, original_filename: str | bytes | None = None, path: str | None = None, strict_size: bool = False, flush_every: int | None = None) -> Iterator[bytes]:
    """Exactly one member from ``chunks``, the header first; ``flush_every`` chunks end in a sync flush."""
    check_level(level)
    seconds, name = check_mtime(mtime), header_filename(original_filename, path)
    check_positive(flush_every, "flush_every")
    return _encode(chunks, level, seconds, name, strict_size, flush_every)


class MemberEncoder:
    """One member as it grows: ``begin()``, ``feed(data)`` for each piece, ``finish()``; its sizes and checksum so far."""

    def __init__(self, level: int = LEVEL, mtime: int | None = None, filename: bytes = b"", strict_size: bool = False, flush_every: int | None = None):
        self.level, self.mtime, self.filename, self.strict_size, self.flush_every = level, mtime, filename, strict_size, flush_every
        self.crc32 = self.uncompressed_size = self.compressed_size = self.fed = 0
        self._deflate = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)

    def _out(self, data: bytes) -> bytes:
        self.compressed_size += len(data)
        return data

    def begin(self) -> bytes:
        return self._out(member_header(self.filename, self.mtime, self.level))

    def feed(self, data: bytes) -> bytes:
        if self.strict_size and self.uncompressed_size + len(data) > UINT32:
            raise SizeOverflow("member input is larger than its size field can hold")
        self.crc32, self.uncompressed_size, self.fed = zlib.crc32(data, self.crc32), self.uncompressed_size + len(data), self.fed + 1
        out = self._deflate.compress(data)
        if self.flush_every and self.fed % self.flush_every == 0:
            out += self._deflate.flush(zlib.Z_SYNC_FLUSH)
        return self._out(out)

    def finish(self) -> bytes:
        return self._out(self._deflate.flush() + struct.pack("<II", self.crc32, self.uncompressed_size & UINT32))


def _encode(chunks, level, seconds, name, strict_size, flush_every):
    member = MemberEncoder(level, seconds, name, strict_size, flush_every)
    yield member.begin()
    for chunk in chunks:
        if out := member.feed(chunk):
            yield out
    yield member.finish()


def compress(data: bytes, **options) -> bytes:
    return b"".join(encode([data] if data else [], **options))


def engine_info() -> dict[str, str]:
    """Names of the engines in use, and the version of the library."""
    return {"compression": "zlib", "decompression": "zlib", "crc32": "zlib", "version": zlib.ZLIB_RUNTIME_VERSION}
