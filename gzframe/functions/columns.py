"""Column functions: Arrow-batched codec functions and native expressions.

Native expressions (ranges, newlines, checksums, names) stay in the JVM."""

from __future__ import annotations

import codecs
import warnings
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gzframe import kernel

MEMBER = (
    "struct<index:int,compressed_offset:bigint,compressed_size:bigint,uncompressed_size:bigint,mtime:bigint,original_filename:string,"
    "comment:string,extra:binary,flags:int,crc32:bigint,trailer_isize:bigint>"
)
VERIFIED = "struct<member_count:int,compressed_size:bigint,uncompressed_size:bigint,error_class:string,error_message:string>"
INSPECTED = f"struct<members:array<{MEMBER}>,member_count:int,compressed_size:bigint,uncompressed_size:bigint,error_class:string,error_message:string>"
RECOVERED = "struct<payload_prefix:binary,member_count:int,error_class:string,error_message:string>"
#: Decompressed bytes a codec function gives at most when it is not told otherwise.
DEFAULT_LIMIT = 2**31 - 2**20

ARROW_MEMBER = pa.struct(
    [("index", pa.int32()), ("compressed_offset", pa.int64()), ("compressed_size", pa.int64()), ("uncompressed_size", pa.int64()), ("mtime", pa.int64()), ("original_filename", pa.string())]
    + [("comment", pa.string()), ("extra", pa.binary()), ("flags", pa.int32()), ("crc32", pa.int64()), ("trailer_isize", pa.int64())]
)


def scanned(data: bytes | Iterable[bytes], limit: int | None, mode: str, collect: bool, keep: bool = False):
    """(report, payload, error) of one value, or of the pieces of one; FAILFAST raises, PERMISSIVE returns the error."""
    report, out, error = kernel.Report(), [], None
    try:
        for part in kernel.scan(kernel.pieces(data) if isinstance(data, bytes) else data, report, limit=limit, collect=collect):
            if keep:
                out.append(part)
    except kernel.GzipStreamError as e:
        if mode != "PERMISSIVE":
            raise
        error = e
    return report, b"".join(out), error


def check_mode(mode: str) -> str:
    if mode.upper() not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode must be FAILFAST or PERMISSIVE")
    return mode.upper()


def gz_compress(content: Column | str, *, level: int = kernel.LEVEL, mtime: Column | float | None = None, original_filename: Column | str | None = None, strict_size: bool = False, fast_compress: bool = False) -> Column:
    """One gzip member per value (null stays null). ``mtime`` and ``original_filename`` may be columns."""
    kernel.check_level(level)
    if fast_compress:
        warnings.warn("no faster engine is installed; zlib is used", stacklevel=2)
    if not isinstance(mtime, Column):
        kernel.check_mtime(mtime)
    if not isinstance(original_filename, Column):
        kernel.header_filename(original_filename)

    @arrow_udf("binary")
    def run(data: pa.Array, when: pa.Array, name: pa.Array) -> pa.Array:
        rows = zip(data.to_pylist(), when.to_pylist(), name.to_pylist(), strict=True)
        return pa.array([None if d is None else kernel.compress(d, level=level, mtime=t, original_filename=n, strict_size=strict_size) for d, t, n in rows], pa.binary())

    c = F.col(content) if isinstance(content, str) else content
    when = mtime if isinstance(mtime, Column) else F.lit(mtime)
    name = original_filename if isinstance(original_filename, Column) else F.lit(original_filename)
    return run(c.cast("binary"), when.cast("double"), name.cast("string"))


def _codec(kind: str, value, arrow: pa.DataType):
    def make(content: Column | str, limit: int | None, mode: str) -> Column:
        kernel.check_positive(limit, "max_decompressed_size")
        mode = check_mode(mode)

        @arrow_udf(kind)
        def run(data: pa.Array) -> pa.Array:
            return pa.array([None if d is None else value(d, limit, mode) for d in data.to_pylist()], arrow)

        return run(content)

    return make


def _error(e):
    return {"error_class": e.error_class if e else None, "error_message": str(e) if e else None}


def verified(d: bytes | Iterable[bytes], limit: int | None, mode: str) -> dict:
    """``VERIFIED`` of one value, or of the pieces of one."""
    r, _, e = scanned(d, limit, mode, False)
    return {"member_count": r.member_count, "compressed_size": r.compressed_size, "uncompressed_size": r.uncompressed_size} | _error(e)


def _inspect(d, limit, mode):
    r, _, e = scanned(d, limit, mode, True)
    return {"members": [vars(m) for m in r.members], "member_count": r.member_count, "compressed_size": r.compressed_size, "uncompressed_size": r.uncompressed_size} | _error(e)


def _recover(d, limit, mode):
    r, payload, e = scanned(d, limit, "PERMISSIVE", False, True)
    return {"payload_prefix": payload, "member_count": r.member_count} | _error(e)


_ERR = [("error_class", pa.string()), ("error_message", pa.string())]
_SIZES = [("member_count", pa.int32()), ("compressed_size", pa.int64()), ("uncompressed_size", pa.int64())]
ARROW_VERIFIED = _SIZES + _ERR
_as_payload = _codec("binary", lambda d, limit, mode: (lambda x: None if x[2] else x[1])(scanned(d, limit, mode, False, True)), pa.binary())
_as_verified = _codec(VERIFIED, verified, pa.struct(ARROW_VERIFIED))
_as_inspected = _codec(INSPECTED, _inspect, pa.struct([("members", pa.list_(ARROW_MEMBER)), *_SIZES, *_ERR]))
_as_recovered = _codec(RECOVERED, _recover, pa.struct([("payload_prefix", pa.binary()), ("member_count", pa.int32()), *_ERR]))


def gz_decompress(content, *, max_decompressed_size: int | None = DEFAULT_LIMIT, mode: str = "FAILFAST") -> Column:
    """The whole validated payload; in PERMISSIVE mode null where the stream is not valid."""
    return _as_payload(content, max_decompressed_size, mode)


def gz_verify(content, *, max_decompressed_size: int | None = None, mode: str = "FAILFAST") -> Column:
    """member_count, compressed_size, uncompressed_size, error_class, error_message; no member is kept."""
    return _as_verified(content, max_decompressed_size, mode)


def gz_inspect(content, *, max_decompressed_size: int | None = None, mode: str = "FAILFAST") -> Column:
    """``gz_verify`` with all validated members."""
    return _as_inspected(content, max_decompressed_size, mode)


def gz_recover(content, *, max_decompressed_size: int | None = DEFAULT_LIMIT) -> Column:
    """Decoded bytes before a failure (all bytes when there is none). They are not verified data."""
    return _as_recovered(content, max_decompressed_size, "PERMISSIVE")


# --- native expressions -----------------------------------------------------


def byte_range(payload: Column | str, start: int, size: int = -1) -> Column:
    """``size`` bytes (negative: all) from position ``start``, as seek and read give them."""
    c = F.col(payload) if isinstance(payload, str) else payload
    if start < 0:
        raise ValueError("start must not be negative")
    return F.substring(c, F.lit(start + 1), F.octet_length(c) if size < 0 else F.lit(size))


def seek_position(payload: Column | str, offset: int, whence: int = 0, at: Column | int = 0) -> Column:
    """Position after seek: 0 from the start (stops at the end), 1 from ``at``, 2 from the end (clamped to 0..length)."""
    c = F.col(payload) if isinstance(payload, str) else payload
    n = F.octet_length(c)
    if whence == 0:
        if offset < 0:
            raise OSError("negative seek position")
        return F.least(F.lit(offset), n)
    base = F.lit(at) if isinstance(at, int) else at
    if whence == 1:
        to = base + F.lit(offset)
        return F.when(to < 0, F.raise_error(F.lit("negative seek position"))).otherwise(F.least(to, n))
    if whence == 2:
        return F.greatest(F.lit(0), F.least(n + F.lit(offset), n))
    raise ValueError("whence must be 0, 1 or 2")


def read_from(payload: Column | str, position: Column, size: int = -1) -> Column:
    c = F.col(payload) if isinstance(payload, str) else payload
    return F.substring(c, position + 1, F.octet_length(c) if size < 0 else F.lit(size))


def peek(payload: Column | str, size: int) -> Column:
    return byte_range(payload, 0, kernel.check_chunk_size(size))


def read_text(text: Column | str, start: int = 0, size: int = -1) -> Column:
    """``size`` characters from character ``start``."""
    c = F.col(text) if isinstance(text, str) else text
    return F.substring(c, F.lit(start + 1), F.length(c) if size < 0 else F.lit(size))


def zero_fill(payload: Column | str, position: int) -> Column:
    """A forward seek while writing: zero bytes up to ``position``."""
    c = F.col(payload) if isinstance(payload, str) else payload
    missing = F.greatest(F.lit(position) - F.octet_length(c), F.lit(0))
    return F.concat(c, F.unhex(F.repeat(F.lit("00"), missing.cast("int"))))


def append_member(stream: Column | str, member: Column | str) -> Column:
    """Append mode: a new member after the existing stream."""
    return F.concat(stream, member)


def embedded_name(path: Column | str) -> Column:
    """The filename a writer puts in the header: base name without ``.gz``, null when it is not Latin-1."""
    c = F.col(path) if isinstance(path, str) else path
    name = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.gz$", "")
    return F.when(name.rlike(r"^[\x00-\xff]*$"), name)


def normalized_mtime(value: Column | str) -> Column:
    """A header mtime from a number: truncated, null outside 0..2^32-1."""
    c = F.col(value) if isinstance(value, str) else value
    seconds = F.floor(c).cast("long")
    return F.when((c >= 0) & (seconds <= kernel.UINT32), seconds)


def decode_text(payload: Column | str, encoding: str = "utf-8", errors: str = "strict") -> Column:
    """Bytes to text. UTF-8 and Latin-1 stay in the JVM; other encodings and policies run as an Arrow function."""
    c = F.col(payload) if isinstance(payload, str) else payload
    plain = encoding.lower().replace("_", "-")
    if plain in ("utf-8", "utf8") and errors == "strict":
        text = c.cast("string")
        return F.when(F.is_valid_utf8(text), text).otherwise(F.when(c.isNotNull(), F.raise_error(F.lit("DECODE: invalid UTF-8"))))
    if plain in ("iso-8859-1", "latin-1", "latin1"):
        return F.decode(c, "ISO-8859-1")
    codecs.lookup(encoding)

    @arrow_udf("string")
    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if d is None else d.decode(encoding, errors) for d in data.to_pylist()], pa.string())

    return run(c)


def encode_text(text: Column | str, encoding: str = "utf-8", errors: str = "strict", newline: str | None = "\n") -> Column:
    """Text to bytes after newline translation on write (None: as ``\\n`` on this platform; '': none)."""
    c = translate_on_write(text, newline)
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        return c.cast("binary")
    codecs.lookup(encoding)

    @arrow_udf("binary")
    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if d is None else d.encode(encoding, errors) for d in data.to_pylist()], pa.binary())

    return run(c)


def register(spark) -> None:
    """Register the codec functions for SQL: gz_compress(b), gz_decompress(b), gz_verify(b), gz_inspect(b) and table functions."""
    from gzframe.functions.table import register_tables

    @arrow_udf("binary")
    def compress(data: pa.Array) -> pa.Array:
        return pa.array([None if d is None else kernel.compress(d if isinstance(d, bytes) else d.encode()) for d in data.to_pylist()], pa.binary())

    @arrow_udf("binary")
    def decompress(data: pa.Array) -> pa.Array:
        return pa.array([None if d is None else kernel.decompress(d, DEFAULT_LIMIT) for d in data.to_pylist()], pa.binary())

    @arrow_udf(VERIFIED)
    def verify(data: pa.Array) -> pa.Array:
        return pa.array([None if d is None else verified(d, None, "PERMISSIVE") for d in data.to_pylist()], pa.struct(ARROW_VERIFIED))

    @arrow_udf(INSPECTED)
    def inspect(data: pa.Array) -> pa.Array:
        return pa.array([None if d is None else _inspect(d, None, "PERMISSIVE") for d in data.to_pylist()], pa.struct([("members", pa.list_(ARROW_MEMBER)), *_SIZES, *_ERR]))

    for name, f in (("gz_compress", compress), ("gz_decompress", decompress), ("gz_verify", verify), ("gz_inspect", inspect)):
        spark.udf.register(name, f)
    register_tables(spark)


# --- newlines ---------------------------------------------------------------

# Line patterns by newline mode (Java regular expressions).
LINE_PATTERNS = {
    None: r"[^\n]*\n|[^\n]+\z",
    "": r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\z",
    "\n": r"[^\n]*\n|[^\n]+\z",
    "\r": r"[^\r]*\r|[^\r]+\z",
    "\r\n": r"(?s)(?:(?!\r\n).)*\r\n|(?:(?!\r\n).)+\z",
}


def check_newline(newline: str | None) -> str | None:
    if newline not in LINE_PATTERNS:
        raise ValueError(f"illegal newline value: {newline!r}")
    return newline


def translate_on_read(text: Column | str, newline: str | None = None) -> Column:
    """Universal newlines (None) turn CRLF and CR into LF; other modes leave text as it is."""
    c = F.col(text) if isinstance(text, str) else text
    if check_newline(newline) is not None:
        return c
    # most texts have no CR: the test is cheaper than the pattern
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n|\r", "\n")).otherwise(c)


def translate_on_write(text: Column | str, newline: str | None = None) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    to = "\n" if check_newline(newline) is None else newline
    return c if to in ("", "\n") else F.replace(c, F.lit("\n"), F.lit(to))


def split_lines(text: Column | str, newline: str | None = None) -> Column:
    """All lines with their terminators, as an array."""
    return F.regexp_extract_all(translate_on_read(text, newline), F.lit(LINE_PATTERNS[newline]), 0)


def split_binary_lines(payload: Column | str) -> Column:
    """Lines of bytes, ending at LF only."""
    c = F.col(payload) if isinstance(payload, str) else payload
    lines = F.regexp_extract_all(F.decode(c, "ISO-8859-1"), F.lit(LINE_PATTERNS["\n"]), 0)
    return F.transform(lines, lambda x: F.encode(x, "ISO-8859-1"))


def limited_lines(text: Column | str, limit: int, newline: str | None = None) -> Column:
    """What repeated ``readline(limit)`` calls return: each reads on from where the last one stopped, even between CR and LF."""
    if limit < 0:
        return split_lines(text, newline)
    if limit == 0:
        check_newline(newline)
        return F.array().cast("array<string>")
    plain = f"[^\\n]{{0,{limit - 1}}}\\n"
    pair = rf"(?:(?!\r\n).){{0,{limit - 2}}}\r\n" if limit > 1 else None
    # a line end within the limit, else as many characters as the limit allows
    ends = {None: [plain], "\n": [plain], "\r": [rf"[^\r]{{0,{limit - 1}}}\r"], "\r\n": [pair], "": [rf"[^\r\n]{{0,{limit - 2}}}\r\n" if limit > 1 else None, rf"[^\r\n]{{0,{limit - 1}}}[\r\n]"]}[check_newline(newline)]
    pattern = "|".join([*(e for e in ends if e), f".{{1,{limit}}}"])
    return F.regexp_extract_all(translate_on_read(text, newline), F.lit(f"(?s){pattern}"), 0)


def newline_kinds(text: Column | str) -> Column:
    """struct<has_lf, has_cr, has_crlf>: the terminators that occur."""
    c = F.col(text) if isinstance(text, str) else text
    return F.struct(c.rlike(r"(?<!\r)\n").alias("has_lf"), c.rlike(r"\r(?!\n)").alias("has_cr"), F.contains(c, F.lit("\r\n")).alias("has_crlf"))


def seen_newlines(text: Column | str) -> Column:
    """The terminators seen, as an array in the order CR, LF, CRLF; null when there is none."""
    k = newline_kinds(text)
    found = F.filter(F.array(F.when(k.has_cr, F.lit("\r")), F.when(k.has_lf, F.lit("\n")), F.when(k.has_crlf, F.lit("\r\n"))), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)
