"""Relations over gzip files of a mounted path, read in bounded pieces.

A task gets paths and opens the files itself: nothing holds a file, its payload
or more of its lines than a batch. A file can be larger than a value."""

from __future__ import annotations

import codecs
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gzframe import kernel
from gzframe.functions import columns as C
from gzframe.sources.shared import file_pieces, local_path

#: A batch of lines closes with the line that reaches either.
BATCH_LINES, BATCH_CHARACTERS = 10_000, 2**21


class _Payload(io.RawIOBase):
    """The parts of a scan as a file to read."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.left = parts, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        if not self.left:  # a part is never empty
            self.left = memoryview(next(self.parts, b""))
        n = min(len(buffer), len(self.left))
        buffer[:n], self.left = self.left[:n], self.left[n:]
        return n


def _scan(path: str, limit: int | None) -> Iterator[bytes]:
    return kernel.scan(file_pieces(local_path(path)), kernel.Report(), limit=limit, collect=False)


def _text(path: str, newline: str | None, encoding: str, errors: str, limit: int | None) -> io.TextIOWrapper:
    return io.TextIOWrapper(io.BufferedReader(_Payload(_scan(path, limit)), kernel.CHUNK), encoding, errors, newline)


def _paths(batches) -> Iterator[str]:
    return (path for batch in batches for path in batch.column(0).to_pylist())


def line_batches(path: str, newline: str | None, encoding: str, errors: str, limit: int | None, mode: str) -> Iterator[pa.RecordBatch]:
    """Batches (path, line_no, line) of one file, which is validated by a pass of its own before it gives any."""
    if C.scanned(file_pieces(local_path(path)), limit, mode, False)[2]:
        return

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(range(n, n + len(held)), pa.int64()), pa.array(held, pa.string())], ["path", "line_no", "line"])

    n, held, size = 0, [], 0
    try:
        for line in _text(path, newline, encoding, errors, limit):
            held.append(line)
            size += len(line)
            if size >= BATCH_CHARACTERS or len(held) == BATCH_LINES:
                yield out()
                n, held, size = n + len(held), [], 0
    except UnicodeDecodeError as e:
        raise ValueError(f"DECODE: {e}") from None
    if held:
        yield out()


def lines(df: DataFrame, newline: str | None = None, encoding: str = "utf-8", errors: str = "strict", *, max_decompressed_size: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    """``path``, line_no, line of the files that ``df`` names in ``path``, terminators kept, as the text layer has them."""
    C.check_newline(newline)
    codecs.lookup(encoding)
    kernel.check_positive(max_decompressed_size, "max_decompressed_size")
    mode = C.check_mode(mode)

    def run(batches):
        for path in _paths(batches):
            yield from line_batches(path, newline, encoding, errors, max_decompressed_size, mode)

    return df.select("path").mapInArrow(run, "path string, line_no bigint, line string")


def streams(df: DataFrame, *, max_decompressed_size: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    """``relations.streams`` of the files that ``df`` names in ``path``."""
    kernel.check_positive(max_decompressed_size, "max_decompressed_size")
    mode = C.check_mode(mode)

    def run(batches):
        for path in _paths(batches):
            found = C.verified(file_pieces(local_path(path)), max_decompressed_size, mode)
            yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.array([found[name]], kind) for name, kind in C.ARROW_VERIFIED)], ["path", *found])

    return df.select("path").mapInArrow(run, f"path string, {C.VERIFIED.removeprefix('struct<').removesuffix('>').replace(':', ' ')}")


def digest(path: str, text: tuple[str | None, str, str] | None, limit: int | None, mode: str) -> str | None:
    """MD5 of one file's payload or, with ``text`` (newline, encoding, errors), of its text in UTF-8; null in PERMISSIVE mode where the stream is not valid."""
    found = hashlib.md5(usedforsecurity=False)
    try:
        if text:
            f = _text(path, *text, limit)
            for part in iter(lambda: f.read(kernel.CHUNK), ""):
                found.update(part.encode())
        else:
            for part in _scan(path, limit):
                found.update(part)
    except UnicodeDecodeError as e:
        raise ValueError(f"DECODE: {e}") from None
    except kernel.GzipStreamError:
        if mode != "PERMISSIVE":
            raise
        return None
    return found.hexdigest()


def digests(df: DataFrame, text: tuple[str | None, str, str] | None = None, *, max_decompressed_size: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    """``path``, digest of the files that ``df`` names in ``path``, as ``digest`` has it."""
    if text:
        C.check_newline(text[0])
        codecs.lookup(text[1])
    kernel.check_positive(max_decompressed_size, "max_decompressed_size")
    mode = C.check_mode(mode)

    def run(batches):
        for path in _paths(batches):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest(path, text, max_decompressed_size, mode)], pa.string())], ["path", "digest"])

    return df.select("path").mapInArrow(run, "path string, digest string")
