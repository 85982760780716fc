"""Table functions for SQL: gz_members, gz_chunks and gz_lines, to be used with LATERAL over a binary column."""

from __future__ import annotations

import io

from pyspark.sql.functions import udtf

from gzframe import kernel


@udtf(returnType="index int, compressed_offset bigint, compressed_size bigint, uncompressed_size bigint, mtime bigint, original_filename string, comment string, extra binary, flags int, crc32 bigint, trailer_isize bigint")
class Members:
    def eval(self, content: bytes):
        if content is not None:
            for m in kernel.inspect(content).members:
                yield tuple(vars(m).values())


@udtf(returnType="seq int, byte_offset bigint, data binary")
class Chunks:
    def eval(self, content: bytes, size: int):
        if content is not None:
            for k, (at, data) in enumerate(even_chunks(kernel.pieces(content), size)):
                yield k, at, data


@udtf(returnType="line_no bigint, line string")
class Lines:
    def eval(self, content: bytes, newline: str):
        if content is not None:
            # lines are taken from the whole decoded stream: members may end anywhere
            text = io.TextIOWrapper(io.BytesIO(kernel.decompress(content)), encoding="utf-8", newline=newline)
            for n, line in enumerate(text):
                yield n, line


def even_chunks(source, size: int, limit: int | None = None, report: kernel.Report | None = None):
    """(offset, bytes) of exactly ``size`` bytes each, the last one shorter."""
    kernel.check_chunk_size(size)
    held, at = bytearray(), 0
    for part in kernel.scan(source, report or kernel.Report(), limit=limit, chunk_size=size, collect=False):
        if not held and len(part) == size:
            yield at, part
            at += size
            continue
        held += part
        if len(held) >= size:  # a part is no longer than a chunk
            yield at, bytes(held[:size])
            at += size
            del held[:size]
    if held:
        yield at, bytes(held)


def register_tables(spark) -> None:
    for name, f in (("gz_members", Members), ("gz_chunks", Chunks), ("gz_lines", Lines)):
        spark.udtf.register(name, f)
