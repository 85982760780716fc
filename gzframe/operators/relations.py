"""Relations over binary columns: streams, members, chunks, lines, batches, and ordered streams of chunks.

Each keeps the named columns of its input. Narrow relations only: nothing here
shuffles, but for ``decode_chunks`` and ``encode_chunks``, whose input is one
stream in many rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gzframe import kernel
from gzframe.functions import columns as C
from gzframe.functions.table import even_chunks


def _schema(df: DataFrame, keep: Sequence[str], more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), more])


def streams(df: DataFrame, keep: Sequence[str], content: str = "content", *, max_decompressed_size: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    """One row per stream: ``keep``, member_count, compressed_size, uncompressed_size, error_class, error_message."""
    return df.select(*keep, C.gz_verify(content, max_decompressed_size=max_decompressed_size, mode=mode).alias("_v")).select(*keep, "_v.*")


def members(df: DataFrame, keep: Sequence[str], content: str = "content", *, max_decompressed_size: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    """One row per validated member; in PERMISSIVE mode those before a failure."""
    found = C.gz_inspect(content, max_decompressed_size=max_decompressed_size, mode=mode)
    return df.select(*keep, F.explode(found.members).alias("_m")).select(*keep, "_m.*")


def last_mtime(members_df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The mtime of each stream's last member."""
    return members_df.groupBy(*by).agg(F.max_by("mtime", "index").alias("mtime"))


def chunks(df: DataFrame, keep: Sequence[str], content: str = "content", *, size: int = kernel.CHUNK, max_decompressed_size: int | None = None) -> DataFrame:
    """One row per ``size`` bytes of payload (the last may be shorter): ``keep``, seq, byte_offset, data.

    Rows leave the task as they are decoded; a whole payload is never held."""
    kernel.check_chunk_size(size)
    kernel.check_positive(max_decompressed_size, "max_decompressed_size")
    per_batch = max(1, 8 * 2**20 // size)

    def run(batches):
        for batch in batches:
            fixed, data = batch.columns[:-1], batch.column(batch.num_columns - 1)
            for i, blob in enumerate(data.to_pylist()):
                if blob is None:
                    continue
                row = [c.slice(i, 1) for c in fixed]
                held: list[tuple[int, int, bytes]] = []

                def out(row=row):
                    same = [c.take(pa.array([0] * len(held))) for c in row]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*same, *(pa.array([h[k] for h in held], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary())))], [*keep, "seq", "byte_offset", "data"])  # noqa: B023

                for n, (at, part) in enumerate(even_chunks(kernel.pieces(blob), size, max_decompressed_size)):
                    held.append((n, at, part))
                    if len(held) == per_batch:
                        yield out()
                        held = []
                if held:
                    yield out()

    return df.select(*keep, F.col(content).alias("_content")).mapInArrow(run, _schema(df, keep, "seq int, byte_offset bigint, data binary"))


def lines(df: DataFrame, keep: Sequence[str], text: Column | str, newline: str | None = None) -> DataFrame:
    """One row per line of a text column, terminators kept: ``keep``, line_no, line. All in the JVM."""
    return df.select(*keep, F.posexplode(C.split_lines(text, newline)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def gz_lines(df: DataFrame, keep: Sequence[str], content: str = "content", *, newline: str | None = None, encoding: str = "utf-8", errors: str = "strict", max_decompressed_size: int | None = C.DEFAULT_LIMIT) -> DataFrame:
    """Lines of gzip streams, decoded as whole streams: members may end inside a character or line."""
    payload = C.gz_decompress(content, max_decompressed_size=max_decompressed_size)
    plain = df.select(*keep, payload.alias("_p")).select(*keep, C.decode_text("_p", encoding, errors).alias("_t"))
    return lines(plain, keep, "_t", newline)


def with_offsets(lines_df: DataFrame, by: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """``lines`` with byte_offset and char_offset of each line in its stream."""
    w = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda size: F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long")
    size = F.octet_length("line") if encoding.upper() == "UTF-8" else F.octet_length(F.encode("line", encoding))
    return lines_df.withColumns({"byte_offset": before(size), "char_offset": before(F.length("line"))})


def lines_from(offset_lines: DataFrame, position: int) -> DataFrame:
    """Lines that start at or after a byte position."""
    return offset_lines.where(F.col("byte_offset") >= position)


def batches(df: DataFrame, keep: Sequence[str], text: Column | str, hint: int = 2**20, newline: str | None = None) -> DataFrame:
    """``keep``, batch, lines: whole lines, a batch closing with the line that reaches ``hint`` characters."""
    kernel.check_positive(hint, "hint")

    def run(rows):
        for batch in rows:
            fixed, column = batch.columns[:-1], batch.column(batch.num_columns - 1)
            for i, all_lines in enumerate(column.to_pylist()):
                groups, size = [[]], 0
                for line in all_lines or []:
                    if size >= hint:
                        groups.append([])
                        size = 0
                    groups[-1].append(line)
                    size += len(line)
                if groups[-1]:
                    n = len(groups)
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, 1).take(pa.array([0] * n)) for c in fixed), pa.array(range(n), pa.int32()), pa.array(groups, pa.list_(pa.string()))], [*keep, "batch", "lines"])

    listed = df.select(*keep, C.split_lines(text, newline).alias("_lines"))
    return listed.mapInArrow(run, _schema(df, keep, "batch int, lines array<string>"))


def _key(table: pa.Table, by: Sequence[str]) -> list[pa.Array]:
    return [table[c].slice(0, 1).combine_chunks() for c in by]


def encode_chunks(df: DataFrame, by: Sequence[str], order: str, data: str, **options) -> DataFrame:
    """One member per group from its ordered chunks: ``by``, content. An option may not be a column here."""
    for _ in kernel.encode([], **options):
        break

    def run(table: pa.Table) -> pa.Table:
        parts = (x for x in table.sort_by(order)[data].to_pylist() if x)
        return pa.Table.from_arrays([*_key(table, by), pa.array([b"".join(kernel.encode(parts, **options))], pa.binary())], [*by, "content"])

    typed = df.select(*by, order, F.col(data).cast("binary").alias(data))
    return typed.groupBy(*by).applyInArrow(run, _schema(df, by, "content binary"))


def decode_chunks(df: DataFrame, by: Sequence[str], order: str, data: str, *, size: int = kernel.CHUNK, max_decompressed_size: int | None = None) -> DataFrame:
    """Decode streams that arrive as ordered chunks cut anywhere: ``by``, seq, byte_offset, data."""
    kernel.check_chunk_size(size)
    kernel.check_positive(max_decompressed_size, "max_decompressed_size")

    def run(table: pa.Table) -> pa.Table:
        parts = (x for x in table.sort_by(order)[data].to_pylist() if x)
        out = [(n, at, part) for n, (at, part) in enumerate(even_chunks(parts, size, max_decompressed_size))]
        key = [c.take(pa.array([0] * len(out), pa.int64())) for c in _key(table, by)]
        return pa.Table.from_arrays([*key, *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary())))], [*by, "seq", "byte_offset", "data"])

    return df.select(*by, order, data).groupBy(*by).applyInArrow(run, _schema(df, by, "seq int, byte_offset bigint, data binary"))


def concat_members(df: DataFrame, by: Sequence[str], order: str, content: str = "content") -> DataFrame:
    """Join members into one stream per group, in order: an ordered UNION ALL of payloads. A stream is a value, so it has less than 2 GB."""
    name = lambda c: f"`{c.replace('`', '``')}`"
    return df.groupBy(*by).agg(F.expr(f"coalesce(listagg({name(content)}) WITHIN GROUP (ORDER BY {name(order)}), X'')").alias("content"))


def against_manifest(streams_df: DataFrame, manifest: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(expected but missing, present but unexpected) streams."""
    return manifest.join(streams_df, list(on), "left_anti"), streams_df.join(manifest, list(on), "left_anti")
