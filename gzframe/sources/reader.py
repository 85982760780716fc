"""Reading gzip files as relations, and the ``gzstream`` data source.

``GzReader`` finds files through Spark's own ``binaryFile`` source, so any
Hadoop path works and file pruning is Spark's. Relations of ``mounted`` read
files of a mounted path in bounded pieces; all others, and other paths, have a
file in one row. Files too large for that are also read by the ``gzstream``
source in bounded pieces, member-parallel on request."""

from __future__ import annotations

import contextlib
import glob
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gzframe import kernel
from gzframe.functions import columns as C
from gzframe.functions.table import even_chunks
from gzframe.operators import relations as R
from gzframe.sources import mounted
from gzframe.sources.shared import file_pieces as _file_pieces
from gzframe.sources.shared import is_mounted, local_path


def parse_mode(mode: str) -> tuple[str, bool, bool]:
    """(operation r/w/a/x, text, plus) of an open mode; marks may stand in any order."""
    if not isinstance(mode, str) or not mode or len(set(mode)) != len(mode) or set(mode) - set("rwaxbt+"):
        raise ValueError(f"invalid mode: {mode!r}")
    operations = [c for c in mode if c in "rwax"]
    if len(operations) != 1 or {"b", "t"} <= set(mode):
        raise ValueError(f"invalid mode: {mode!r}")
    return operations[0], "t" in mode, "+" in mode


#: Save modes of Spark by open mode.
SAVE_MODES = {"w": "overwrite", "a": "append", "x": "errorifexists"}


class GzReader:
    """``GzReader(spark).option(newline="").load(path)`` and then ``streams()``, ``members()``, ``chunks()``, ``lines()``, ``batches()``, ``payload()``."""

    OPTIONS = {"encoding": "utf-8", "errors": "strict", "newline": None, "max_decompressed_size": None, "mode": "FAILFAST", "chunk_size": kernel.CHUNK, "hint": 2**20}

    def __init__(self, spark: SparkSession):
        self.spark, self.options, self.df, self.mounted = spark, dict(self.OPTIONS), None, False

    def option(self, **options) -> GzReader:
        if unknown := set(options) - set(self.OPTIONS):
            raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
        self.options |= options
        C.check_newline(self.options["newline"])
        C.check_mode(self.options["mode"])
        kernel.check_chunk_size(self.options["chunk_size"])
        kernel.check_positive(self.options["max_decompressed_size"], "max_decompressed_size")
        kernel.check_positive(self.options["hint"], "hint")
        return self

    def load(self, path: str | list[str]) -> GzReader:
        """A file, folder, glob or list of them, on any file system that Spark reads."""
        self.df = self.spark.read.format("binaryFile").load(path)
        self.mounted = is_mounted(self.spark, path)
        return self

    def files(self) -> DataFrame:
        """path, length, modificationTime: the content is not read."""
        return self.df.drop("content")

    def streams(self) -> DataFrame:
        if self.mounted:
            return mounted.streams(self.df, max_decompressed_size=self.options["max_decompressed_size"], mode=self.options["mode"])
        return R.streams(self.df, ["path"], max_decompressed_size=self.options["max_decompressed_size"], mode=self.options["mode"])

    verify = streams

    def members(self) -> DataFrame:
        return R.members(self.df, ["path"], max_decompressed_size=self.options["max_decompressed_size"], mode=self.options["mode"])

    inspect = members

    def chunks(self) -> DataFrame:
        return R.chunks(self.df, ["path"], size=self.options["chunk_size"], max_decompressed_size=self.options["max_decompressed_size"])

    def payload(self) -> DataFrame:
        limit = self.options["max_decompressed_size"] or C.DEFAULT_LIMIT
        return self.df.select("path", C.gz_decompress("content", max_decompressed_size=limit, mode=self.options["mode"]).alias("payload"))

    def digests(self) -> DataFrame:
        """path, digest: the MD5 of each whole payload, as ``md5(payload)`` gives it for a payload that fits in a row."""
        if self.mounted:
            return mounted.digests(self.df, max_decompressed_size=self.options["max_decompressed_size"], mode=self.options["mode"])
        return self.payload().select("path", F.md5("payload").alias("digest"))

    def recovered(self) -> DataFrame:
        """Bytes decoded before a failure, as recovery data that nothing has verified."""
        limit = self.options["max_decompressed_size"] or C.DEFAULT_LIMIT
        return self.df.select("path", C.gz_recover("content", max_decompressed_size=limit).alias("r")).select("path", "r.*")

    def text(self) -> DataFrame:
        return self.payload().select("path", C.translate_on_read(C.decode_text("payload", self.options["encoding"], self.options["errors"]), self.options["newline"]).alias("text"))

    def text_digests(self) -> DataFrame:
        """path, digest: the MD5 of each whole text in UTF-8, as ``md5(text)`` gives it for a text that fits in a row."""
        if self.mounted:
            text = self.options["newline"], self.options["encoding"], self.options["errors"]
            return mounted.digests(self.df, text, max_decompressed_size=self.options["max_decompressed_size"], mode=self.options["mode"])
        return self.text().select("path", F.md5("text").alias("digest"))

    def lines(self) -> DataFrame:
        if self.mounted:
            return mounted.lines(self.df, self.options["newline"], self.options["encoding"], self.options["errors"], max_decompressed_size=self.options["max_decompressed_size"], mode=self.options["mode"])
        plain = self.payload().select("path", C.decode_text("payload", self.options["encoding"], self.options["errors"]).alias("_t"))
        return R.lines(plain, ["path"], "_t", self.options["newline"])

    def batches(self) -> DataFrame:
        return R.batches(self.text(), ["path"], "text", self.options["hint"], "\n" if self.options["newline"] is None else self.options["newline"])

    # Fast paths: Spark's own readers decode gzip in the JVM, without the strict checks.

    def fast_lines(self, path: str) -> DataFrame:
        """LF or CRLF lines without terminators, as Spark's text reader gives them; no padding, no header reasons."""
        return self.spark.read.text(path).withColumnRenamed("value", "line")

    def json(self, path: str, schema: str | None = None) -> DataFrame:
        return (self.spark.read.schema(schema) if schema else self.spark.read).json(path)

    def csv(self, path: str, schema: str | None = None, **options) -> DataFrame:
        return (self.spark.read.schema(schema) if schema else self.spark.read).options(**options).csv(path)


def read(spark: SparkSession, filename: str | list[str], mode: str = "rb", **options) -> DataFrame:
    """``open`` for reading: payloads in binary mode, lines in text mode."""
    operation, text, _ = parse_mode(mode)
    if operation != "r":
        raise ValueError("use write() for modes w, a and x")
    if not text and {"encoding", "errors", "newline"} & set(options):
        raise ValueError("encoding, errors and newline need text mode")
    reader = GzReader(spark).option(**options).load(filename)
    return reader.lines() if text else reader.payload()


#: Bytes after which a batch of rows goes to a task of the sink. Both sides of the task hold a batch more than once.
BATCH_BYTES = 2**21
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def _bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of ``BATCH_BYTES`` unless the session itself says how large they are."""
    if spark.conf.get(_BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_SETTING)


def write(df: DataFrame, filename: str, mode: str = "wb", **options) -> None:
    """``open`` for writing: ``df`` (name, data) goes to ``<name>.gz`` files of the folder ``filename``."""
    operation, text, _ = parse_mode(mode)
    if operation == "r":
        raise ValueError("use read() for mode r")
    newline, encoding, errors = (options.pop(k, d) for k, d in (("newline", None), ("encoding", "utf-8"), ("errors", "strict")))
    if text:
        df = df.withColumn("data", C.encode_text("data", encoding, errors, newline))
    writer = df.select("name", F.col("data").cast("binary").alias("data")).write.format("gzstream").mode("append")
    if operation == "x":
        options["exclusive"] = "true"
    if operation == "w":
        options["truncate"] = "true"
    register_source(df.sparkSession)
    with _bounded_batches(df.sparkSession):
        writer.options(**{k: str(v) for k, v in options.items() if v is not None}).save(filename)


# --- the data source ----------------------------------------------------------


def _files(path: str) -> list[str]:
    """The visible files of a file, folder or glob."""
    found = sorted(glob.glob(path)) or [path]
    return [f for p in found for f in ([os.path.join(d, x) for d, _, names in os.walk(p) for x in sorted(names) if not x.startswith((".", "_"))] if os.path.isdir(p) else [p])]


def _members(path: str) -> Iterator[kernel.Member]:
    """Members of a file as they are validated; none is kept."""
    report = kernel.Report()
    for _ in kernel.scan(_file_pieces(path), report):
        yield from report.members
        report.members.clear()
    yield from report.members


class MemberRange(InputPartition):
    def __init__(self, path: str, index: int | None, start: int, size: int | None, at: int):
        self.path, self.index, self.start, self.size, self.at = path, index, start, size, at


RANGE = "path string, index int, compressed_offset bigint, compressed_size bigint, uncompressed_offset bigint, uncompressed_size bigint"
CHUNK_ROW = "path string, member int, seq int, byte_offset bigint, data binary"


class GzReaderSource(DataSourceReader):
    def __init__(self, options: dict):
        self.chunk = int(options.get("chunk_size", kernel.CHUNK))
        self.limit = int(options["max_decompressed_size"]) if "max_decompressed_size" in options else None
        self.members = options.get("relation", "chunks") == "members"
        self.by_member = options.get("split", "file") == "member"
        self.ranges = options.get("ranges")
        self.files = _files(local_path(options.get("path", "")))
        kernel.check_chunk_size(self.chunk)

    def partitions(self):
        """A partition per file, or per member: from the JSON lines of ``ranges``, else from a first pass here (``member_chunks`` makes it a job)."""
        if self.members or not self.by_member:
            return [MemberRange(f, None, 0, None, 0) for f in self.files]
        if self.ranges:
            known = [json.loads(line) for f in _files(local_path(self.ranges)) for line in open(f, encoding="utf-8") if line.strip()]
            return [MemberRange(local_path(r["path"]), r["index"], r["compressed_offset"], r["compressed_size"], r["uncompressed_offset"]) for r in known]
        out = []
        for f in self.files:
            at = 0
            for m in _members(f):
                out.append(MemberRange(f, m.index, m.compressed_offset, m.compressed_size, at))
                at += m.uncompressed_size
        return out

    def read(self, partition: MemberRange):
        if self.members:
            at = 0
            for m in _members(partition.path):
                yield partition.path, m.index, m.compressed_offset, m.compressed_size, at, m.uncompressed_size
                at += m.uncompressed_size
            return
        source = _file_pieces(partition.path, partition.start, partition.size)
        for n, (at, data) in enumerate(even_chunks(source, self.chunk, self.limit)):
            yield partition.path, partition.index, n, partition.at + at, data


class FileWritten(WriterCommitMessage):
    """For each file: temporary name, final name, sizes and checksum of the member."""

    def __init__(self, files: list[tuple[str, str, int, int, int]]):
        self.files = files


#: What the last commit wrote, as JSON; readers pass over names that begin so.
COMMIT_FILE = "_gzframe_commit.json"


class GzWriterSource(DataSourceArrowWriter):
    """Rows (name, data) to members of ``<name>.gz``; files appear when the job commits.

    Rows of one name in a task make one member, which is encoded as they
    arrive. A name that several tasks write, or that exists already, gets its
    members appended, in the order of the tasks. Every file is replaced by one rename, and what a commit
    does is written down first: a commit that is run again after a crash
    leaves the same files. Mode ``overwrite`` removes other ``.gz`` files of
    the folder, after the new ones are there, and nothing else. The commit
    leaves sizes and checksums in ``COMMIT_FILE``."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder = local_path(options["path"])
        self.overwrite = overwrite or options.get("truncate") == "true"
        self.exclusive = options.get("exclusive") == "true"
        self.level = kernel.check_level(int(options.get("compresslevel", kernel.LEVEL)))
        self.mtime = kernel.check_mtime(float(options["mtime"])) if "mtime" in options else None
        self.name = options.get("original_filename")
        self.strict = options.get("strict_size", "false").lower() == "true"
        self.flush = int(options["sync_flush_every"]) if "sync_flush_every" in options else None
        self.run = uuid.uuid4().hex
        if self.exclusive and os.path.isdir(self.folder) and os.listdir(self.folder):
            raise FileExistsError(f"{self.folder} exists")

    def write(self, iterator):
        os.makedirs(self.folder, exist_ok=True)
        open_: dict[str, tuple[kernel.MemberEncoder, str]] = {}
        for batch in iterator:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = self._safe(name)
                if name not in open_:
                    member = kernel.MemberEncoder(self.level, self.mtime, kernel.header_filename(self.name, f"{self.folder}/{name}.gz"), self.strict, self.flush)
                    open_[name] = member, os.path.join(self.folder, f".{self.run}-{uuid.uuid4().hex}")
                    self._put(open_[name][1], member.begin())
                member, tmp = open_[name]
                self._put(tmp, member.feed(data or b""))
        files = []
        for name, (member, tmp) in open_.items():
            self._put(tmp, member.finish())
            files.append((tmp, os.path.join(self.folder, name + ".gz"), member.uncompressed_size, member.compressed_size, member.crc32))
        return FileWritten(files)

    @staticmethod
    def _put(path: str, data: bytes) -> None:
        if data:
            with open(path, "ab") as f:
                f.write(data)

    @staticmethod
    def _safe(name: str | None) -> str:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"not a file name: {name!r}")
        return re.sub(r"\.gz$", "", name)

    def commit(self, messages):
        parts: dict[str, list[tuple]] = {}
        for f in sorted((f for m in messages if m for f in m.files), key=lambda f: f[1]):
            parts.setdefault(f[1], []).append(f)
        os.makedirs(self.folder, exist_ok=True)
        journal = os.path.join(self.folder, f".{self.run}-journal")
        if os.path.exists(journal):
            with open(journal) as f:
                before = json.load(f)
        else:
            if self.exclusive and (there := [t for t in parts if os.path.exists(t)]):
                raise FileExistsError(there[0])
            before = {t: 0 if self.overwrite or not os.path.exists(t) else os.path.getsize(t) for t in parts}
            with open(journal + "-", "w") as f:
                json.dump(before, f)
            os.replace(journal + "-", journal)
        for target, own in parts.items():
            self._join(target, before[target], [f[0] for f in own])
        if self.overwrite:
            for x in os.listdir(self.folder):
                if x.endswith(".gz") and not x.startswith((".", "_")) and os.path.join(self.folder, x) not in parts:
                    os.remove(os.path.join(self.folder, x))
        report = [{"file": os.path.basename(t), "uncompressed_size": f[2], "compressed_size": f[3], "crc32": f[4]} for t, own in parts.items() for f in own]
        with open(journal + "-", "w") as f:
            json.dump(report, f)
        os.replace(journal + "-", os.path.join(self.folder, COMMIT_FILE))
        for f in (f for own in parts.values() for f in own):
            if os.path.exists(f[0]):
                os.remove(f[0])
        os.remove(journal)

    def _join(self, target: str, before: int, tmps: list[str]) -> None:
        """Make ``target`` its first ``before`` bytes and then the temporary files; doing it again changes nothing."""
        if len(tmps) == 1 and not before:
            if os.path.exists(tmps[0]):
                os.replace(tmps[0], target)
            return
        whole = os.path.join(self.folder, f".{self.run}-whole")
        with open(whole, "wb") as f:
            if before:
                for data in _file_pieces(target, 0, before):
                    f.write(data)
            for tmp in tmps:
                for data in _file_pieces(tmp):
                    f.write(data)
        os.replace(whole, target)

    def abort(self, messages):
        for m in messages:
            for f in m.files if m else []:
                if os.path.exists(f[0]):
                    os.remove(f[0])


class GzStreamSource(DataSource):
    """``spark.read.format("gzstream")``: path, member, seq, byte_offset, data; ``relation=members``: ``RANGE``. ``write``: columns name, data."""

    @classmethod
    def name(cls):
        return "gzstream"

    def schema(self):
        return RANGE if self.options.get("relation") == "members" else CHUNK_ROW

    def reader(self, schema):
        return GzReaderSource(dict(self.options))

    def writer(self, schema, overwrite):
        return GzWriterSource(dict(self.options), overwrite)


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(GzStreamSource)


def member_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``RANGE`` of every member of mounted files: a task per file validates it in bounded memory. Its JSON lines serve as ``ranges``."""
    register_source(spark)
    return spark.read.format("gzstream").option("relation", "members").load(path)


def member_chunks(spark: SparkSession, path: str, size: int = kernel.CHUNK, ranges: DataFrame | None = None) -> DataFrame:
    """``CHUNK_ROW`` of mounted files, decoded member by member on all executors; ranges come from a job, nothing from the driver."""
    kernel.check_chunk_size(size)
    found = (member_ranges(spark, path) if ranges is None else ranges).select("path", "index", "compressed_offset", "compressed_size", "uncompressed_offset")

    def run(batches):
        for batch in batches:
            for file, index, start, length, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, (offset, data) in enumerate(even_chunks(_file_pieces(local_path(file), start, length), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([index], pa.int32()), pa.array([n], pa.int32()), pa.array([at + offset], pa.int64()), pa.array([data], pa.binary())], ["path", "member", "seq", "byte_offset", "data"])

    return found.repartition("path", "index").mapInArrow(run, CHUNK_ROW)


def member_payloads(df: DataFrame, ranges: DataFrame | None = None, content: str = "content") -> DataFrame:
    """path, index, payload: members decoded in parallel, one row and so one unit of work per member.

    ``ranges`` (path, index, compressed_offset, compressed_size), as ``members`` gives and a table can keep them,
    saves the first pass over the streams. Only a member's own bytes travel with its row."""
    piece = lambda at, size: F.substring(F.col(content), (at + 1).cast("int"), size.cast("int"))
    if ranges is None:
        found = df.select("path", content, C.gz_inspect(content).members.alias("_m"))
        cut = F.transform("_m", lambda m: F.struct(m["index"].alias("index"), piece(m.compressed_offset, m.compressed_size).alias("member")))
        pieces = found.select("path", F.explode(cut).alias("x")).select("path", "x.*")
    else:
        known = ranges.groupBy("path").agg(F.collect_list(F.struct("index", "compressed_offset", "compressed_size")).alias("_m"))
        cut = F.transform("_m", lambda m: F.struct(m["index"].alias("index"), piece(m.compressed_offset, m.compressed_size).alias("member")))
        pieces = df.select("path", content).join(known, "path").select("path", F.explode(cut).alias("x")).select("path", "x.*")
    return pieces.repartition("path", "index").select("path", "index", C.gz_decompress("member").alias("payload"))
