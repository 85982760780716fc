"""Structured Streaming over gzip files: decode as files arrive, encode each micro-batch.

Backpressure is ``maxFilesPerTrigger`` and ``maxBytesPerTrigger``; progress is
the checkpoint of the query. A micro-batch that is run again writes the same
file names, so its output replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gzframe.functions import columns as C
from gzframe.operators import relations as R
from gzframe.sources import mounted
from gzframe.sources.shared import is_mounted

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Gzip files of a folder as a stream of (path, modificationTime, length, content)."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(folder)


def stream_lines(spark: SparkSession, folder: str, *, newline: str | None = None, max_files: int | None = None) -> DataFrame:
    """path, line_no, line of files as they arrive, with all checks; files of a mounted path are read in bounded pieces."""
    if is_mounted(spark, folder):
        return mounted.lines(stream_files(spark, folder, max_files), newline)
    return R.gz_lines(stream_files(spark, folder, max_files), ["path"], newline=newline)


def stream_verify(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    return R.streams(stream_files(spark, folder, max_files), ["path"], mode="PERMISSIVE")


def stream_chunks(spark: SparkSession, folder: str, size: int, max_files: int | None = None) -> DataFrame:
    return R.chunks(stream_files(spark, folder, max_files), ["path"], size=size)


def encode_stream(df: DataFrame, column: str, folder: str, checkpoint: str, *, mtime: int = 0, trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch of a text or binary column as gzip files, one member per partition and batch."""

    def save(batch: DataFrame, epoch: int) -> None:
        name = F.format_string("batch-%06d-%05d", F.lit(epoch), F.spark_partition_id())
        rows = batch.select(name.alias("name"), F.col(column).cast("binary").alias("data"))
        # a batch has a folder of its own, which a second run of the batch replaces
        rows.write.format("gzstream").mode("append").options(mtime=str(mtime), truncate="true").save(f"{folder}/{epoch:06d}")

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def round_trip(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    """Compress and decompress in one plan."""
    return df.select(*keep, C.gz_decompress(C.gz_compress(column, mtime=0)).cast("string").alias(column))
