"""The folder that driver and executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from gzframe import kernel

#: Used only where a session on one machine names no shared folder.
FALLBACK_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A session on one machine may do without that setting; on a cluster its lack is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (found or FALLBACK_SHARED).rstrip("/")


_known: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own for something a query writes, in the application's part of the shared folder, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/gzframe/{spark.sparkContext.applicationId}"
    if folder not in _known:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _known.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The path of a ``file:`` URI or plain path, for files that Python itself writes or maps.

    Those files must lie where all machines mount the same folder; another scheme is an error."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"this needs a mounted path, not {uri}")
    return os.path.abspath(uri)


def is_mounted(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether Spark itself takes the path or paths for files of the machine's own file system, which Python on the executors can open too."""
    to_path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    return all(to_path(p).getFileSystem(conf).getUri().getScheme() == "file" for p in ([path] if isinstance(path, str) else path))


def file_pieces(path: str, start: int = 0, size: int | None = None, piece: int = kernel.CHUNK) -> Iterator[bytes]:
    with open(path, "rb") as f:
        f.seek(start)
        left = size
        while left is None or left > 0:
            data = f.read(piece if left is None else min(piece, left))
            if not data:
                return
            left = None if left is None else left - len(data)
            yield data
